"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel, with Nystroem landmarks.

A labelled text is a bag of windows of its sentences, and a window is one word: words are read without case, with inserted
marks removed, look-alike digits and signs read as letters, and letters that stand apart ("a b c d") joined. Two words
are compared by the squared normalised kernel of their common subsequences of length ORDER, each weighted by GAP to the
power of the span it covers, so that gapped and inserted characters only lower the value. That kernel is positive definite;
the landmarks' own matrix is worked out in full, and the machine is linear in the values of a word with the landmarks. Of
those, values with landmarks of whose distinct letters a word has under NEAR are not worked out but taken as 0.

Landmarks are the words of labelled texts that mark toxic ones most and, against them, the frequent clean words nearest to
these. A word that SURE toxic texts have and that passes the test is a landmark, MARKS at most; with less evidence it
is one only up to LANDMARKS. Learning is over bags: a toxic text needs one toxic window. The score is a logistic calibration of
the largest decision values in the text, of their sum and of its length. (Whole sentences as windows, with the sum of the kernel
over their words, found fewer toxic texts and raised more false alarms; figures are in the README.)

Bounds of what is learned from: LEARNED_ROWS labelled rows; of their words the WORDS in most toxic texts; CANDIDATES that pass
the test; the FREQUENT clean words, of which the KIN nearest to toxic ones are looked at; CLEAN windows of clean texts
and NEAREST windows of a text in the machine's sample. Scoring reads everything.

Null and empty texts have no window and score as a clean text does; whole texts are read, words of any length in
overlapping windows of WIDE letters. Equal texts have equal scores; without labels of both kinds all score the share
of label 1. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays, doc_columns, fold, map_arrow, sampled, texts

ORDER, GAP, NEAR, WIDE = 3, 0.7, 0.75, 40
#: Labelled rows learned from (about; all if fewer), landmarks of each kind, words in a worker's memory.
LEARNED_ROWS, LANDMARKS, MEMORY = 6_000, 40, 400_000
#: Words compared with the landmarks together.
AT_ONCE = 16_384
#: Two landmarks of one kind are less alike than this; words that a toxic text is taken to need; values that
#: calibrate; clean words in the machine's sample; words of a text that it sees.
ALIKE, NEEDED, TOP, CLEAN, NEAREST = 0.55, 2, 3, 8_000, 12
#: Toxic texts that make a word a landmark whatever their number, and the most of those; bounds of words looked at.
SURE, MARKS, WORDS, CANDIDATES, FREQUENT, KIN = 12, 512, 40_000, 2_000, 20_000, 400
#: Signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
apart = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}").findall
spaces = re.compile(r"\s+")
not_letters = re.compile(r"[\W\d_]+")
edges = re.compile(r"^[\W_]+|[\W_]+$")


def clean(token: str) -> str:
    """A lower-case token as the letters that it shows."""
    if token.isalpha():
        return token
    token = edges.sub("", token)
    if not any(c.isalpha() for c in token):
        return ""
    return not_letters.sub("", token.translate(LOOKALIKE))


def tokens_of(text: str) -> Counter:
    text = text.lower()
    out = Counter(text.split())
    if found := apart(text):
        out.update(spaces.sub("", x) for x in found)
    return out


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDE else [word[k : k + WIDE] for k in range(0, len(word) - WIDE // 2, WIDE // 2)]


def coded(words: list[str]) -> np.ndarray:
    """The code points of each word in a row, filled up with zeros."""
    wide = max(1, max(map(len, words), default=1))
    return np.array(words, dtype=f"<U{wide}").view(np.uint32).reshape(len(words), wide).astype(np.int32)


def masks_of(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter of each row (letters 61 apart share one)."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << ((codes - 97) % 61).astype(np.uint64), np.uint64(0)), axis=1)


def kernel_rows(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of each row of s with the row of t beside it (codes, zeros at the ends)."""
    t = np.where(t == 0, -1, t)
    rows, m = t.shape
    fade = GAP ** (np.arange(m)[None, :] - np.arange(m)[:, None])
    fade = np.where(np.arange(m)[None, :] >= np.arange(m)[:, None], fade, 0).astype(np.float32)
    before = [np.ones((rows, m), np.float32)] + [np.zeros((rows, m), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(rows, np.float32)
    for x in s.T:
        same = (t == x[:, None]) * np.float32(GAP * GAP)
        total += (before[-1] * same).sum(1)
        fresh = []
        for k in range(1, ORDER):
            # of t up to and without the present letter: a match further left, faded by its distance
            ended = (before[k - 1] * same) @ fade
            fresh.append(np.concatenate([np.zeros((rows, 1), np.float32), ended[:, :-1]], 1))
        for k in range(1, ORDER):
            before[k] = before[k] * np.float32(GAP) + fresh[k - 1]
    return total


def kernel_of(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The kernel of rows i of codes a with rows j of codes b, in batches of like length."""
    out = np.zeros(len(i), np.float32)
    la, lb = (a > 0).sum(1)[i], (b > 0).sum(1)[j]
    order = np.argsort(la * 64 + lb, kind="stable")
    for k in range(0, len(order), 4096):
        pick = order[k : k + 4096]
        out[pick] = kernel_rows(a[i[pick], : max(1, la[pick].max())], b[j[pick], : max(1, lb[pick].max())])
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The kernel of a[k] with b[k]."""
    at = np.arange(len(a))
    return kernel_of(coded(a), at, coded(b), at) if a else np.zeros(0, np.float32)


class Landmarks:
    def __init__(self, words: list[str], toxic: int):
        """words: the landmarks, the first `toxic` of them from toxic sentences."""
        self.words, self.toxic = words, toxic
        self.codes = coded(words)
        self.masks = masks_of(self.codes) if words else np.zeros(0, np.uint64)
        self.least = np.ceil(NEAR * np.bitwise_count(self.masks)).astype(np.uint8)
        self.own = kernel(words, words) if words else np.zeros(0, np.float32)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse kernel values of words with landmarks: word, landmark, value. Words are taken AT_ONCE at a time."""
        found = [self.near_some(words[k : k + AT_ONCE], k) for k in range(0, len(words), AT_ONCE)] or [self.near_some([], 0)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def near_some(self, words: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(k, p) for k, w in enumerate(words) for p in windows(w)]
        if not parts or not self.words:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        whose, codes = np.array([k for k, _ in parts]), coded([p for _, p in parts])
        of, mark = np.nonzero(np.bitwise_count(masks_of(codes)[:, None] & self.masks[None, :]) >= self.least[None, :])
        found = np.unique(of)
        if not len(found):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        own = np.zeros(len(parts), np.float32)
        own[found] = kernel_of(codes, found, codes, found)
        value = kernel_of(codes, of, self.codes, mark) ** 2 / np.maximum(own[of] * self.own[mark], 1e-12)
        word = whose[of]
        key = word * len(self.words) + mark
        at, inv = np.unique(key, return_inverse=True)
        best = np.zeros(len(at), np.float32)
        np.maximum.at(best, inv, value)
        return at // len(self.words) + first, at % len(self.words), best


class Machine:
    """weights: of the landmarks' kernel values (the Nystroem map folded in); curve: of the calibration."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, bias: float, curve: np.ndarray, cap: float = np.inf):
        """cap: decision values above this count as this; a clean word between toxic kin is no more toxic than they."""
        self.marks, self.weights, self.bias, self.curve, self.cap = marks, weights, bias, curve, cap
        self.known: dict[str, float] = {}

    def values(self, bags: list[Counter]) -> np.ndarray:
        """Of each bag of tokens the TOP largest decision values, the logarithms of the sum of the positive ones and of its size."""
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = sorted(set().union(*bags).difference(self.known)) if bags else []
        f = np.full(len(fresh), self.bias)
        at, mark, value = self.marks.near([clean(t) for t in fresh])
        np.add.at(f, at, value * self.weights[mark])
        self.known.update(zip(fresh, np.minimum(f, self.cap).tolist()))
        known = self.known.__getitem__
        out = np.full((len(bags), TOP + 2), self.bias)
        for k, bag in enumerate(bags):
            v = np.fromiter(map(known, bag), np.float64, len(bag))
            if len(v) and (above := np.flatnonzero(v > self.bias)).size:
                n = np.minimum(np.fromiter(bag.values(), np.int64, len(bag))[above], TOP)
                top = np.sort(np.repeat(v[above], n))[::-1][:TOP]
                out[k, : len(top)] = top
            out[k, TOP] = np.log1p(4 * sum(x * c for x, c in zip(v.tolist(), bag.values()) if x > 0))
            out[k, TOP + 1] = np.log1p(bag.total())
        return out

    def score(self, bags: list[Counter]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expanded(self.values(bags)) @ self.curve, -30, 30)))


def expanded(f: np.ndarray) -> np.ndarray:
    return np.concatenate([f, f[:, : TOP + 1] * f[:, TOP + 1 :], np.ones((len(f), 1))], 1)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 100.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """A linear machine by full-batch subgradient steps on the squared hinge loss; y is -1 or 1."""
    w, b = np.zeros(x.shape[1]), 0.0
    hw, hb = np.full(x.shape[1], 1e-6), 1e-6
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight
        gw, gb = w - cost * ((slack * y) @ x), -cost * float((slack * y).sum())
        hw, hb = hw + gw**2, hb + gb**2
        w, b = w - 0.5 * gw / np.sqrt(hw), b - 0.5 * gb / np.sqrt(hb)
    return w, b


def calibrated(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic curve over the expanded values, by Newton steps with a small penalty."""
    x = expanded(f)
    scale = np.maximum(x.std(0), 1e-9)
    scale[-1] = 1
    x = x / scale
    c = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(c))
        step = np.linalg.solve(h, x.T @ (p - y) + 0.3 * c)
        c = c - step * min(1, 4 / max(1e-9, np.abs(step).max()))
    return c / scale


def chosen(counts: list[tuple[str, int, int]], n1: int, n0: int) -> Landmarks:
    """counts: words with the number of toxic and of clean texts that have them."""
    z = []
    for word, p, q in counts:
        if len(word) >= ORDER and p >= 2:
            d = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))
            se = np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
            if d / se >= 2.8 and d - 1.6 * se >= 1:
                z.append((d / se, word, p))
    z = sorted(z, key=lambda x: (-x[0], x[1]))[:CANDIDATES]
    toxic = unlike([w for _, w, _ in z], {w for _, w, p in z if p >= SURE})
    if not toxic:
        return Landmarks([], 0)
    clean_words = [w for w, p, q in sorted(counts, key=lambda x: (-x[2], x[0])) if len(w) >= ORDER and w not in toxic and q > p][:FREQUENT]
    at, _, value = Landmarks(toxic, len(toxic)).near(clean_words)
    best = np.zeros(len(clean_words), np.float32)
    np.maximum.at(best, at, value)
    near = unlike([clean_words[k] for k in np.argsort(-best, kind="stable")[:KIN] if best[k] > 0.02])
    return Landmarks(toxic + near, len(toxic))


def unlike(words: list[str], sure: set[str] = frozenset()) -> list[str]:
    """The first LANDMARKS words and of the others those in sure, MARKS in all, without those too like an earlier one."""
    own = dict(zip(words, kernel(words, words))) if words else {}
    out: list[str] = []
    for w in words:
        if len(out) >= (MARKS if w in sure else LANDMARKS):
            continue
        if not out or (kernel([w] * len(out), out) / np.sqrt(own[w] * np.array([own[x] for x in out])) < ALIKE).all():
            out.append(w)
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = LEARNED_ROWS) -> Machine:
    """Learn from about `rows` labelled rows at most for which `learn` (of doc_id) holds; equal texts count once."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    marked = sampled(marked.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", rows)
    sample = doc_columns(docs).join(F.broadcast(marked), "doc_id")
    # tokens of the bounded sample, once; both passes below read them
    def bags():
        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(0), pa.array([sorted({c for t in tokens_of(x) if (c := clean(t))}) for x in texts(batch)], pa.list_(pa.string())), batch.column(2), batch.column(3)]

        return f

    bag = map_arrow(sample.select("doc_id", "text", "y", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), bags, "doc_id bigint, words array<string>, y int, h string")
    bag = bag.groupBy("h").agg(F.min(F.struct("doc_id", "y", "words")).alias("one")).select("one.*").cache()
    try:
        n = {r["y"]: r["count"] for r in bag.groupBy("y").count().collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        share = float(np.log((n1 + 1) / (n0 + 1)))
        if not n1 or not n0:
            return Machine(Landmarks([], 0), np.zeros(0), 0.0, np.array([0.0] * (2 * TOP + 3) + [share]))
        df = bag.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
        counts = [(r["word"], r["p"], r["q"]) for r in df.where("p + q >= 3 or p >= 2").orderBy(F.desc("p"), F.desc("q"), "word").limit(WORDS).toArrow().to_pylist()]
        marks = chosen(counts, n1, n0)
        if not marks.words:
            return Machine(marks, np.zeros(0), 0.0, np.array([0.0] * (2 * TOP + 3) + [share]))

        def instances():
            def f(batch: pa.RecordBatch) -> list:
                bags = batch.column(1).to_pylist()
                words = sorted(set().union(*bags)) if bags else []
                seen: dict[str, dict[int, float]] = {}
                for i, j, v in zip(*(x.tolist() for x in marks.near(words))):
                    seen.setdefault(words[i], {})[j] = v
                out = []
                for bag_ in bags:
                    like = {w: max((v for j, v in seen[w].items() if j < marks.toxic), default=0.0) for w in bag_ if w in seen}
                    kept = sorted(sorted(like, key=lambda w: (-like[w], w))[:NEAREST])
                    dense = np.zeros((len(kept), len(marks.words)), np.float32)
                    for k, w in enumerate(kept):
                        dense[k, list(seen[w])] = list(seen[w].values())
                    out.append(dense.ravel())
                return [batch.column(0), pa.array(out, pa.list_(pa.float32())), batch.column(2)]

            return f

        found = map_arrow(bag.select("doc_id", "words", "y"), instances, "doc_id bigint, near array<float>, y int").toArrow().sort_by("doc_id")
        y = np.array(found.column("y").to_pylist())
        near_words = [x.reshape(-1, len(marks.words)) for x in arrays(found.column("near"))]
        weights, bias, cap = learned(marks, near_words, y)
        machine = Machine(marks, weights, bias, np.zeros(0), cap)

        def measured():
            def f(batch: pa.RecordBatch) -> list:
                v = machine.values([tokens_of(t) for t in texts(batch)])
                return [batch.column(0), pa.array(list(v), pa.list_(pa.float64())), batch.column(2)]

            return f

        kept = bag.select("doc_id")
        found = map_arrow(sample.join(F.broadcast(kept), "doc_id", "left_semi").select("doc_id", "text", "y"), measured, "doc_id bigint, f array<double>, y int").toArrow().sort_by("doc_id")
        machine.curve = calibrated(np.array(arrays(found.column("f"))), np.array(found.column("y").to_pylist(), float))
        machine.known = {}
        return machine
    finally:
        bag.unpersist()


def learned(marks: Landmarks, bags: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the landmarks, the bias and the cap: the machine over Nystroem features K(landmarks)^(-1/2) k(word), refitted
    with the words of each toxic text that it finds worst."""
    k = len(marks.words)
    i, j = np.divmod(np.arange(k * k), k)
    gram = kernel([marks.words[a] for a in i], [marks.words[b] for b in j]).reshape(k, k) ** 2 / np.outer(marks.own, marks.own)
    lam, vec = np.linalg.eigh((gram + gram.T) / 2 + 1e-4 * np.eye(k))
    root = (vec / np.sqrt(np.maximum(lam, 1e-4))) @ vec.T
    toxic = [b for b, t in zip(bags, y) if t and len(b)]
    rest = np.concatenate([np.zeros((1, k)), *(b for b, t in zip(bags, y) if not t and len(b))])
    like = rest[:, : marks.toxic].max(1)
    hard = np.argsort(-like, kind="stable")[: CLEAN // 2]
    easy = np.setdiff1d(np.arange(len(rest)), hard)
    easy = np.random.default_rng(5).permutation(easy)[: CLEAN // 2]
    rest, weight = rest[np.concatenate([hard, easy])], np.concatenate([np.ones(len(hard)), np.full(len(easy), max(1, len(like) - len(hard)) / max(1, len(easy)))])
    worst = [b[:, : marks.toxic].max(1) for b in toxic]
    w, bias = np.zeros(k), 0.0
    for _ in range(2):
        x = np.concatenate([b[np.union1d(np.argsort(-v)[:NEEDED], np.flatnonzero(b[:, : marks.toxic].max(1) >= ALIKE**2))] for b, v in zip(toxic, worst)] + [rest]) @ root
        n = len(x) - len(rest)
        s = np.concatenate([np.ones(n), -np.ones(len(rest))])
        w, bias = svm(x, s, np.concatenate([np.full(n, 0.5 / max(1, n)), 0.5 * weight / weight.sum()]))
        worst = [b @ (root @ w) for b in toxic]
    tops = [v.max() + bias for v in worst]
    return root @ w, bias, float(np.median(tops)) if tops else np.inf


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every document: a narrow map; the broadcast model has at most MARKS + LANDMARKS landmarks."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value

        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(0), pa.array(m.score([tokens_of(t) for t in texts(batch)]), pa.float64())]

        return f

    return map_arrow(doc_columns(docs), make, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold `held` are not learned from."""
    machine = train(docs, labels, fold("doc_id", folds) != held)
    return score(docs, machine).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
