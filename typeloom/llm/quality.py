"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the number of features.
Words enter by hash with a value that falls with the number of distinct words, statistics by the quantile bin that
they fall in. Statistics are of the whole text; the metadata is n_chars, or the text's length where it is null or missing.

Null and empty texts have no words and the statistics of an empty text, and so a score as any other. Equal texts with
equal metadata have equal scores. Without labels the score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays, fitted_in_task, fold, map_arrow, sampled, slices

#: Places for hashed words; labelled rows learned from at most (about; all if fewer); factors; passes over the sample.
PLACES = 1 << 14
LEARNED_ROWS = 8_000
FACTORS = 4
PASSES = 12
BINS = 12
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]
OF_BYTE = np.full(256, len(CLASSES))
for _k, _chars in enumerate(CLASSES):
    OF_BYTE[list(_chars)] = _k
STATS = len(CLASSES) + 1 + 9


def statistics(text: str, words: list[str], counts: Counter, meta: float) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    per_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(OF_BYTE, weights=per_byte, minlength=len(CLASSES) + 1) / max(1, len(raw))
    lines = text.split("\n")
    share = per_byte[per_byte > 0] / max(1, len(raw))
    n = len(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        *kinds.tolist(),
        np.log1p(n),
        len(counts) / max(1, n),
        max(counts.values(), default=0) / max(1, n),
        sum(map(len, words)) / max(1, n),
        repeats / max(1, n),
        n / len(lines),
        len(set(lines)) / len(lines),
        float(-(share * np.log(share)).sum()),
        np.log1p(meta),
    ]


def features(text: str, meta: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Places and values of the words, and the statistics."""
    words = text.split()
    counts = Counter(words)
    places = np.fromiter((crc32(w.encode()) for w in counts), np.int64, len(counts)) % PLACES
    values = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(values):
        values /= np.sqrt((values**2).sum())
    return places.astype(np.int32), values.astype(np.float32), statistics(text, words, counts, len(text) if meta is None else meta)


class Machine:
    """w0, weights and factors over PLACES words and BINS bins of each statistic."""

    def __init__(self, seed: int = 7):
        self.size = PLACES + STATS * BINS
        self.edges = np.zeros((STATS, BINS - 1))
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (self.size, FACTORS))

    def rows(self, feats: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = np.array([f[2] for f in feats]).reshape(len(feats), STATS)
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(STATS)], 1) + PLACES + np.arange(STATS) * BINS
        one = np.full(STATS, 1 / np.sqrt(STATS), np.float32) * 2
        idx = np.concatenate([x for f, b in zip(feats, bins) for x in (b, f[0])])
        val = np.concatenate([x for f in feats for x in (one, f[1])]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([STATS + len(f[0]) for f in feats])[:-1]])
        return idx, val, starts

    def raw(self, idx, val, starts):
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx**2).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s**2).sum(1) - squares), s

    def score(self, feats: list[tuple]) -> np.ndarray:
        if not feats:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(feats))[0], -30, 30)))

    def learn(self, feats: list[tuple], y: np.ndarray, rate: float = 0.15, decay: float = 2e-4, batch: int = 64) -> Machine:
        """Adagrad on the logistic loss, in an order fixed by the seed."""
        if len(y) == 0:
            return self
        stats = np.array([f[2] for f in feats], float).reshape(len(feats), STATS)
        self.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
        p = (y.sum() + 1) / (len(y) + 2)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv, g0 = np.full(self.size, 1e-2), np.full((self.size, FACTORS), 1e-2), 1e-2
        order = np.random.default_rng(11)
        for _ in range(PASSES):
            perm = order.permutation(len(y))
            for k in range(0, len(y), batch):
                pick = perm[k : k + batch]
                idx, val, starts = self.rows([feats[i] for i in pick])
                raw, s = self.raw(idx, val, starts)
                err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]
                row = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(idx))))
                e = err[row] * val / len(pick)
                at, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, e, len(at)) + decay * self.w[at]
                each = e[:, None] * (s[row] - self.v[idx] * val[:, None])
                dv = np.stack([np.bincount(inv, each[:, f], len(at)) for f in range(FACTORS)], 1) + decay * self.v[at]
                gw[at] += dw**2
                gv[at] += dv**2
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])
                d0 = err.mean()
                g0 += d0**2
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata column."""
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(meta >= 0, meta).alias("meta"))


def batch_features(batch: pa.RecordBatch) -> list[tuple]:
    return [features(t or "", m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = LEARNED_ROWS) -> Machine:
    """Learn from about `rows` labelled rows at most for which `learn` (of doc_id) holds."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    marked = sampled(marked.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", rows)

    def make():
        def f(batch: pa.RecordBatch) -> list:
            feats = batch_features(batch)
            return [batch.column(0), pa.array([x[0] for x in feats], pa.list_(pa.int32())), pa.array([x[1] for x in feats], pa.list_(pa.float32())), pa.array([x[2] for x in feats], pa.list_(pa.float64())), batch.column(3)]

        return f

    sample = map_arrow(inputs(docs).join(F.broadcast(marked), "doc_id").select("doc_id", "text", "meta", "y"), make, "doc_id bigint, places array<int>, vals array<float>, stats array<double>, y int")
    return fitted_in_task(sample, "doc_id", fit)


def fit(rows: pa.Table | None) -> Machine:
    """The machine learned from rows of features and labels."""
    if rows is None or not rows.num_rows:
        return Machine()
    feats = list(zip(*(arrays(rows.column(k)) for k in ("places", "vals", "stats"))))
    return Machine().learn(feats, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, keep: float | None = None) -> DataFrame:
    """doc_id, score of every document; with keep, instead the documents, all columns, whose score is at least that.
    A narrow map with the model (under 1 MB, a fixed size) broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    place = {c.lower(): k for k, c in enumerate(docs.columns)}

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        m = model.value
        meta = batch.column(place["n_chars"]).to_pylist() if "n_chars" in place else [None] * batch.num_rows
        return m.score([features(t or "", n if n is not None and n >= 0 else None) for t, n in zip(batch.column(place["text"]).to_pylist(), meta)])

    def make():
        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(0), pa.array(model.value.score(batch_features(batch)), pa.float64())]

        return f

    if keep is None:
        return map_arrow(inputs(docs), make, "doc_id bigint, score double")

    def kept(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores(part) >= keep))

    return docs.mapInArrow(kept, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold `held` are not learned from."""
    machine = train(docs, labels, fold("doc_id", folds) != held)
    return score(docs, machine).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
