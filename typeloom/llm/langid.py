"""Language identification by words first, with backoff to character n-grams.

Each known word adds its log frequency in each language. An unseen word falls back to its 5-grams; if none of them is
known, to 4-grams, and so on down to single characters. A text's language has the largest sum; the score is its
share after a softmax of the sums, damped by the square root of the number of words. Ties go to the smaller language.
A word is a run of letters (Unicode category L) in lower case.

Learned are all languages, from about LEARNED_ROWS documents of each at most, words that occur once included. The model has at
most WORDS words and GRAMS n-grams of each length for a language, and ENTRIES of all languages together: with many
languages the most frequent of each, and one at least. Only the languages in which a word occurs have an entry for it.

Null texts and texts without a letter get `und` and score 0, as do all texts when nothing could be learned.
Whole texts are read; equal texts get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_columns, fold, map_arrow, sampled, texts, written

#: Learned from about so many documents of a language at most; words and n-grams kept of each language, and of all; longest n-gram.
LEARNED_ROWS = 4_000
WORDS, GRAMS, ENTRIES, LONGEST = 30_000, 20_000, 1_000_000, 5
#: Words that a worker remembers, and numbers that they may take.
MEMORY, NUMBERS = 300_000, 20_000_000
UNKNOWN = "und"
runs = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """The runs of letters. The pattern's runs may hold numerals that are no letters, and are cut there."""
    found = runs(text)
    if text.isascii():
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def words_of(text: str) -> Counter:
    return Counter(letters(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return list(word) if n == 1 else [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Table:
    """Log frequencies of words or n-grams. A row is the languages' logs of nothing, and more where there is something."""

    def __init__(self, of: list[Counter], most: int):
        kept = sorted({w for c in of for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]})
        self.at = {w: k for k, w in enumerate(kept)}
        totals = np.array([sum(c.values()) for c in of], float) + 0.1 * (1 + len(kept))
        self.base = np.log(0.1 / totals) if len(of) else np.zeros(0)
        found = [(self.at[w], k, n) for k, c in enumerate(of) for w, n in c.items() if w in self.at]
        row, lang, n = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable")
        self.lang, self.more = lang[order].astype(np.int32), np.log((n[order] + 0.1) / 0.1)
        self.starts = np.searchsorted(row[order], np.arange(len(kept) + 1))

        # with few languages all rows are worked out at once
        self.dense = self.filled(np.arange(len(kept))) if len(kept) * len(of) <= NUMBERS else None

    def filled(self, at: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(at), 1))
        n = self.starts[at + 1] - self.starts[at]
        slots = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)), n), self.lang[slots]] += self.more[slots]
        return out

    def logs(self, at: np.ndarray) -> np.ndarray:
        """The rows of entries by their numbers."""
        return self.filled(at) if self.dense is None else self.dense[at]


class Model:
    def __init__(self, counts: dict[str, list[tuple[str, int]]]):
        """counts: of each language, the most frequent words with their counts."""
        self.langs = sorted(counts)
        share = max(1, ENTRIES // max(1, len(self.langs)))
        self.words = Table([Counter(dict(counts[x])) for x in self.langs], min(WORDS, share))
        self.grams = []
        for n in range(1, LONGEST + 1):
            of = []
            for lang in self.langs:
                of.append(seen := Counter())
                for word, k in counts[lang]:
                    for g in grams_of(word, n):
                        seen[g] += k
            self.grams.append(Table(of, min(GRAMS, share)))
        self.memory = max(1024, min(MEMORY, NUMBERS // max(1, len(self.langs))))
        self.clear()

    def clear(self) -> None:
        """Remember the learned words only, or none where their rows are not worked out at once."""
        self.known: dict[str, int] = {} if self.words.dense is None else dict(self.words.at)
        self.rows = np.zeros((0, len(self.langs))) if self.words.dense is None else self.words.dense
        self.fixed = len(self.known)

    def learn(self, fresh: list[str]) -> None:
        """Work out the rows of words that are not remembered: of the word itself, or the mean of its longest known n-grams."""
        out, left = np.zeros((len(fresh), len(self.langs))), list(range(len(fresh)))
        for n, table in [(0, self.words), *((n, self.grams[n - 1]) for n in range(LONGEST, 0, -1))]:
            get, at, starts, own, rest = table.at.get, [], [], [], []
            for k in left:
                found = [x for g in (grams_of(fresh[k], n) if n else [fresh[k]]) if (x := get(g)) is not None]
                if found:
                    own.append(k)
                    starts.append(len(at))
                    at += found
                else:
                    rest.append(k)
            if own:
                out[own] = np.add.reduceat(table.logs(np.array(at, np.int64)), starts) / np.diff([*starts, len(at)])[:, None]
            left = rest
        used = len(self.known)
        if used + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows[:used], out, np.zeros((used, len(self.langs)))])
        else:
            self.rows[used : used + len(fresh)] = out
        self.known.update((w, used + k) for k, w in enumerate(fresh))

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language and its score of each text."""
        bags = [words_of(t) for t in texts]
        if len(self.known) - self.fixed > self.memory:
            self.clear()
        if self.langs and (fresh := sorted(set().union(*bags).difference(self.known))):
            self.learn(fresh)
        return [self.predicted(c) for c in bags]

    def predicted(self, counts: Counter) -> tuple[str, float]:
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total = n @ self.rows[list(map(self.known.__getitem__, counts))]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp((total - total[best]) / np.sqrt(n.sum())).sum())

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(docs: DataFrame, learn: Column, lang: str = "lang", rows: int = LEARNED_ROWS) -> Model:
    """Learn from about `rows` documents of each language at most for which `learn` (of doc_id) holds. Words are
    counted in each batch before they are shuffled, and the most frequent of each language go to the driver, ENTRIES in all
    (or one for each language)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    found = sampled(found.where(F.col("lang").isNotNull() & learn), "doc_id", rows, per="lang")

    def make():
        def f(batch: pa.RecordBatch) -> list:
            seen: dict[str, Counter] = {}
            for t, of in zip(texts(batch), batch.column(2).to_pylist()):
                seen.setdefault(of, Counter()).update(words_of(t))
            flat = [(of, w, n) for of, c in seen.items() for w, n in c.items()]
            return [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())]

        return f

    counted = map_arrow(found, make, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(docs.sparkSession, counted, "words")
    most = min(WORDS, max(1, ENTRIES // max(1, counted.select("lang").distinct().count())))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    counts: dict[str, list[tuple[str, int]]] = {}
    for row in kept.toArrow().to_pylist():
        counts.setdefault(row["lang"], []).append((row["word"], row["n"]))
    return Model({lang: sorted(c, key=lambda x: (-x[1], x[0])) for lang, c in counts.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document: a narrow map with the model broadcast (its entries are bounded)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(batch: pa.RecordBatch) -> list:
            out = m.predict_all(texts(batch))
            return [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

        return f

    return map_arrow(doc_columns(docs), make, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows of fold `held` are not learned from."""
    model = train(docs, fold("doc_id", folds) != held)
    return predict(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
