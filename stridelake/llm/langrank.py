"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams in order.  A document's own
profile is compared with each by the out-of-place distance: the sum, over its
n-grams, of how far apart the two ranks are, an absent one counting as a whole
profile.  Counts cover all of every training text; only sums per (language, n-gram)
are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

NO_LETTERS = regex.compile(r"\P{L}+")
CHUNK = 1_000_000  # characters counted at a time
SALT = 64


def _codes(text: str):
    """A text's 1- to 3-grams as integers of 21 bits a character, ``CHUNK`` of each at a time; ``_`` stands for a word's edge.

    A part reads two characters on, so that the cuts change nothing.
    """
    whole = NO_LETTERS.sub("_", f" {text.lower()} ")
    for at in range(0, len(whole), CHUNK):
        cp = np.frombuffer(whole[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        letter = cp != 95
        two = cp[:-1] << 21 | cp[1:]
        three = two[:-1] << 21 | cp[2:]
        yield np.concatenate([cp[:CHUNK][letter[:CHUNK]], two[:CHUNK], three[:CHUNK][letter[1:-1][:CHUNK]]])


def _counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Summed n-gram counts of many texts, a bounded part at a time."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, n = [], 0

    def fold():
        nonlocal codes, counts
        c, k = np.unique(np.concatenate(held), return_counts=True)
        both, back = np.unique(np.concatenate([codes, c]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, k])).astype(np.int64)
        codes = both

    for t in texts:
        for part in _codes(t):
            held.append(part)
            n += len(part)
            if n > 3 * CHUNK:
                fold()
                held, n = [], 0
    if held:
        fold()
    return codes, counts


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 300) -> DataFrame:
    """``lang, code, rank`` (from 0): each language's ``size`` most frequent n-grams.

    Rows with a null language or without letters teach nothing.  Ties go to the
    smaller code.
    """

    def run(batches):
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, l in zip(batch.column(0), batch.column(1).to_pylist()):
                if t.is_valid:
                    by.setdefault(l, []).append(t.as_py())
            for l, texts in by.items():
                codes, counts = _counts(texts)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = seen.mapInArrow(run, "lang string, code bigint, n bigint").where("code >= 0").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "code"]
    part = sums.withColumn("salt", F.pmod(F.hash("code"), F.lit(SALT)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= size).drop("r")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "code", "rank")


class Ranker:
    """The profiles as one matrix: a row for each n-gram in any, a column for each language."""

    def __init__(self, rows, size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), size, np.int64)
        column = {l: k for k, l in enumerate(self.langs)}
        for l, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), column[l]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = _counts([text]) if text else (np.zeros(0, np.int64),) * 2
        letters = codes < 1 << 21
        if not len(codes) or not letters.any() or not self.langs:
            return "und", 0.0
        top = np.lexsort((codes, -counts))[: self.size]
        mine = codes[top]
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        rows = np.where(self.codes[at] == mine, at, len(self.codes))
        known = self.ranks[rows]
        apart = np.where(known == self.size, self.size, np.abs(known - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))  # ties: the first by name
        return self.langs[best], float(1 - apart[best] / (len(mine) * self.size))


def predict_language(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", size: int = 300) -> DataFrame:
    """``key, lang_pred, score`` for every row; a narrow scan.

    ``score`` is 1 less the winner's distance as a share of the largest possible.
    A null text or one without letters, and any text when there are no profiles, is
    ``und`` with score 0.  The profiles (``size`` rows a language) are broadcast.
    """
    rows = [(r.lang, r.code, r["rank"]) for r in profiles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Ranker(rows, size))

    def run(batches):
        ranker = shared.value
        for batch in batches:
            got = [ranker.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[key, "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
