"""Quality classifier: naive Bayes features under a linear support vector machine.

A document is a set of n-gram indicators: word 1- and 2-grams and 1- to 3-grams of
word shapes (letters by case, digits, marks; a word that repeats the one before has
a shape of its own), each known by 64 bits of hash.  Each indicator is scaled by the log
ratio of its smoothed counts in the two classes; the scaled vectors, at unit length, are
fitted with the hinge loss by dual coordinate descent; a logistic curve fitted on rows that
were kept aside turns margins into scores.

The fit uses a bounded sample of the labelled rows, those with the smallest hashed keys: at most
``sample`` rows and about ``chars`` characters, of both classes wherever both are labelled.  Executors turn them into hashes,
all of which are features; the driver holds hashes and index arrays, never texts.
Scoring covers the whole text of every row.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SAMPLE = 4000
CHARS = 16_000_000
REMEMBER = 50_000  # words, and 64 times as many characters, whose hashes a task keeps
_C = np.random.default_rng(20250310).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
SAME = np.uint64(xxhash.xxh64_intdigest(b"=", 3))  # the shape of a word that repeats the one before


def _hash(s: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Signs(dict):
    """Character code to its sign: A and a for letters by case, 0 for digits, itself for marks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = self[code] = "A" if c.isupper() else "0" if c.isdecimal() else "a" if c.isalnum() else c
        return got


_SIGNS = _Signs()
_RUN, _MARKS = re.compile(r"([aA0])\1+"), re.compile(r"(\W)\1{2,}")


def shape(word: str) -> str:
    """A sign for each run of letters by case or of digits; of equal marks the first two."""
    out = _RUN.sub(r"\1", word.translate(_SIGNS))
    return out if out.isalnum() else _MARKS.sub(r"\1\1", out)


class _Words(dict):
    """Numbers of words, in order of arrival, with the hashes of their lower-case forms and shapes."""

    def __init__(self):
        super().__init__()
        self.lower, self.form, self.shapes, self.chars = array("Q"), array("Q"), {}, 0

    def __missing__(self, word: str) -> int:
        s = shape(word)
        form = self.shapes.get(s)
        if form is None:
            form = self.shapes[s] = _hash(s, 3)
        self.lower.append(_hash(word.lower(), 2))
        self.form.append(form)
        self.chars += len(word)
        n = self[word] = len(self)
        return n


class Features:
    """The n-gram hashes of a text; words are remembered up to a bound, which a text may pass."""

    def __init__(self, remember: int = REMEMBER):
        self.remember = remember
        self.words = _Words()

    def all(self, text: str | None) -> np.ndarray:
        """Hashes of all n-grams, repeated ones too."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.remember or self.words.chars > 64 * self.remember:
            self.words = _Words()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        lower, form = (np.frombuffer(a, np.uint64)[at] for a in (self.words.lower, self.words.form))
        form[1:][at[1:] == at[:-1]] = SAME
        pairs = _mix(form[:-1] * _C[1] + form[1:] * _C[2])
        threes = _mix(pairs[:-1] * _C[3] + form[2:] * _C[4])
        return np.concatenate([lower, _mix(lower[:-1] * _C[0] + lower[1:]), form, pairs, threes])

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of all n-grams."""
        return np.unique(self.all(text))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: np.ndarray, rounds: int = 40, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss linear model, one dual variable at a time; ``rows`` are (indices, values)."""
    w, alpha = np.zeros(width), np.zeros(len(y))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            if not square[i]:
                continue
            at, v = rows[i]
            g = y[i] * float(w[at] @ v) - 1
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= c[i] and g <= 0):
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            w[at] += (new - alpha[i]) * y[i] * v
            alpha[i] = new
        if worst < tolerance:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        q = p * (1 - p)
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


class Model:
    """Weights and squared ratios by n-gram hash; a score for a text's hashes."""

    def __init__(self, names: np.ndarray, weight: np.ndarray, ratio2: np.ndarray, bias: float, slope: float, offset: float):
        self.bias, self.slope, self.offset = bias, slope, offset
        self.bits = np.uint64(max(1, (len(names) - 1).bit_length()) if len(names) else 1)
        slot = names >> (np.uint64(64) - self.bits)
        order = np.argsort(slot, kind="stable")
        self.names, self.weight, self.ratio2 = names[order], weight[order], ratio2[order]
        self.first = np.searchsorted(slot[order], np.arange(int(1 << int(self.bits)) + 1, dtype=np.uint64)).astype(np.int32)  # of each slot

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct places of those hashes that the model knows."""
        slot = (hashes >> (np.uint64(64) - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        found = []
        while True:
            more = np.flatnonzero(at < end)
            if not len(more):
                return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)
            at, end, hashes = at[more], end[more], hashes[more]
            found.append(at[self.names[at] == hashes])
            at = at + 1

    def margin(self, hashes: np.ndarray) -> float:
        at = self.find(hashes)
        return (float(self.weight[at].sum()) + self.bias) / math.sqrt(float(self.ratio2[at].sum()) + 1.0)

    def score(self, hashes: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(hashes) + self.offset, -35.0), 35.0)))


def fit(sets: list[np.ndarray], labels: list[int], c: float = 1.0) -> Model:
    """Fit on labelled sets of hashes.  Without both classes the score is the smoothed share of label 1.

    Every fourth set is kept aside for the logistic curve, and neither its n-grams nor its label
    count in the model; all are fitted, and tell the curve, where else a class would be missing.
    """
    y = np.array(labels, dtype=np.int64)
    none = np.zeros(0)
    if len(set(labels)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(0, np.uint64), none, none, 0.0, 1e-6, math.log(p / (1 - p)))
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    part = np.flatnonzero(~aside)
    own, names = y[part], np.unique(np.concatenate([sets[i] for i in part]))
    known = [np.searchsorted(names, sets[i]).astype(np.int32) for i in part]
    one, zero = np.ones(len(names)), np.ones(len(names))
    for k, l in zip(known, own):
        (one if l else zero)[k] += 1  # a set has each hash once
    ratio = np.log((one / own.sum()) / (zero / (len(own) - own.sum())))
    del one, zero
    wide = np.r_[ratio, 1.0]  # the last is the bias
    rows = []
    for k in known:
        k = np.r_[k, np.int32(len(names))]
        v = wide[k]
        rows.append((k, v / math.sqrt(float(v @ v))))
    del known
    cost = np.where(own == 1, c * len(own) / (2 * own.sum()), c * len(own) / (2 * (len(own) - own.sum())))
    w = dual_descent(rows, np.where(own == 1, 1.0, -1.0), len(wide), cost)
    model = Model(names, w[:-1] * ratio, ratio**2, float(w[-1]), 1.0, 0.0)
    test = np.flatnonzero(aside) if aside.any() else part
    model.slope, model.offset = logistic_fit(np.array([model.margin(sets[i]) for i in test]), y[test])
    return model


def chosen_rows(rows: list[tuple], sample: int, chars: int) -> list[tuple]:
    """Of ``(label, length, ...)`` in the order of their hashes those to fit on, in the same order.

    A class has a tenth of the rows, if it has so many.  Rows that no longer fit into ``chars``
    are passed over, and the smaller class comes first into its half; a class whose rows are all
    larger than that has the shortest of them.
    """
    of = {l: [r for r in rows if r[0] == l] for l in (0, 1)}
    least = {l: min(len(of[l]), max(1, sample // 10)) for l in of}
    first = rows[:sample]
    for l in of:
        if sum(r[0] == l for r in first) < least[l]:
            first = of[l][: least[l]] + of[1 - l][: max(1, sample - least[l])]
    keep, left = set(), chars
    for l in sorted(of, key=lambda l: sum(r[1] for r in first if r[0] == l)):
        own, room = [r for r in first if r[0] == l], left if keep or not of[1 - l] else chars // 2
        spent = 0
        for r in own:
            if spent + r[1] <= room:
                keep.add(r)
                spent += r[1]
        if own and not any(r in keep for r in own):
            short = min(of[l], key=lambda r: r[1])
            keep.add(short)
            spent = short[1]
        left -= spent
    return [r for r in rows if r in keep]


def labelled_sample(docs: DataFrame, labels: DataFrame, train: str, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, chars: int = CHARS) -> tuple[list[np.ndarray], list[int]]:
    """Sets of hashes and labels of the rows to fit on: those for which ``train``, an SQL condition on the key, holds.

    A key labelled more than once counts with its smallest label; null keys and labels
    teach nothing; a key that several rows have gives its first text.  Rows count in the order of
    their hashed keys, as ``chosen_rows`` says.
    """
    ids = labels.where(f"({train}) and {label} in (0, 1)").groupBy(key).agg(F.min(label).alias("__y"))
    size = docs.groupBy(F.col(key).alias("__k")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("__n"))
    both = ids.join(size, ids[key] == size["__k"]).select(key, "__y", "__n").withColumn("__h", F.xxhash64(key))
    ends = [both.where(F.col("__y") == l).orderBy("__h", key).limit(sample) for l in (0, 1)]
    rows = sorted(((r["__y"], r["__n"], r["__h"], r[key]) for e in ends for r in e.collect()), key=lambda r: r[2:])  # ``sample`` narrow rows of each class
    first = chosen_rows(rows, sample, chars)
    if not first:
        return [], []
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r[3], i, r[0]) for i, r in enumerate(first)], f"__k {dict(labels.dtypes)[key]}, __i int, __y int")
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k").groupBy("__i", "__y").agg(F.min("__t").alias("__t"))

    def run(batches):
        make = Features()
        for b in batches:
            sets = [make.of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["i", "y", "hashes"])

    got = rows.select("__i", "__y", "__t").mapInArrow(run, "i int, y int, hashes binary").toLocalIterator()
    got = sorted(((r["i"], r["y"], np.frombuffer(bytes(r["hashes"]), np.uint64)) for r in got), key=lambda r: r[0])
    return [r[2] for r in got], [int(r[1]) for r in got]


def score_quality(docs: DataFrame, labels: DataFrame, train: str, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, the text only with ``keep_text``, and ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without n-grams.  Every row is
    scored, repeated ones alike; without labelled rows the score is 0.5.  Columns named
    ``score`` or ``predicted`` are replaced.
    """
    model = fit(*labelled_sample(docs, labels, train, key, text, label, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of ``chars`` characters at most, but for a row that has more
    rest = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]

    def run(batches):
        m, make = shared.value, Features()
        for b in batches:
            s = [m.score(make.all(t.as_py())) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*(f.name for f in rest), "score", "predicted"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double, predicted int"])
    return docs.select(*dict.fromkeys([*(f.name for f in rest), text])).mapInArrow(run, ddl)
