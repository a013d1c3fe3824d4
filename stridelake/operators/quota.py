"""Balanced selection under category, source, subject and global budgets.

Scores are expressions.  The selection itself is sequential by definition (each decision
depends on all before it), so it is a plain function that runs in one task over nine narrow
columns of each candidate; everything before and after it is distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stridelake.functions import intervals


@dataclass
class Limit:
    """One budget; ratios are shares of the global budget, None is no limit and 0 allows nothing."""

    min_sec: float = 0.0
    max_sec: float | None = None
    max_ratio: float | None = None
    max_count: int | None = None
    count_ratio: float | None = None


@dataclass
class Budget:
    max_sec: float = 7200.0
    max_count: int = 1500
    tolerance: float = 10.0
    dominance: float = 0.8
    allow_mixed: bool = True
    categories: dict[str, Limit] = field(default_factory=dict)
    source: Limit | None = None
    sources: dict[str, Limit] = field(default_factory=dict)
    subject: Limit | None = None


def pool_durations(df: DataFrame, alloc: str, duration: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Seconds of the pool: allocated ones by category, whole durations by source."""
    by_category = df.select(F.explode(alloc).alias("category", "seconds")).groupBy("category").agg(F.sum("seconds").alias("pool"))
    return by_category, df.groupBy(F.col(source).alias("source")).agg(F.sum(duration).alias("source_pool"))


def selection_scores(df: DataFrame, key: str, quality: str, alloc: str, duration: str = "duration", source: str | None = None, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.3), skip_unknown: bool = False) -> DataFrame:
    """Add ``selection_score``: quality, rarity of categories and of the source, and mixture entropy.

    With a source a quality of 0 or null counts as 1, as do only null ones without; rarity is
    1/sqrt(pool + 1).  Pools join by category and source, so hot ones are partial sums.
    """
    q, c, s, m = weights
    by_category, by_source = pool_durations(df, alloc, duration, source or key)
    props = intervals.proportions(F.col(alloc), F.col(duration))
    share = df.select(key, F.explode(props).alias("category", "p"))
    rare = share.join(by_category, "category").where(F.col("category") != "unknown" if skip_unknown else F.lit(True))
    rare = rare.groupBy(key).agg(F.sum(F.col("p") / F.sqrt(F.col("pool") + 1)).alias("__rare"))
    out = df.join(rare, key, "left")
    quality_value = F.coalesce(F.nullif(F.col(quality), F.lit(0.0)), F.lit(1.0)) if source else F.coalesce(F.col(quality), F.lit(1.0))
    score = q * quality_value + c * F.coalesce("__rare", F.lit(0.0)) + m * intervals.entropy(props)
    if source:
        out = out.join(by_source.withColumnRenamed("source", "__source"), F.col(source) == F.col("__source"), "left").drop("__source")
        score = score + s / F.sqrt(F.coalesce("source_pool", F.lit(0.0)) + 1)
    return out.withColumn("selection_score", F.round(score, 10)).drop("__rare", "source_pool")


#: fixed values: the status of a row by what refused it, for either order of checks
STATUSES = {
    "global_first": {"global": "defer_global_budget", "category": "defer_quota_category"},
    "category_first": {"category": "defer_category_quota", "source": "defer_source_quota", "subject": "defer_subject_quota", "global": "defer_global_budget"},
}


def quota_status(selected: Column, reason: Column, order: str) -> Column:
    """``selected_candidate``, or the status that goes with the budget in the reason."""
    what = F.substring_index(reason, "_", 1)
    names = F.create_map(*(F.lit(x) for pair in STATUSES[order].items() for x in pair))
    return F.when(selected, "selected_candidate").otherwise(names[what])


def _limits(limit: Limit | None, seconds: float, count: float) -> tuple[float, float]:
    """Seconds and count that a limit allows, given the base of its ratios."""
    if limit is None:
        return math.inf, math.inf
    most = [x for x in (limit.max_sec, None if limit.max_ratio is None else limit.max_ratio * seconds) if x is not None]
    many = [x for x in (limit.max_count, None if limit.count_ratio is None else math.floor(limit.count_ratio * count)) if x is not None]
    return min(most, default=math.inf), min(many, default=math.inf)


class _State:
    def __init__(self, budget: Budget, base_sec: float, base_count: float, order: str):
        self.b, self.base, self.order = budget, (base_sec, base_count), order
        self.sec, self.n = 0.0, 0
        self.used: dict[tuple[str, str], list[float]] = {}

    def _over(self, kind: str, name: str, limit: tuple[float, float], add: float, slack: float, seconds_first: bool) -> str | None:
        sec, n = self.used.get((kind, name), (0.0, 0))
        checks = [("duration", sec + add > limit[0] + slack), ("count", n + 1 > limit[1])]
        for what, broken in checks if seconds_first else checks[::-1]:
            if broken:
                return f"{kind}_{what}"
        return None

    def refusal(self, r: dict) -> str | None:
        b = self.b
        whole = [("global_count", self.n + 1 > b.max_count), ("global_duration", self.sec + r["duration"] > b.max_sec + b.tolerance)]
        if self.order == "global_first":
            for code, broken in whole:
                if broken:
                    return code
        for c, add in sorted(r["alloc"].items()):
            if c not in b.categories:
                continue
            # an exception for mixed actions holds for seconds only; counts are those of primary categories
            mixed = b.allow_mixed and (c != r["primary"] or r["dominance"] < b.dominance)
            sec, n = _limits(b.categories[c], b.max_sec, b.max_count)
            limit = (math.inf if mixed else sec, n if c == r["primary"] else math.inf)
            over = self._over("category", c, limit, add, b.tolerance, self.order != "global_first")
            if over:
                return over
        if self.order != "global_first":
            limit = b.sources.get(r["source"], b.source)
            over = self._over("source", r["source"], _limits(limit, *self.base), r["duration"], 0.0, True)
            over = over or self._over("subject", f"{r['source']}/{r['subject']}", _limits(b.subject, *self.base), r["duration"], 0.0, True)
            if over:
                return over
            for code, broken in whole:
                if broken:
                    return code
        return None

    def accept(self, r: dict) -> None:
        self.sec += r["duration"]
        self.n += 1
        parts = [("source", r["source"], r["duration"], 1), ("subject", f"{r['source']}/{r['subject']}", r["duration"], 1)]
        parts += [("category", c, v, int(c == r["primary"])) for c, v in r["alloc"].items()]
        for kind, name, add, n in parts:
            u = self.used.setdefault((kind, name), [0.0, 0])
            u[0] += add
            u[1] += n


class Rows:
    """Candidates as columns of numbers, about 100 bytes each; a row's dictionary is built while it is looked at."""

    def __init__(self, parts: list[dict]):
        """``parts`` are columns by name: arrays, and ``size, category, seconds`` for what is allocated."""
        self.c = {n: np.concatenate([p.pop(n) for p in parts]) for n in list(parts[0])}
        self.ends = np.cumsum(self.c.pop("size"), dtype=np.int64)
        ids = self.c.pop("id")
        null = np.equal(ids, None) if ids.dtype == object else np.zeros(len(ids), bool)
        names, places = np.unique(ids[~null], return_inverse=True)
        self.same = np.full(len(ids), len(names))  # places in ``ids``, in their order, a null last
        self.same[~null] = places
        self.ids = np.array([*names.tolist(), None], object) if null.any() else names

    def __getitem__(self, k: int) -> dict:
        a, b = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        row = {n: self.c[n][k] for n in ("source", "subject", "primary")} | {n: float(self.c[n][k]) for n in ("duration", "dominance")}
        return row | {"alloc": dict(zip(self.c["category"][a:b], self.c["seconds"][a:b].tolist()))}

    def by_score(self) -> np.ndarray:
        return np.lexsort((self.same, -self.c["score"]))

    def by_seconds(self, name: str) -> np.ndarray:
        """Those with more than nothing in a category, most first."""
        at = np.flatnonzero((self.c["category"] == name) & (self.c["seconds"] > 0))
        owner = np.searchsorted(self.ends, at, "right")
        return owner[np.lexsort((self.same[owner], -self.c["score"][owner], -self.c["seconds"][at]))]


def columns_of(rows: list[dict]) -> dict:
    """The columns of ``Rows`` from dictionaries; equal names are one object."""
    known: dict = {}
    one = lambda values: np.array([known.setdefault(v, v) for v in values] + [None], object)[:-1]
    out = {n: np.array([r[n] for r in rows], float) for n in ("score", "duration", "dominance")}
    out |= {n: one(r[n] for r in rows) for n in ("source", "subject", "primary")}
    out |= {"id": np.array([r["id"] for r in rows]), "size": np.array([len(r["alloc"]) for r in rows], np.int32)}
    pairs = [p for r in rows for p in r["alloc"].items()]
    return out | {"category": one(c for c, _ in pairs), "seconds": np.array([s for _, s in pairs], float)}


def select_once(rows: Rows, budget: Budget, order: str, base_sec: float, base_count: float) -> tuple[np.ndarray, list, _State]:
    """Category minima first, smallest first; then everything by score.  A number for each id, and what numbers mean: ``(selected, pass, reason)``."""
    state, out, means = _State(budget, base_sec, base_count, order), np.full(len(rows.ids), -1, np.int16), {}
    code = lambda *what: means.setdefault(what, len(means))
    for name, limit in sorted(((c, l) for c, l in budget.categories.items() if l.min_sec > 0), key=lambda x: (x[1].min_sec, x[0])):
        for k in rows.by_seconds(name):
            if state.used.get(("category", name), (0.0, 0))[0] >= limit.min_sec:
                break
            if out[rows.same[k]] < 0:
                r = rows[k]
                if state.refusal(r) is None:
                    state.accept(r)
                    out[rows.same[k]] = code(True, f"minimum_{name}", None)
    for k in rows.by_score():
        if out[rows.same[k]] < 0:
            r = rows[k]
            reason = state.refusal(r)
            if reason is None:
                state.accept(r)
            out[rows.same[k]] = code(reason is None, "score" if reason is None else None, reason)
    return out, list(means), state


def select(rows: list[dict], budget: Budget, order: str = "category_first", rounds: int = 64) -> dict:
    """``{id: (selected, pass, reason)}`` of rows as dictionaries; see ``selected``."""
    if not rows:
        return {}
    both = Rows([columns_of(rows)])
    out, means = selected(both, budget, order, rounds)
    return {k: means[c] for k, c in zip(both.ids.tolist(), out.tolist())}


def selected(rows: Rows, budget: Budget, order: str, rounds: int = 64) -> tuple[np.ndarray, list]:
    """The selection; source and subject ratios refer to the totals achieved (a fixed point, shrinking bases)."""
    if order == "global_first":
        return select_once(rows, budget, order, budget.max_sec, budget.max_count)[:2]
    base = (budget.max_sec, float(budget.max_count))
    for _ in range(rounds):
        out, means, state = select_once(rows, budget, order, *base)
        after = (min(base[0], state.sec), min(base[1], float(state.n)))
        if abs(after[0] - base[0]) <= 1e-9 and after[1] == base[1]:
            return out, means
        base = after
    raise RuntimeError(f"the ratio bases did not settle within {rounds} rounds")


def apply_quota(df: DataFrame, budget: Budget, order: str = "category_first", key="id", score="selection_score", alloc="alloc", duration="duration", source="source", subject="subject", primary="primary_category", dominance="dominance") -> DataFrame:
    """``key, quota_selected, quota_pass, quota_reason`` for every candidate; the input's order doesn't matter."""
    kind = dict(df.dtypes)[key]
    narrow = df.select(*(F.col(c).alias(n) for c, n in ((key, "id"), (score, "score"), (alloc, "alloc"), (duration, "duration"), (source, "source"), (subject, "subject"), (primary, "primary"), (dominance, "dominance"))))

    def run(batches):
        parts, whole = [], None
        for batch in batches:
            whole = batch.schema.field("id").type
            if batch.num_rows:
                parts.append(columns_of([r | {"alloc": dict(r["alloc"] or {})} for r in batch.to_pylist()]))
        if not parts:
            return
        rows = Rows(parts)
        out, means = selected(rows, budget, order)
        for at in range(0, len(out), 10_000):
            found = [means[c] for c in out[at : at + 10_000]]
            cols = [pa.array([f[n] for f in found], t) for n, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(rows.ids[at : at + 10_000]).cast(whole), *cols], names=["id", "quota_selected", "quota_pass", "quota_reason"])

    return narrow.repartition(1).mapInArrow(run, f"id {kind}, quota_selected boolean, quota_pass string, quota_reason string").withColumnRenamed("id", key)


def quota_report(selected: DataFrame, alloc: str, duration: str, source: str) -> DataFrame:
    """Selected seconds and counts by category and by source."""
    cats = selected.select(F.explode(alloc).alias("name", "s")).groupBy("name").agg(F.round(F.sum("s"), 6).alias("seconds"), F.count_if(F.col("s") > 0).alias("n")).select(F.lit("category").alias("scope"), "name", "seconds", "n")
    srcs = selected.groupBy(F.col(source).alias("name")).agg(F.round(F.sum(duration), 6).alias("seconds"), F.count("*").alias("n")).select(F.lit("source").alias("scope"), "name", "seconds", "n")
    return cats.unionByName(srcs)
