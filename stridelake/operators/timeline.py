"""Interval algebra over rows: sweeps with windows, for sequences with any number of actions.

``functions.intervals`` does the same within a row's array.  Here an action is a row, and a sequence
with very many of them is sorted with spills, never held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


ROWS = 250_000  # actions of a task


def dealt(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """``rows``, of ``n`` actions, dealt by sequence to as many tasks as it takes for each to have about ``ROWS`` actions."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), seq)


def clipped(actions: DataFrame, durations: DataFrame, seq: str, start: str, end: str, duration: str) -> DataFrame:
    """Actions cut to [0, duration]; what is empty after the cut goes."""
    both = actions.join(durations.select(seq, duration), seq)
    cut = both.withColumns({start: F.greatest(F.col(start), F.lit(0.0)), end: F.least(F.col(end), F.col(duration))})
    return cut.where(F.col(end) > F.col(start)).drop(duration)


def merged(actions: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals with the same union for each key; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    high = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = actions.select(*keys, start, end).withColumn("__new", F.when(high.isNull() | (F.col(start) > high), 1).otherwise(0))
    marked = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def _fresh(actions: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Of each interval the part that no earlier one covers: disjoint intervals with the same union, which may touch."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    high = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = actions.select(*keys, F.greatest(F.col(start), high).alias(start), end)  # greatest passes a null over
    return cut.where(F.col(end) > F.col(start))


def union_seconds(actions: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """``seq, seconds``: the length of the union of each sequence's intervals; sequences without any have no row."""
    return merged(actions, [seq], start, end).groupBy(seq).agg(F.sum(F.col(end) - F.col(start)).alias("seconds"))


def allocated_seconds(actions: DataFrame, durations: DataFrame, seq: str, category: str, start: str, end: str, duration: str, unlabeled: str = "unknown", rows: int | None = None) -> DataFrame:
    """``seq, category, seconds``: each moment of the duration shared equally by the categories that are active then.

    A moment without any goes to ``unlabeled``.  Of the sweep only a running share is kept: the
    share of time since the start, summed over 1 / active categories, is read at both ends of an
    interval, and their difference is the interval's part.  Sequences with a duration of 0 have no rows.
    ``rows`` says how many actions there are, which are counted if it isn't given.
    """
    if rows is None:
        rows = actions.count()
    spans = _fresh(clipped(actions, durations, seq, start, end, duration), [seq, category], start, end)
    own = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))))
    ends = durations.where(F.col(duration) > 0).select(seq, F.lit(None).cast("string").alias(category), F.explode(F.array(F.lit(0.0), F.col(duration))).alias("t"), F.lit(0).alias("d"))
    marks = dealt(spans.select(seq, category, own.alias("x")).select(seq, category, "x.*").unionByName(ends), seq, rows)
    w = Window.partitionBy(seq).orderBy("t", "d", category)
    swept = marks.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("step", F.lead("t").over(w) - F.col("t"))
    swept = swept.withColumns({"share": F.when(F.col("n") > 0, F.col("step") / F.col("n")).otherwise(F.lit(0.0)), "idle": F.when(F.col("n") == 0, F.col("step"))})
    swept = swept.withColumn("before", F.coalesce(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    part = lambda c, v: F.struct(c.alias(category), v.alias("seconds"))
    told = F.array(F.when(F.col("d") != 0, part(F.col(category), -F.col("d") * F.col("before"))), F.when(F.col("idle") > 0, part(F.lit(unlabeled), F.col("idle"))))
    return swept.select(seq, F.explode(F.array_compact(told)).alias("x")).select(seq, "x.*").groupBy(seq, category).agg(F.sum("seconds").alias("seconds"))


def primary_of(rows: DataFrame, seq: str, category: str, seconds: str = "seconds") -> DataFrame:
    """``seq, primary_category, primary_seconds``: the category with the most seconds, ties to the first by name."""
    best = F.min_by(F.struct(category, seconds), F.struct(-F.col(seconds), F.col(category)))
    return rows.groupBy(seq).agg(best.alias("b")).select(seq, F.col(f"b.{category}").alias("primary_category"), F.col(f"b.{seconds}").alias("primary_seconds"))


HOT = 100_000  # intervals of a bin that one task looks through


def overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals overlap, each pair once; columns of both sides, which have no other name in common than the key.

    Time is cut into bins of ``width``; a row goes to every bin that it touches, and a pair is kept in the
    first bin that both touch.  A bin with more than ``HOT`` rows on the right is cut into
    parts, and the left rows of that bin go to each, so that a busy moment is no single task.
    Empty intervals and those with a null end overlap nothing.
    """

    def binned(df, start, end, name):
        low, high = (F.floor(F.col(c) / F.lit(float(width))) for c in (start, end))
        last = F.when(F.col(end) > high * F.lit(float(width)), high).otherwise(high - 1)  # the end itself is outside
        return df.where(F.col(end) > F.col(start)).withColumns({f"__first_{name}": low, "__bin": F.explode(F.sequence(low, F.greatest(low, last)))})

    l, r = binned(left, *a, "l"), binned(right, *b, "r")
    parts = r.groupBy(key, "__bin").agg(F.count("*").alias("__n")).where(F.col("__n") > HOT).select(key, "__bin", F.ceil(F.col("__n") / HOT).cast("int").alias("__parts"))
    l = l.join(parts, [key, "__bin"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__parts")
    r = r.join(parts, [key, "__bin"], "left").withColumn("__part", F.pmod(F.xxhash64(*b, *(c for c in right.columns if c not in (key, *b))), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    both = l.join(r, [key, "__bin", "__part"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("__bin") == F.greatest("__first_l", "__first_r")))
    return both.drop("__bin", "__part", "__first_l", "__first_r")


def segments_of(spans: DataFrame, durations: DataFrame, seq: str, start: str, end: str, duration: str) -> DataFrame:
    """``seq, seg_start, seg_end``: the duration of each sequence cut at every end of an interval; a duration of 0 has none."""
    known = durations.where(F.col(duration) > 0)
    marks = known.select(seq, F.explode(F.array(F.lit(0.0), F.col(duration))).alias("t"))
    cuts = spans.select(seq, F.explode(F.array(start, end)).alias("t")).join(known.select(seq), seq, "left_semi")
    w = Window.partitionBy(seq).orderBy("t")
    cut = marks.union(cuts).distinct().select(seq, F.col("t").alias("seg_start"), F.lead("t").over(w).alias("seg_end"))
    return cut.where("seg_end is not null")


def allocated_by_segments(actions: DataFrame, durations: DataFrame, seq: str, category: str, start: str, end: str, duration: str, unlabeled: str = "unknown", width: float | None = None) -> DataFrame:
    """What ``allocated_seconds`` says, segment by segment: a range join finds the categories that are active in each.

    ``width`` is that of the join's bins, by default the mean length of an interval or of a
    segment, whichever is larger, so that there are about twice as many rows in bins as outside.
    """
    spans = merged(clipped(actions, durations, seq, start, end, duration), [seq, category], start, end)
    segments = segments_of(spans, durations, seq, start, end, duration)
    if width is None:
        width = max(df.agg(F.avg(F.col(t) - F.col(s)).alias("w")).first()["w"] or 0.0 for df, s, t in ((spans, start, end), (segments, "seg_start", "seg_end"))) or 1.0
    active = overlapping(segments, spans, seq, ("seg_start", "seg_end"), (start, end), width)
    n = active.groupBy(seq, "seg_start", "seg_end").agg(F.count("*").alias("n"))
    length = F.col("seg_end") - F.col("seg_start")
    own = active.join(n, [seq, "seg_start", "seg_end"]).groupBy(seq, category).agg(F.sum(length / F.col("n")).alias("seconds"))
    idle = segments.join(n, [seq, "seg_start", "seg_end"], "left_anti").groupBy(seq).agg(F.sum(length).alias("seconds")).select(seq, F.lit(unlabeled).alias(category), "seconds")
    return own.unionByName(idle).groupBy(seq, category).agg(F.sum("seconds").alias("seconds"))
