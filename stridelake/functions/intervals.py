"""Interval algebra with higher-order functions: one row in, one row out, no shuffle.

An interval is ``struct<start, end>``, an action ``struct<category, start, end>``; seconds as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def clip(intervals: Column, duration: Column) -> Column:
    """Intervals cut to [0, duration]; what is empty after the cut goes."""
    cut = F.transform(intervals, lambda i: i.withField("start", F.greatest(i["start"], F.lit(0.0))).withField("end", F.least(i["end"], duration)))
    return F.filter(cut, lambda i: i["end"] > i["start"])


def union_duration(intervals: Column) -> Column:
    """Length of the union; touching intervals merge.  0 for none, null for null."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("high"))
    spans = F.array_sort(F.transform(intervals, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"))))
    step = lambda s, i: F.struct((s["total"] + F.greatest(F.lit(0.0), i["end"] - F.greatest(i["start"], s["high"]))).alias("total"), F.greatest(s["high"], i["end"]).alias("high"))
    return F.aggregate(spans, zero, step, lambda s: s["total"])


def merge(intervals: Column) -> Column:
    """Sorted disjoint intervals with the same union; touching ones merge."""
    spans = F.array_sort(F.transform(intervals, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"))))

    def step(s, i):
        last = F.element_at(s, -1)
        grown = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], i["end"]).alias("end"))))
        return F.when((F.size(s) > 0) & (i["start"] <= F.get(s, F.size(s) - 1)["end"]), grown).otherwise(F.concat(s, F.array(i)))

    return F.aggregate(spans, F.array().cast("array<struct<start:double,end:double>>"), step)


def coverage(intervals: Column, duration: Column) -> Column:
    """Share of the duration that the clipped union covers; 0 for a duration of 0 or less."""
    return F.when(duration > 0, union_duration(clip(intervals, duration)) / duration).otherwise(F.lit(0.0))


def segments(actions: Column, duration: Column) -> Column:
    """The duration cut at every boundary: ``array<struct<start, end, active>>``, active categories sorted.

    A category is active in a segment when one of its intervals holds the midpoint.
    """
    empty = F.array().cast("array<struct<start:double,end:double,active:array<string>>>")

    def cut(x):
        acts, marks = x["a"], x["m"]
        pairs = F.transform(F.sequence(F.lit(1), F.size(marks) - 1), lambda k: F.struct(F.get(marks, k - 1).alias("start"), F.get(marks, k).alias("end")))
        inside = lambda p: F.filter(acts, lambda a: (a["start"] <= (p["start"] + p["end"]) / 2) & ((p["start"] + p["end"]) / 2 < a["end"]))
        with_active = F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.array_sort(F.array_distinct(F.transform(inside(p), lambda a: a["category"]))).alias("active")))
        return F.when((duration > 0) & (F.size(marks) > 1), with_active).otherwise(empty)

    marks = lambda acts: F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), duration), F.transform(acts, lambda a: a["start"]), F.transform(acts, lambda a: a["end"]))))
    return let(actions, lambda acts: let(F.struct(acts.alias("a"), marks(acts).alias("m")), cut))


def allocated(segs: Column, unlabeled: str = "unknown") -> Column:
    """``map<category, seconds>``: each segment's length shared equally by its active categories."""
    cats = lambda segs: F.array_distinct(F.flatten(F.transform(segs, lambda s: F.when(F.size(s["active"]) > 0, s["active"]).otherwise(F.array(F.lit(unlabeled))))))
    share = lambda s, c: F.when(F.array_contains(s["active"], c), (s["end"] - s["start"]) / F.size(s["active"])).when((F.size(s["active"]) == 0) & (c == unlabeled), s["end"] - s["start"]).otherwise(F.lit(0.0))
    return let(segs, lambda segs: F.map_from_entries(F.transform(F.array_sort(cats(segs)), lambda c: F.struct(c, F.aggregate(segs, F.lit(0.0), lambda t, s: t + share(s, c))))))


def fill_unlabeled(alloc: Column, policy: str, fallback: Column, unlabeled: str = "unknown") -> Column:
    """The allocation under a policy for unlabelled time: ``keep_unknown``, ``ignore`` or ``fill_with_primary_seq_label``."""
    if policy == "keep_unknown":
        return alloc
    known = F.map_filter(alloc, lambda k, v: k != unlabeled)
    if policy == "ignore":
        return known
    if policy != "fill_with_primary_seq_label":
        raise ValueError(f"unknown policy for unlabelled time: {policy}")
    rest = F.coalesce(alloc[unlabeled], F.lit(0.0))
    added = F.map_zip_with(known, F.create_map(fallback, rest), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return F.when(fallback.isNotNull() & (rest > 0), added).otherwise(alloc)


def primary_category(alloc: Column) -> Column:
    """The category with the most seconds; ties go to the first by name; ``unknown`` for an empty map."""
    best = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.coalesce(F.get(F.array_sort(F.map_entries(alloc), best), F.lit(0))["key"], F.lit("unknown"))


def proportions(alloc: Column, duration: Column) -> Column:
    """Shares of the duration, which add up to less than 1 where unlabelled time is ignored; empty for a duration of 0."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.when(duration > 0, F.transform_values(alloc, lambda k, v: v / duration)).otherwise(none)


def dominance(alloc: Column, duration: Column) -> Column:
    """The primary category's share of the duration; 0 for an empty map or a duration of 0."""
    return F.when(duration > 0, F.coalesce(F.array_max(F.map_values(alloc)), F.lit(0.0)) / duration).otherwise(F.lit(0.0))


def conserved(alloc: Column, duration: Column) -> Column:
    """The allocation as it is; the query fails if it doesn't add up to a positive duration.

    For policies that leave no time out; tolerances are 1e-5 seconds and one in a million.
    """
    total = F.aggregate(F.map_values(alloc), F.lit(0.0), lambda s, v: s + v)
    close = F.abs(total - duration) <= F.greatest(F.lit(1e-5), 1e-6 * F.greatest(F.abs(total), F.abs(duration)))
    return F.when((duration > 0) & ~close, F.raise_error(F.lit("allocated seconds don't add up to the duration")).cast("map<string,double>")).otherwise(alloc)


def entropy(props: Column) -> Column:
    """Shannon entropy in nats of a map's values, each damped by 1e-12."""
    return F.aggregate(F.map_values(props), F.lit(0.0), lambda s, p: s - p * F.log(p + F.lit(1e-12)))
