"""Audit reports: distributions, scopes, counters, comparisons, digests, job inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stridelake.operators import digests


def effective_duration(primary: Column, fallback: Column) -> Column:
    """The first of the two that is neither null nor 0, else 0."""
    return F.coalesce(F.nullif(primary, F.lit(0.0)), F.nullif(fallback, F.lit(0.0)), F.lit(0.0))


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Every row beside the one row of ``totals``."""
    return rows.crossJoin(F.broadcast(totals))  # one row


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole, 8)).otherwise(F.lit(0.0))


def group_distribution(df: DataFrame, by: str, duration: str) -> DataFrame:
    """Count, seconds and shares of each group; the share is of the rounded seconds."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(duration).alias("__d"))
    both = _with_totals(g, g.agg(F.sum("n").alias("__n"), F.coalesce(F.sum("__d"), F.lit(0.0)).alias("__all")))
    seconds = F.round("__d", 6)
    return both.select(by, "n", seconds.alias("seconds"), _ratio(F.col("n"), F.col("__n")).alias("count_ratio"), _ratio(seconds, F.col("__all")).alias("duration_ratio"))


def category_scope(df: DataFrame, inclusive: str, alloc: str, primary: str) -> DataFrame:
    """Counts of any and primary, inclusive and allocated seconds and the shares of each category; a null primary is ``unknown``."""
    names = df.select(F.explode(F.map_keys(F.map_zip_with(inclusive, alloc, lambda k, a, b: F.coalesce(a, b)))).alias("category"), inclusive, alloc)
    of = lambda m: F.sum(F.coalesce(F.col(m)[F.col("category")], F.lit(0.0)))
    any_ = names.groupBy("category").agg(F.count("*").alias("any_count"), of(inclusive).alias("__i"), of(alloc).alias("__a"))
    first = df.groupBy(F.coalesce(primary, F.lit("unknown")).alias("category")).agg(F.count("*").alias("primary_count"))
    both = any_.join(first, "category", "full_outer").fillna(0, ["any_count", "primary_count"]).fillna(0.0, ["__i", "__a"])
    both = _with_totals(both, both.agg(F.sum("__a").alias("__all"), F.sum("primary_count").alias("__n")))  # a row has one primary
    allocated = F.round("__a", 6)
    return both.select(
        "category",
        "any_count",
        "primary_count",
        F.round("__i", 6).alias("inclusive"),
        allocated.alias("allocated"),
        _ratio(F.col("any_count"), F.col("__n")).alias("any_ratio"),
        _ratio(F.col("primary_count"), F.col("__n")).alias("primary_ratio"),
        _ratio(allocated, F.col("__all")).alias("allocated_ratio"),
    )


def scope_totals(df: DataFrame, alloc: str, duration: str, matched: Column) -> DataFrame:
    """One row: sequences, seconds, how many are matched and not, and allocated seconds."""
    whole = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6)
    own = F.aggregate(F.map_values(alloc), F.lit(0.0), lambda s, v: s + v)
    n = F.count_if(F.coalesce(matched, F.lit(False)))
    return df.agg(F.count("*").alias("sequences"), whole(F.col(duration)).alias("seconds"), n.alias("matched"), (F.count("*") - n).alias("unmatched"), whole(own).alias("allocated"))


def stage_counts(df: DataFrame, stages: dict[str, str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """``stage, status, n``: rows by the status column of each stage, zeros for statuses that are ``known``."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).alias("status")) for s, c in stages.items())))
    counts = df.select(each.alias("x")).select("x.*").groupBy("stage", "status").agg(F.count("*").alias("n"))
    rows = [(s, v) for s, values in (known or {}).items() for v in values]
    if not rows:
        return counts
    dim = df.sparkSession.createDataFrame(rows, "stage string, status string")
    return dim.join(counts, ["stage", "status"], "full_outer").fillna(0, ["n"])


def rule_statistics(df: DataFrame, rejects: str, reviews: str) -> DataFrame:
    """``reason, reject_count, review_count, overlap_count``; overlaps are of rows with more than one reason."""
    tagged = lambda c, kind: F.transform(c, lambda r: F.struct(r.alias("reason"), F.lit(kind).alias("kind")))
    every = F.concat(tagged(rejects, "reject"), tagged(reviews, "review"))
    rows = df.select(F.explode(every).alias("x"), (F.size(rejects) + F.size(reviews) > 1).alias("several")).select("x.*", "several")
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("reject", "review")]
    return rows.groupBy("reason").agg(*kinds, F.count_if("several").alias("overlap_count"))


def staged(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """A row for each stage that a row is in, named in ``stage``; stages may overlap."""
    return df.withColumn("stage", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in stages.items())))))


def staged_distribution(df: DataFrame, stages: dict[str, Column], by: str, duration: str) -> DataFrame:
    """``group_distribution`` of each stage."""
    g = staged(df, stages).groupBy("stage", by).agg(F.count("*").alias("n"), F.sum(duration).alias("__d"))
    both = g.join(F.broadcast(g.groupBy("stage").agg(F.sum("n").alias("__n"), F.sum("__d").alias("__all"))), "stage")  # a row a stage
    seconds = F.round("__d", 6)
    return both.select("stage", by, "n", seconds.alias("seconds"), _ratio(F.col("n"), F.col("__n")).alias("count_ratio"), _ratio(seconds, F.col("__all")).alias("duration_ratio"))


def tier_presence(df: DataFrame, hits: str) -> DataFrame:
    """``tier, n``: rows with any label of the tier."""
    return df.select(F.explode(hits).alias("tier", "labels")).groupBy("tier").agg(F.count_if(F.size("labels") > 0).alias("n"))


def top_labels(df: DataFrame, labels: str, n: int = 50) -> DataFrame:
    """The ``n`` labels that most rows have; ties by name."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def duration_summary(df: DataFrame, selected: Column, duration: str, fps: str) -> tuple[DataFrame, DataFrame]:
    """One row of counts and seconds of selected and rejected rows, and ``fps, n`` of the selected."""
    kept = F.coalesce(selected, F.lit(False))
    value = F.col(duration)
    one = df.agg(
        F.count("*").alias("inputs"),
        F.count_if(kept).alias("selected"),
        F.count_if(~kept).alias("rejected"),
        F.round(F.coalesce(F.sum(F.when(kept, value)), F.lit(0.0)), 6).alias("selected_seconds"),
        F.round(F.min(F.when(kept, value)), 6).alias("min_selected"),
        F.round(F.max(F.when(~kept, value)), 6).alias("max_rejected"),
    )
    return one, df.where(kept).groupBy(F.col(fps).alias("fps")).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """Counts of all known statuses, zeros included."""
    dim = df.sparkSession.createDataFrame([(s,) for s in known], "status string")
    return dim.join(df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, by: str, duration: str, n: int = 50, order: str = "seconds") -> DataFrame:
    """The ``n`` groups with the most ``seconds``, or rows (``order="n"``); ties by name."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(duration), 6).alias("seconds")).orderBy(F.desc(order), by).limit(n)


def examples(df: DataFrame, by: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` smallest keys of each group."""
    w = Window.partitionBy(by).orderBy(key)
    return df.select(by, key).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("examples"))


def compare_sets(left: DataFrame, right: DataFrame, key: str, status: str) -> DataFrame:
    """``membership, left_status, right_status, n``: what both have, what one has, and status changes."""
    both = left.select(F.col(key), F.col(status).alias("left_status"), F.lit(1).alias("l")).join(right.select(F.col(key), F.col(status).alias("right_status"), F.lit(1).alias("r")), key, "full_outer")
    member = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    return both.groupBy(member.alias("membership"), "left_status", "right_status").agg(F.count("*").alias("n"))


def status_digest(df: DataFrame, key: str, status: str, depth: int | None = None) -> DataFrame:
    """One digest of all (key, status) pairs, the root of a tree over them.

    It tells any change, as a digest of all pairs in one text would, which only one task could make.
    """
    return digests.tree(df, key, F.sha2(F.coalesce(F.col(status), F.lit("null")), 256), depth).where("level = 0").select("digest")


def metric_differences(a: DataFrame, b: DataFrame, key: str, metrics: list[str], status: str) -> DataFrame:
    """Mean signed, mean absolute and largest absolute difference of each metric, and status agreement."""
    both = a.select(key, *(F.col(m).alias(f"{m}_a") for m in metrics), F.col(status).alias("s_a")).join(b.select(key, *(F.col(m).alias(f"{m}_b") for m in metrics), F.col(status).alias("s_b")), key)
    each = both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_a") - F.col(f"{m}_b")).cast("double").alias("d"), (F.col("s_a") == F.col("s_b")).alias("same")) for m in metrics))).alias("x")).select("x.*")
    return each.groupBy("metric").agg(F.avg("d").alias("mean_signed"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), F.avg(F.col("same").cast("int")).alias("agreement"))


def job_inventory(items: DataFrame, quality: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Status of each item: failed, generated with or without warnings, or pending."""
    q = quality.select(F.col(key).alias("__q"), F.col("quality_status"))
    f = failures.select(F.col(key).alias("__f")).distinct()
    both = items.join(q, F.col(key) == F.col("__q"), "left").join(f, F.col(key) == F.col("__f"), "left")
    status = F.when(F.col("__q").isNotNull() & (F.col("quality_status") == "passed"), "generated").when(F.col("__q").isNotNull(), "generated_with_warnings").when(F.col("__f").isNotNull(), "failed").otherwise("pending")
    return both.withColumn("job_status", status).drop("__q", "__f")


def job_totals(jobs: DataFrame, full: str, half: str, seconds: str, status: str = "job_status", quality: str = "quality_status") -> DataFrame:
    """``scope, name, n, full_frames, half_frames, seconds``: jobs by status and by quality, and frames and time of what was generated.

    A row for each status and each quality, and one, ``total``, for all; sums are of generated jobs alone, missing numbers count as 0.
    """
    made = F.col(status).isin("generated", "generated_with_warnings")
    total = lambda c, kind: F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0)).cast(kind)
    sums = [F.count("*").alias("n"), total(full, "bigint").alias("full_frames"), total(half, "bigint").alias("half_frames"), total(seconds, "double").alias("seconds")]
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), n.alias("name")) for s, n in (("status", F.col(status)), ("quality", F.col(quality)), ("total", F.lit("total")))))
    each = jobs.select("*", F.explode(scopes).alias("__x")).where("__x.name is not null")
    return each.groupBy(F.col("__x.scope").alias("scope"), F.col("__x.name").alias("name")).agg(*sums)


def select_items(manifest: DataFrame, ids: DataFrame | None, key: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows for explicit ids in their given order (``ids(key, ordinal)``), or the first ``limit`` by ``order``."""
    if ids is not None:
        asked = ids.withColumnRenamed(key, "__id")
        found = asked.join(manifest, F.col("__id") == F.col(key), "left")
        known = F.when(F.col(key).isNull(), F.raise_error(F.lit("an id is not in the manifest")).cast("boolean")).otherwise(F.lit(True))
        return found.where(known).orderBy("ordinal").drop("__id", "ordinal")
    return manifest.orderBy(order or key).limit(limit) if limit is not None else manifest


def resume(pending: DataFrame, done: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Pending rows that aren't done under the same identity; a done row of another identity fails the query."""
    digest = lambda df: F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity)), 256)
    had = done.select(F.col(key).alias("__k"), digest(done).alias("__d"))
    both = pending.withColumn("__p", digest(pending)).join(had, F.col(key) == F.col("__k"), "left")
    clash = F.col("__k").isNotNull() & (F.col("__p") != F.col("__d"))
    return both.where(F.when(clash, F.raise_error(F.lit("output exists under another identity")).cast("boolean")).otherwise(F.col("__k").isNull())).drop("__p", "__k", "__d")
