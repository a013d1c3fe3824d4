"""Matching annotations to local files through a cascade of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LEVELS = ["exact_path", "anchor_exact", "parent_stem", "stem"]


def cascade_match(annotations: DataFrame, local: DataFrame) -> DataFrame:
    """Match ``annotations(ann_id, k0..k3)`` to ``local(local_id, k0..k3)``, keys from strict to loose.

    The first level with any hit decides: one hit matches, several are ambiguous and looser
    levels aren't tried.  A null key hits nothing.  If several annotations match one local
    row, all of them become ``ambiguous_local_conflict`` and keep its id.  Returns ``ann_id, status,
    level, local_id, n_candidates``; ``local_id`` is the only hit, null if there are none or several.  Per level the hits of a key are only counted and their
    smallest kept, so that a key that many rows share costs a partial aggregate, not a list.
    """
    out = annotations
    for k, level in enumerate(LEVELS):
        hits = local.where(F.col(f"k{k}").isNotNull()).groupBy(F.col(f"k{k}").alias(f"key{k}")).agg(F.count("*").alias(f"n{k}"), F.min("local_id").alias(f"low{k}"))
        out = out.join(hits, F.col(f"k{k}") == F.col(f"key{k}"), "left").drop(f"key{k}")
    level = F.coalesce(*(F.when(F.col(f"n{k}") > 0, F.lit(k)) for k in range(4)))
    pick = lambda c: F.coalesce(*(F.when(F.col("__level") == k, F.col(f"{c}{k}")) for k in range(4)))
    out = out.withColumn("__level", level).withColumn("n_candidates", F.coalesce(pick("n"), F.lit(0)).cast("bigint")).withColumn("__local", F.when(F.col("n_candidates") == 1, pick("low")))
    claims = out.where("__local is not null").groupBy(F.col("__local").alias("__claimed")).agg(F.count("*").alias("__claims"))
    out = out.join(claims, F.col("__local") == F.col("__claimed"), "left")
    names = F.array(*map(F.lit, LEVELS))
    status = F.when(F.col("n_candidates") == 0, "unmatched").when(F.col("n_candidates") > 1, "ambiguous").when(F.col("__claims") > 1, "ambiguous_local_conflict").otherwise(F.concat(F.lit("match_"), F.get(names, F.col("__level"))))
    return out.select("ann_id", status.alias("status"), F.get(names, F.col("__level")).alias("level"), F.col("__local").alias("local_id"), "n_candidates")


def local_status(matches: DataFrame, local: DataFrame) -> DataFrame:
    """``local_id, status``: matched, ambiguous (claimed more than once) or unmatched."""
    claimed = matches.where("local_id is not null").groupBy("local_id").agg(F.count("*").alias("__n"))
    status = F.when(F.col("__n") > 1, "ambiguous").when(F.col("__n") == 1, "matched").otherwise("unmatched")
    return local.select("local_id").join(claimed, "local_id", "left").select("local_id", status.alias("status"))


def lookup(df: DataFrame, mapping: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the ``columns`` of the row of ``mapping`` that has its key; nulls where there is none."""
    own = mapping.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), *columns)
    return df.drop(*columns).join(own, F.col(key) == F.col("__k"), "left").drop("__k")


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("candidates"))


def flag_member(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean: whether ``key`` occurs in ``members``."""
    seen = members.select(F.col(key).alias("__k")).where("__k is not null").distinct().withColumn("__m", F.lit(True))
    return df.join(seen, F.col(key) == F.col("__k"), "left").withColumn(flag, F.coalesce("__m", F.lit(False))).drop("__k", "__m")


def pick_one(df: DataFrame, condition) -> DataFrame:
    """The only row that meets ``condition``; the query fails if there are none or several."""
    w = Window.partitionBy(F.lit(1))
    found = df.where(condition).limit(2).withColumn("__n", F.count("*").over(w))
    return found.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))).drop("__n")
