"""What is worked out once, and what is counted before it is written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from stridelake.operators import metrics
from stridelake.operators.scratch import Scratch
from stridelake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_clusters_read_no_text_again(spark):
    assert not [f for f in catalogue.QUERIES["q17_cluster_keep"](spark, SF).inputFiles() if "documents" in f]


def test_equal_values_of_large_groups_are_counted_before_they_are_written(spark, monkeypatch):
    monkeypatch.setattr(metrics, "LARGE", 100)
    scratch, written = Scratch(spark, "quantiles"), {}
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: written.setdefault(name, keep(df, name)))
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7 / 10.0).alias("v"))
    got = {r.g: r for r in metrics.group_quantiles(df, ["g"], {"p": (F.col("v"), 0.95), "q": (F.col("v"), 0.5)}, scratch).collect()}
    assert written["values"].count() == 28
    want = {r.g: r for r in df.groupBy("g").agg(F.percentile("v", 0.95).alias("p"), F.percentile("v", 0.5).alias("q")).collect()}
    assert {g: (round(r.p, 9), round(r.q, 9)) for g, r in got.items()} == {g: (round(r.p, 9), round(r.q, 9)) for g, r in want.items()}
