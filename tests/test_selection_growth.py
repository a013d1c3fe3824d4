"""What a selection reads of its frozen inputs, and what it sends."""

from __future__ import annotations

import pytest

from stridelake.operators import selection
from stridelake.operators.scratch import Scratch
from stridelake.session import shuffled_joins
from stridelake.sources import files
from tests.test_selection import RULES, given


def test_frozen_files_are_read_once_each_and_contents_stay_where_they_are(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"in{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"in{k % 2}" / f"f{k}.txt").write_text(f"content {k}")
    roots = [str(tmp_path / "in0"), str(tmp_path / "in1")]
    assert "Exchange" not in files.file_digests(spark, roots)._jdf.queryExecution().executedPlan().toString()
    tree = files.digest_tree(spark, roots)
    assert not [f for f in tree.inputFiles() if str(tmp_path) in f]  # each level of the tree read all files before
    assert tree.where("level = 0").count() == 1 and tree.where("node like '%.txt'").count() == 9
    run = selection.Run(spark, "test", tuple(roots))
    run.finish()
    (tmp_path / "in1" / "f3.txt").write_text("other")
    (tmp_path / "in0" / "f4.txt").unlink()
    with pytest.raises(RuntimeError, match="in0/f4.txt.*in1/f3.txt"):
        run.finish()


def test_a_selection_sends_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    keep, plans = Scratch.keep, {}

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", seen)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    motions = [(i, 10 - i, False) for i in range(1, 4)]
    inputs = given(spark, motions, [(i, i, "train") for i in range(1, 4)], [(i, "walk", 0.0, 4.0) for i in range(1, 4)], {i: (False, 0.02, i) for i in range(1, 4)})
    selection.select(selection.Run(spark, "test"), inputs, RULES)
    assert {"match", "frames", "metrics", "dedup", "policy"} <= set(plans) and "Join" in plans["match"]
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]
    assert spark.conf.get(limit) == before
    with pytest.raises(ValueError), shuffled_joins(spark):
        assert spark.conf.get(limit) == "-1"
        raise ValueError
    assert spark.conf.get(limit) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
