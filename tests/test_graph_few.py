"""Components of few links, by one task, and of many, by rounds."""

from __future__ import annotations

import random

from stridelake.operators import graph
from stridelake.operators.scratch import Scratch


def test_few_links_start_no_rounds_and_give_what_rounds_give(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(200)] + [(3, 3), (None, 4)]
    for kind, as_ in (("bigint", lambda k: k), ("string", lambda k: None if k is None else f"k{k}")):
        edges = spark.createDataFrame([(as_(a), as_(b)) for a, b in links], f"a {kind}, b {kind}")
        found = []
        for few in (graph.FEW, 0):
            monkeypatch.setattr(graph, "FEW", few)
            scratch, written = Scratch(spark, "few"), []
            keep = scratch.keep
            monkeypatch.setattr(scratch, "keep", lambda df, name: written.append(name) or keep(df, name))
            found.append(sorted(map(tuple, graph.connected_components(edges, scratch).collect())))
            assert (len(written) == 2) == (few > 0)
            monkeypatch.undo()
        assert found[0] == found[1] and len(found[0]) > 300
        assert graph.connected_components(edges.limit(0), Scratch(spark, "few")).count() == 0
