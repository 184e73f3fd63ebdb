"""Closures: right for any graph, and what is written between steps follows the edges, not the pairs."""

import random

from ashlar.operators import graph


def _brute(edges):
    out = {}
    for start in {a for a, _ in edges}:
        depth, here, seen = 0, {start}, {start}
        while here:
            depth += 1
            here = {b for a, b in edges if a in here} - seen
            seen |= here
            out |= {(start, b): depth for b in here}
    return sorted((a, b, d) for (a, b), d in out.items())


def test_cycles_chains_and_several_parents(spark):
    rnd = random.Random(5)
    edges = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(40)} | {(f"c{i}", f"c{i + 1}") for i in range(5)} | {(f"leaf{i}", f"n{i % 30}") for i in range(100)} | {("leaf1", "c0"), ("leaf1", "c3"), ("leaf2", "leaf2")}
    got = graph.reach(spark.createDataFrame(sorted(edges), "src string, dst string"))
    assert sorted(map(tuple, got.collect())) == _brute(edges)


def test_pairs_of_leaves_are_not_written(spark, monkeypatch):
    edges = [(f"leaf{i}", f"low{i % 5}") for i in range(1000)] + [(f"low{i}", "c0") for i in range(5)] + [(f"c{i}", f"c{i + 1}") for i in range(8)]
    rows = []
    plain = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: (t := plain(df), rows.append(t.count()))[0])
    assert graph.reach(spark.createDataFrame(edges, "src string, dst string")).count() == 1000 * 10 + 5 * 9 + 36
    assert sum(rows) < 2 * len(edges)
