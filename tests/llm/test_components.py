"""Connected components against a plain union, and what their rounds write."""

import random

from tarmac.llm import components as c


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root if find(x) != x)


def test_rounds_write_a_file_for_few_edges(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        few = c.components(table)
        monkeypatch.setattr(c, "TASK_EDGES", 90)
        more = c.components(table)
        monkeypatch.setattr(c, "TASK_EDGES", 1)
        most = c.components(table)
    finally:
        spark.conf.unset(key)
    for found in (few, more, most):
        assert sorted(map(tuple, found.collect())) == plain(edges)
    assert len(few.inputFiles()) == 1 < len(more.inputFiles()) < len(most.inputFiles())
