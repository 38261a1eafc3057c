import random

import pytest

from passagemill.llm.components import Workspace, components, labelled, renamed


def brute(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {x: top(x) for x in root}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(None, 3), (3, None), (7, 7)] + [(1, 2)] * 3
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(table).collect()} == brute(edges)
    for few in (0, 100):  # all rounds distributed, or but the last
        with Workspace(spark) as work:
            got = labelled(table, work, task_edges=few).collect()
        assert {r["node"]: r["component"] for r in got} == brute(edges)


@pytest.mark.parametrize("few", [0, 1000])
def test_other_types_of_nodes(spark, few):
    edges = [("b", "a"), ("c", "b"), ("y", "x"), ("z", None)]
    with Workspace(spark) as work:
        got = labelled(spark.createDataFrame(edges, "a string, b string").selectExpr("cast(a as binary) as a", "cast(b as binary) as b"), work, task_edges=few).collect()
    assert {bytes(r["node"]).decode(): bytes(r["component"]).decode() for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_workspaces_leave_nothing(spark, tmp_path):
    with Workspace(spark) as work:
        work.saved(spark.range(3))
        path = work.paths[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_names_that_clash():
    assert renamed(["id", "n", "n_input"], ("n", "m")) == ["id", "n_input_input", "n_input"]


def test_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
