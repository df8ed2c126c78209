import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph
from stratagraph.operators.relational import QueryError


def edges(spark, pairs):
    return spark.createDataFrame([(f"{a}{b}", a, b, "core:call", "confirmed") for a, b in pairs], "edge_id string, src string, dst string, kind string, classification string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_cycle_outbound_and_inbound(spark):
    e = edges(spark, ["ab", "bc", "ca"])
    assert {r.id for r in graph.expand(e, nodes(spark, "a"), min_depth=1, max_depth=2).collect()} == {"b", "c"}
    assert {r.id for r in graph.expand(e, nodes(spark, "b"), direction="inbound").collect()} == {"a"}


def test_diamond_has_two_shortest_paths(spark):
    e = edges(spark, ["ab", "bd", "ac", "cd"])
    assert {r.path for r in graph.shortest_paths(e, "a", "d", 3).collect()} == {"a>b>d", "a>c>d"}
    assert [r.path for r in graph.shortest_paths(e, "a", "d", 3, all_shortest=False).collect()] == ["a>b>d"]
    assert graph.shortest_paths(e, "a", "a", 3).count() == 0


def test_budget_is_checked(spark):
    with pytest.raises(QueryError) as e:
        graph.expand(edges(spark, ["ab"]), nodes(spark, "a"), min_depth=2, max_depth=1)
    assert e.value.code == "core:budget_invalid"


def test_cycles_are_components(spark):
    e = edges(spark, ["ab", "ba", "bc", "cd", "de", "ec", "xy"])
    assert {(r.id, r.component) for r in graph.cycles(e).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")}


def test_long_ring_takes_few_jobs(spark):
    names = [f"n{k:03}" for k in range(40)]
    pairs = [(a, b) for k, a in enumerate(names) for b in (names[k - 1], names[k - 3])] + [("x", "n000"), ("y", "y"), ("x", None)]
    e = spark.createDataFrame([(f"{a}{b}", a, b, "core:call", "confirmed") for a, b in pairs], "edge_id string, src string, dst string, kind string, classification string")
    spark.sparkContext.setJobGroup("ring", "")
    found = {(r.id, r.component) for r in graph.cycles(e).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ring")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(n, "n000") for n in names} | {("y", "y")} and len(jobs) < 20


@pytest.mark.parametrize("most", [0, 5, 100])
def test_components_by_colours_and_at_once(spark, monkeypatch, most):
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(20)})
    reach = set(pairs)
    for k in {x for p in pairs for x in p}:
        reach |= {(a, b) for a, c in reach if c == k for d, b in reach if d == k}
    want = {(a, min([a] + [b for b in {y for _, y in pairs} if (a, b) in reach and (b, a) in reach])) for a, c in reach if a == c}
    e = spark.createDataFrame([(f"{a}{b}", a, b, "core:call", "confirmed") for a, b in pairs], "edge_id string, src string, dst string, kind string, classification string")
    monkeypatch.setattr(graph, "ONE_TASK", most)
    assert {(r.id, r.component) for r in graph.cycles(e).collect()} == want


def test_confidence_is_best_of_weakest(spark):
    links = spark.createDataFrame([("s", 1, "high"), ("s", 1, "low"), ("s", 2, "medium"), ("s", 2, "medium")], "subject string, chain int, confidence string")
    assert [tuple(r) for r in graph.chain_confidence(links).collect()] == [("s", "medium")]


def test_order_of_rows_does_not_matter(spark):
    e = edges(spark, ["ab", "ac", "bd", "cd", "de"])
    one = sorted(map(tuple, graph.expand(e, nodes(spark, "a"), max_depth=3).collect()))
    assert one == sorted(map(tuple, graph.expand(e.repartition(7, F.rand(1)), nodes(spark, "a"), max_depth=3).collect()))


def test_chained_rings_beyond_one_task_take_few_jobs(spark, monkeypatch):
    """Rings of seven, each tied to the next, some of them back: no rounds of colouring along the chain."""
    rings, tied = 60, {3, 4, 5, 20, 41}
    pairs = [(f"n{7 * r + k:04}", f"n{7 * r + (k + 1) % 7:04}") for r in range(rings) for k in range(7)]
    pairs += [(f"n{7 * r:04}", f"n{7 * r + 7:04}") for r in range(rings - 1)] + [(f"n{7 * r + 7:04}", f"n{7 * r:04}") for r in tied] + [("z", "z")]
    first = {}
    for r in range(rings):
        first[r] = first[r - 1] if r - 1 in tied else f"n{7 * r:04}"
    e = spark.createDataFrame([(f"{a}{b}", a, b, "core:call", "confirmed") for a, b in pairs], "edge_id string, src string, dst string, kind string, classification string")
    monkeypatch.setattr(graph, "ONE_TASK", 150)
    spark.sparkContext.setJobGroup("rings", "")
    found = {(r.id, r.component) for r in graph.cycles(e).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rings")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(f"n{7 * r + k:04}", first[r]) for r in range(rings) for k in range(7)} | {("z", "z")}
    assert len(jobs) < 100


def test_large_edges_are_not_shuffled_for_few_nodes(spark):
    """Neither an expansion nor all shortest paths deal the edges out: what is shuffled is what was reached."""
    names = [f"n{k:05}" for k in range(4000)]
    rows = [(a, b) for k, a in enumerate(names) for b in names[k + 1 : k + 4]] + [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "t"), ("d", "t"), ("c", "s"), ("s", "n00000"), ("n00003", "t")]
    e = edges(spark, rows * 2).cache()
    e.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    paths = graph.shortest_paths(e, "s", "t", 4)
    assert sorted(map(tuple, paths.collect())) == [("s>a>c>t", 3), ("s>b>c>t", 3), ("s>b>d>t", 3), ("s>n00000>n00003>t", 3)]
    assert {r.id: r.depth for r in graph.expand(e, nodes(spark, "t"), direction="inbound", min_depth=1, max_depth=2).collect()} == {"c": 1, "d": 1, "n00003": 1, "a": 2, "b": 2, "n00000": 2, "n00001": 2, "n00002": 2}
    assert written() - before < 60_000
    assert graph.shortest_paths(e, "s", "t", 2).count() == 0 and graph.shortest_paths(e, "t", "s", 9).count() == 0
