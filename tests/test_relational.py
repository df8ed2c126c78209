import pytest
from pyspark.sql import functions as F

from stratagraph.functions import UnsafePattern, glob_regex, safe_regex
from stratagraph.operators import paging, relational, semantic, temporal, text
from stratagraph.operators.relational import QueryError
from stratagraph.plans import pipeline


def test_half_open_visibility(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("b", 3, None), ("c", 2, 2)], "id string, valid_from long, valid_to long")
    assert {g: sorted(r.id for r in rows.where(relational.visible(g)).collect()) for g in (0, 1, 2, 3)} == {0: [], 1: ["a"], 2: ["a"], 3: ["b"]}


def test_globs():
    import re

    hits = [p for p in ("src/a.ts", "src/x/a.ts", "src/a.tsx", "a.ts") if re.match(glob_regex("src/**/*.ts"), p)]
    assert hits == ["src/a.ts", "src/x/a.ts"]


def test_predicates_are_checked():
    for bad in ({}, {"any": []}, {"kind": []}, {"kind": ["a"], "facet": ["b"]}, {"colour": ["red"]}):
        with pytest.raises(QueryError):
            relational.predicate(bad)


def test_union_prefers_confirmed(spark):
    a, b = (spark.createDataFrame([("s", c)], "subject_id string, classification string") for c in ("possible", "confirmed"))
    assert [tuple(r) for r in relational.set_union({"x": a, "y": b}).collect()] == [("s", "confirmed", "x,y")]


def test_portable_dedup_needs_possible(spark):
    with pytest.raises(QueryError):
        relational.deduplicate(spark.range(1), "portable_key", order=[])


def test_overlapping_literal(spark):
    docs = spark.createDataFrame([("d", "aaaa"), ("e", "b")], "artifact_id string, text string")
    assert [r.start_char for r in text.literal_hits(docs, "aa").orderBy("start_char").collect()] == [0, 2]


def test_unsafe_patterns():
    for p in ("(?=a)", r"(a)\1", "a" * 1025):
        with pytest.raises(UnsafePattern):
            safe_regex(p)


def test_snippet_budget_equals_loop(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((5, 9, 0, 7, 4))], "i int, text string")
    got = [len(r.snippet) for r in text.snippet_budget(docs, order=[docs.i], per_snippet=6, total=15).orderBy("i").collect()]
    left, want = 15, []
    for n in (5, 9, 0, 7, 4):
        want.append(min(n, 6, left))
        left -= want[-1]
    assert got == want


def test_fusion_ties_by_id_and_bad_lanes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("x", 2), ("y", 1)], "id string, rank int")
    assert {r.score for r in semantic.fuse({"a": (a, 1.0), "b": (b, 1.0)}).collect()} == {1.5}
    with pytest.raises(QueryError):
        semantic.check_lane(spark.createDataFrame([("x", 0)], "id string, rank int"))


def test_zero_and_odd_vectors_are_left_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in semantic.vector_topk(rows, [1.0, 1.0], 9).collect()] == [1]


def test_revert_makes_three_versions(spark):
    obs = spark.createDataFrame([("k", i, c) for i, c in enumerate("AABA")], "key string, t int, c string")
    got = temporal.versions(obs, "key", [obs.t], obs.c).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.content) for r in got] == [(1, 3, "A"), (3, 4, "B"), (4, None, "A")]


def test_incremental_equals_rebuild(spark):
    empty = spark.createDataFrame([], "key string, content string, valid_from long, valid_to long")
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, content string")
    two = spark.createDataFrame([("a", "2"), ("c", "1")], "key string, content string")
    after = temporal.merge(temporal.merge(empty, one, 1, complete=True), two, 2, complete=True)
    assert sorted((r.key, r.content) for r in after.where(relational.visible(2)).collect()) == [("a", "2"), ("c", "1")]
    partial = temporal.merge(temporal.merge(empty, one, 1, complete=True), two, 2, complete=False)
    assert sorted(r.key for r in partial.where(relational.visible(2)).collect()) == ["a", "b", "c"]


def test_pages_and_cursors(spark):
    rows = paging.manifest(spark.range(20), [F.desc("id")])
    assert [r.id for r in paging.page(rows, after=4, limit=3).collect()] == [14, 13, 12]
    assert [r.ordinal for r in paging.page(rows, before=5, limit=3).collect()] == [2, 3, 4]
    token = paging.sign({"expires": 10, "stream": "s"}, b"k")
    assert paging.check(token, b"k", {"stream": "s"}, now=1)["stream"] == "s"
    for bad, code in ((dict(now=11, expected={}), "core:cursor_expired"), (dict(now=1, expected={"stream": "t"}), "core:cursor_stream_mismatch")):
        with pytest.raises(QueryError) as e:
            paging.check(token, b"k", bad["expected"], now=bad["now"])
        assert e.value.code == code
    with pytest.raises(QueryError):
        paging.check(token[:-2] + "xx", b"k", {}, now=1)


def test_pipelines_are_validated():
    one = {"id": "a", "operator": "source.operation", "operation": "core:find_artifacts"}
    with pytest.raises(QueryError) as e:
        pipeline.validate([one, {"id": "b", "operator": "filter", "inputs": [{"stage_id": "zz", "output": "x"}]}], {"o": {"stage_id": "b", "output": "x"}})
    assert e.value.code == "core:stage_reference_invalid"
    with pytest.raises(QueryError):
        pipeline.validate([one, dict(one, id="b")], {"o": {"stage_id": "a", "output": "artifacts"}})
    assert pipeline.normalize({"q": 1})["plan_digest"] == pipeline.normalize({"q": 1, "require_complete": False})["plan_digest"]


def test_arguments_that_are_not_applied_are_refused():
    from stratagraph.plans import operations

    for name, arguments in operations.NOT_APPLIED.items():
        _, required, allowed = operations.OPERATIONS[name]
        assert arguments <= allowed
        for argument in arguments:
            with pytest.raises(relational.QueryError, match="core:required_capability_unsupported"):
                operations.evaluate(None, name, dict.fromkeys(required, "x") | {argument: True})


def _plans_shuffle(df):
    """Expressions by which the plan deals rows out."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" +-:").startswith(("Aggregate", "Deduplicate"))]


def test_pairs_by_a_key_are_made_once_and_not_shuffled(spark):
    """Subjects that share several keys, nulls and repeated rows."""
    left = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("c", None), ("d", "z"), (None, "x")], "subject_id string, artifact_id string")
    right = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "y"), ("q", "y"), ("r", None), ("s", "w"), (None, "x")], "subject_id string, artifact_id string")
    pairs = relational.join(left, right, "same_artifact", "pairs")
    want = {("a", "p"), ("a", "q"), ("a", None), ("b", "p"), ("b", "q"), (None, "p"), (None, None)}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(want) and set(found) == want
    assert not any("left_id" in x and "right_id" in x for x in _plans_shuffle(pairs))
    grouped = relational.join(left, right, "same_artifact", "grouped")
    assert sorted(map(tuple, grouped.collect()), key=str) == sorted([("a", "p,q"), ("b", "p,q"), (None, "p")], key=str)
    assert not any("left_id" in x and "right_id" in x for x in _plans_shuffle(grouped))


def test_hash_buckets_are_those_of_each_token_without_a_shuffle_of_tokens(spark):
    import math

    docs = spark.createDataFrame([("a", "HTTPServer2go $x_y fooBar fooBar été"), ("b", None), ("c", ""), ("d", "x"), ("e", "one two"), ("e", "two"), ("f", "_ $")], "id string, text string")
    found = semantic.hash_buckets(docs, "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan
    tf = docs.select("id", F.explode(semantic.hash_tokens(F.col("text"))).alias("t")).groupBy("id", "t").count()
    want = {}
    for r in tf.select("id", "count", semantic.fnv(F.col("t"), semantic.FNV_OFFSET).alias("h"), semantic.fnv(F.col("t"), semantic.SIGN_OFFSET).alias("s")).collect():
        at = r.id, r.h % 256
        want[at] = want.get(at, 0) + (1 if r.s % 2 == 0 else -1) * (1 + math.log(r["count"]))
    want = {k: v for k, v in want.items() if abs(v) > 1e-12}
    assert {(r.id, r.bucket): r.value for r in found.collect()} == pytest.approx(want)
    for r in semantic.hash_embedding(docs, "id", "text").collect():
        own = {b: v for (i, b), v in want.items() if i == r.id}
        norm = math.sqrt(sum(v * v for v in own.values()))
        assert r.embedding == pytest.approx([own.get(b, 0) / norm for b in range(256)])
