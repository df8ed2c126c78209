import hashlib
import math
import re
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph, maintenance, relational, semantic, text
from stratagraph.operators.relational import QueryError
from stratagraph.plans import operations


def fnv(data, h):
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def test_hash_embedding_equals_a_plain_loop(spark):
    texts = ["parseHtml XMLHttpRequest my_Var2 $x", "the the cat", "!!", None]
    got = {r.id: r.embedding for r in semantic.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert set(got) == {0, 1}
    for i, t in enumerate(texts[:2]):
        tf = {}
        for full in re.findall(r"[A-Za-z0-9_$]+", t):
            parts = re.findall(r"[0-9]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+", full)
            for token in (full, *parts):
                tf[token.lower()] = tf.get(token.lower(), 0) + 1
        assert i or {"parsehtml", "parse", "html", "xml", "http", "request", "my_var2", "var", "2", "$x", "x"} <= set(tf)
        v = [0.0] * 256
        for token, n in tf.items():
            v[fnv(token.encode(), 0x811C9DC5) % 256] += (1 if fnv(token.encode(), 0x811C9DC5 ^ 0x9E3779B9) % 2 == 0 else -1) * (1 + math.log(n))
        norm = math.sqrt(sum(x * x for x in v))
        assert np.allclose(got[i], [x / norm for x in v])
    assert fnv(b"a", 0x811C9DC5) == 0xE40C292C  # the published test vector of FNV-1a


def strong(edges):
    """Components of nodes on cycles, by reachability."""
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {u: reach(u) for u in out}
    return {u: min(w for w in far[u] if u in far.get(w, ())) for u in out if u in far[u]}


def test_cycles_equal_reachability(spark):
    rng = np.random.default_rng(4)
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 60, (75, 2)).tolist()} | {("n03", "n03"), ("z1", "z2"), ("z2", "z1"), ("z2", "n00")}
    edges = spark.createDataFrame([(u, v, "k", "confirmed", f"{u}>{v}") for u, v in sorted(pairs)], "src string, dst string, kind string, classification string, edge_id string")
    assert {r.id: r.component for r in graph.cycles(edges).collect()} == strong(pairs)
    assert graph.cycles(edges.limit(0)).count() == 0


def test_paths_beyond_the_budget_are_refused(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(6) for j in range(6) if i != j]
    edges = spark.createDataFrame([(u, v, "k", "confirmed", f"{u}>{v}") for u, v in pairs], "src string, dst string, kind string, classification string, edge_id string")
    roots = spark.createDataFrame([("a0",)], "id string")
    assert graph.simple_paths(edges, roots, 3).count() == 5 + 20 + 60
    with pytest.raises(QueryError):
        graph.simple_paths(edges, roots, 3, most=50)


def test_execution_order_and_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    depends = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "gone")], "id string, on string")
    assert {r.id: r.level for r in maintenance.execution_levels(nodes, depends).collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    with pytest.raises(QueryError):
        maintenance.execution_levels(nodes, depends.union(spark.createDataFrame([("c", "a")], depends.schema)))


def test_publications_are_whole_and_ordered(spark, tmp_path):
    root = str(tmp_path / "store")
    assert maintenance.current(spark, root) is None
    maintenance.publish({"records": spark.range(3)}, root, 1)
    first = maintenance.published(spark, root, "records")
    maintenance.publish({"records": spark.range(5), "edges": spark.range(1)}, root, 2)
    assert (first.count(), maintenance.published(spark, root, "records").count()) == (3, 5)  # an open snapshot stays readable
    with pytest.raises(QueryError):
        maintenance.publish({"records": spark.range(9)}, root, 2)
    with pytest.raises(QueryError):
        maintenance.published(spark, root, "absent")
    assert maintenance.next_generation(3, 5, 1) == 6 and maintenance.next_generation(3, 5, 0) == 5
    assert [maintenance.marker(1, 1), maintenance.marker(1, 2), maintenance.marker(1, 1, 3)] == ["published", "stale", "withheld"]


def test_shards_give_their_floats(spark):
    values = [[1.0, -2.5, 0.0, 3.0e-5], [7.25, 1e10, -0.1, 4.0]]
    shards = spark.createDataFrame([(0, bytearray(b"".join(struct.pack("<4f", *v) for v in values)))], "shard long, data binary")
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 16), (3, 0, 24)], "vec_id long, shard long, offset int")
    got = {r.vec_id: r.embedding for r in maintenance.shard_vectors(rows, shards, 4).collect()}
    assert np.allclose(got[1], values[0]) and np.allclose(got[2], values[1]) and got[3] is None


def test_order_keys_and_probe(spark):
    rows = spark.createDataFrame([("b", None), ("a", 2.0), ("c", 1.0)], "id string, x double")
    order = lambda absent: [r.id for r in rows.orderBy(*maintenance.sort_keys(rows, [{"column": "x", "mode": "float64", "absent": absent}], "id")).collect()]
    assert order("first") == ["b", "c", "a"] and order("last") == ["c", "a", "b"]
    with pytest.raises(QueryError):
        order("forbidden")
    assert maintenance.overflow_probe(rows, 2) and not maintenance.overflow_probe(rows, 3)


def test_rationals(spark):
    rows = spark.createDataFrame([(6, -4), (0, 5), (7, 0), (9, 3)], "a long, b long")
    assert [tuple(r.r) if r.r else None for r in rows.select(maintenance.rational(F.col("a"), F.col("b")).alias("r")).collect()] == [(-3, 2), (0, 1), None, (3, 1)]


def test_trigrams_and_prefilter(spark):
    docs = [("a", "The Straße naïve"), ("b", "ﬁle THE"), ("c", ""), ("d", None), ("e", "thé end")]
    artifacts = spark.createDataFrame(docs, "artifact_id string, text string")
    index = text.trigram_index(artifacts)
    import unicodedata

    for i, t in docs:
        b = unicodedata.normalize("NFKC", t or "").lower().encode()
        assert sorted(r.trigram for r in index.where(F.col("artifact_id") == i).collect()) == sorted({b[k : k + 3].hex() for k in range(len(b) - 2)})
    for literal in ("The", "the", "file", "e", "Straße", "THE", "the end"):
        want = sorted(i for i, t in docs if t and literal in t)
        assert sorted({r.artifact_id for r in text.literal_hits(artifacts, literal, index=index).collect()}) == want


def test_null_facets_and_kinds_stay_under_not(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", ["f"], "generated")], "id string, facets array<string>, artifact_kind string")
    assert [r.id for r in rows.where(relational.predicate({"not": {"facet": ["f"]}})).collect()] == ["a"]
    assert [r.id for r in rows.where(relational.structural_filter()).collect()] == ["a"]


def test_snapshots_and_scopes(spark):
    schema = "record_id string, category string, kind string, universal_kind string, name string, identity_key string, parent_id string, facets array<string>, valid_from long, valid_to long"
    rows = [("r1", "entity", "k", "u", "x", "k:x", "p", ["core:exported"], 0, 5), ("r2", "entity", "k", "u", "x", "k:y", "q", [], 0, None)]
    records = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([], "edge_id string, src string, dst string, kind string, classification string")
    at = lambda g, **a: operations.evaluate(operations.Corpus(records, edges, records, generation=g), "core:resolve_symbol", {"reference": "x", **a})
    assert [r.record_id for r in at(7)["declarations"].collect()] == ["r2"] and at(3)["candidates"].count() == 2
    assert [r.record_id for r in at(3, context_artifact="p")["declarations"].collect()] == ["r1"]
    assert [r.record_id for r in at(3, scope="exports")["declarations"].collect()] == ["r1"]
    assert at(3, context_artifact="nowhere")["candidates"].count() == 2


def test_blobs_are_verified_and_repaired(spark):
    row = lambda data, name=None: (hashlib.sha256(name or data).hexdigest(), len(data), bytearray(data))
    schema = "content_hash string, byte_length long, content binary"
    blobs = spark.createDataFrame([row(b"one"), row(b"bad", b"two")], schema)
    assert [r.content_hash for r in maintenance.verify_blobs(blobs).collect()] == [hashlib.sha256(b"two").hexdigest()]
    whole = maintenance.repair_blobs(blobs, spark.createDataFrame([row(b"two"), row(b"one")], schema))
    assert whole.count() == 2 and maintenance.verify_blobs(whole).count() == 0


def test_manifests_are_written_once_and_read_by_ordinal(spark, tmp_path):
    from stratagraph.operators import paging

    rows = spark.createDataFrame([(f"k{i * 37 % 101:03}",) for i in range(101)], "k string")
    at = str(tmp_path / "manifest")
    paging.write_manifest(rows, [F.col("k")], at)
    stored = paging.open_manifest(spark, at)
    assert [(r.k, r.ordinal) for r in paging.page(stored, after=9, limit=3).collect()] == [(f"k{i:03}", i) for i in (10, 11, 12)]
    assert [r.ordinal for r in paging.page(stored, before=3, limit=5).collect()] == [0, 1, 2]
    assert "PushedFilters: [IsNotNull(ordinal), GreaterThanOrEqual(ordinal" in paging.page(stored, after=9, limit=3)._jdf.queryExecution().toString()


def test_sources_are_stable_or_refused(spark, tmp_path):
    from stratagraph import sources

    for name, data in (("a.txt", b"one"), ("sub/b.bin", b"\x00x"), ("sub/c.txt", b"one")):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(data)
    files = sources.directory(spark, str(tmp_path / "src"))
    assert {r.path.rpartition("/")[2]: r.is_binary for r in files.collect()} == {"a.txt": False, "b.bin": True, "c.txt": False}
    seen = spark.createDataFrame(files.select("uri", "content_hash").collect())
    assert sources.stable_read(seen, files).count() == 3
    with pytest.raises(sources.SourceChanged):
        sources.stable_read(seen.withColumn("content_hash", F.lit("0" * 64)), files)
    with pytest.raises(sources.SourceChanged):
        sources.stable_read(seen, files.where("not is_binary"))
    store = str(tmp_path / "blobs")
    sources.write_blobs(files, store)
    sources.write_blobs(files, store)
    assert spark.read.parquet(store).count() == 2 and sources.read_blobs(spark, store, seen).count() == 2
    spark.createDataFrame([("f" * 64, 1, bytearray(b"z"))], "content_hash string, byte_length long, content binary").write.mode("append").parquet(store)
    with pytest.raises(Exception, match="blob_corrupt"):
        sources.read_blobs(spark, store, spark.createDataFrame([("f" * 64,)], "content_hash string")).collect()


def test_ignore_lines(spark):
    from stratagraph import sources

    paths = ["a.log", "x/b.log", "x/keep.log", "build/a.ts", "x/build/a.ts", "src/build.ts", "docs/a.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    lines = ["# notes", "", "*.log", "!keep.log", "/build/", "docs/*.md"]
    assert sorted(r.path for r in rows.where(sources.ignored(F.col("path"), lines)).collect()) == ["a.log", "build/a.ts", "docs/a.md", "x/b.log"]


def test_repair_counts_rows_not_hashes(spark, tmp_path):
    """Documents with the same text: damaged 37 and 74, of which one has a spare; 5 has the very bytes of 74's blob."""
    rows = [(37, "a"), (74, "a"), (111, "b"), (148, "c"), (5, "ax"), (6, "a"), (7, None), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from stratagraph import catalogue_store

    assert [tuple(r) for r in catalogue_store.repair_blobs(spark, str(tmp_path)).collect()] == [(4, 3, 0)]
    want = "SELECT count(*) AS blobs, count(DISTINCT sha256(CASE WHEN doc_id % 37 = 0 THEN text || 'x' ELSE text END)) AS contents FROM documents WHERE text IS NOT NULL AND (doc_id % 37 <> 0 OR doc_id % 74 = 0)"
    import duckdb

    at = duckdb.connect()
    at.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert at.execute(want).fetchall() == [(4, 3)]


def test_trigrams_of_long_texts_are_found_in_slices(monkeypatch):
    """Rows leave a worker by slices: a batch of many texts isn't held as windows at once, nor is one long text."""
    import pyarrow as pa

    monkeypatch.setattr(text, "SLICE", 50)
    texts = ["abcabd" * 3, None, "", "ab", "x" * 49 + "yz", "The Straße №1 " * 30, "q" * 30, "r" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(len(texts))]), pa.array(texts)], ["artifact_id", "text"])
    out = list(text._trigram_rows()(iter([batch])))
    found = [(r["artifact_id"], r["trigram"]) for b in out for r in b.to_pylist()]
    want = set()
    for k, t in enumerate(texts):
        b = unicodedata.normalize("NFKC", t or "").lower().encode()
        want |= {(f"d{k}", b[i : i + 3].hex()) for i in range(len(b) - 2)}
    assert len(found) == len(want) and set(found) == want
    assert len(out) > 3 and max(len(b) for b in out) <= 50
