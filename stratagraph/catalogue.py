"""Registered queries of the engine, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph import sources, streaming
from stratagraph.functions import name_tail
from stratagraph.operators import graph, paging, relational, semantic, temporal, text
from stratagraph.plans import operations, pipeline, recipes
from stratagraph.sources import ARTIFACTS_SQL, EDGES_SQL, RECORDS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
A = sources.artifacts
_WARM: dict[tuple, DataFrame] = {}


def _warm(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The bound table of a snapshot, kept for all queries of a session: a workspace holds these tables as
    files, so binding them anew for each query would measure the binding."""

    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__name__, d)
        if key not in _WARM:
            _WARM[key] = build(spark, d).persist()
        return _WARM[key]

    return get


R, E = _warm(sources.records), _warm(sources.edges)
G = 1998 * 12  # a generation: January 1998


def query(sql: str | None = None, records: bool = False, edges: bool = False, artifacts: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            with_ = [t for t, on in ((RECORDS_SQL, records), (EDGES_SQL, edges), (ARTIFACTS_SQL, artifacts)) if on]
            ORACLE[f.__name__] = (("WITH RECURSIVE " + ",".join(with_) + (" " if not sql.lstrip().startswith(",") else "")) if with_ else "") + sql
        return f

    return add


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("id"))


VISIBLE = f"valid_from <= {G} AND (valid_to IS NULL OR valid_to > {G})"

# ---------------------------------------------------------------- scans and filters


@query(f"SELECT kind, count(*) AS n FROM records WHERE {VISIBLE} GROUP BY kind", records=True)
def visible_snapshot(spark, d):
    return R(spark, d).where(relational.visible(G)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT record_id, name FROM records WHERE {VISIBLE} AND kind IN ('tpch:order', 'tpch:nation')", records=True)
def find_records_kind(spark, d):
    return relational.find_records(R(spark, d), generation=G, kinds=["tpch:order", "tpch:nation"]).select("record_id", "name")


@query("SELECT record_id FROM records WHERE list_has_all(facets, ['core:definition']) AND list_has_any(facets, ['segment:BUILDING', 'core:test']) AND NOT list_has_any(facets, ['core:exported'])", records=True)
def find_records_facets(spark, d):
    return relational.find_records(R(spark, d), all_facets=["core:definition"], any_facets=["segment:BUILDING", "core:test"], excluded_facets=["core:exported"]).select("record_id")


@query("SELECT artifact_id, path FROM artifacts WHERE regexp_full_match(path, 'src1[^/]*/en/[^/]*5\\.txt') AND language IN ('en', 'de') AND artifact_kind NOT LIKE '%generated%' AND artifact_kind NOT LIKE '%external%'", artifacts=True)
def find_artifacts_glob(spark, d):
    return A(spark, d).where(relational.structural_filter(paths=["src1*/en/*5.txt"], languages=["en", "de"])).select("artifact_id", "path")


@query("SELECT artifact_id FROM artifacts WHERE language IS NOT NULL AND path LIKE 'src3/%'", artifacts=True)
def path_prefix(spark, d):
    return A(spark, d).where(F.col("path").startswith("src3/")).select("artifact_id")


@query("SELECT record_id FROM records WHERE (kind = 'tpch:part' AND list_has_any(facets, ['brand:Brand#11', 'brand:Brand#12'])) OR (universal_kind = 'core:container' AND NOT kind = 'tpch:region')", records=True)
def predicate_tree(spark, d):
    tree = {"any": [{"all": [{"kind": ["tpch:part"]}, {"facet": ["brand:Brand#11", "brand:Brand#12"]}]}, {"all": [{"universal_kind": ["core:container"]}, {"not": {"kind": ["tpch:region"]}}]}]}
    return R(spark, d).where(relational.predicate(tree)).select("record_id")


@query("SELECT record_id, kind FROM records WHERE record_id IN ('nation:3', 'order:1', 'part:7') OR identity_key IN ('tpch:region:root:ASIA', 'tpch:region:root:EUROPE')", records=True)
def lookup_any_id(spark, d):
    return relational.lookup_any_id(R(spark, d), ["nation:3", "order:1", "part:7", "tpch:region:root:ASIA", "tpch:region:root:EUROPE"]).select("record_id", "kind")


@query("SELECT record_id, identity_key FROM records WHERE list_extract(string_split(identity_key, ':'), -1) = 'ASIA' OR list_extract(string_split(identity_key, ':'), -1) = '7'", records=True)
def lookup_name_tail(spark, d):
    r = R(spark, d)
    return relational.lookup_name_tail(r, "ASIA").union(relational.lookup_name_tail(r, "7")).select("record_id", "identity_key")


@query("SELECT artifact_id, CASE WHEN byte_length > 8000 THEN 'too_large' WHEN path LIKE 'src1/%' AND path LIKE '%5.txt' THEN 'kept' WHEN path LIKE 'src1/%' THEN 'excluded' ELSE 'included' END AS decision FROM artifacts", artifacts=True)
def inclusion_rules(spark, d):
    rules = [("src1/**", "excluded"), ("src1/**/*5.txt", "kept")]
    decision = F.when(F.col("byte_length") > 8000, "too_large").otherwise(sources.inclusion(F.col("path"), F.col("byte_length"), F.lit(False), rules))
    return A(spark, d).select("artifact_id", decision.alias("decision"))


@query("SELECT record_id, name FROM records WHERE kind = 'tpch:customer' ORDER BY record_id LIMIT 25", records=True)
def selector_scan(spark, d):
    return R(spark, d).where("kind = 'tpch:customer'").select("record_id", "name").orderBy("record_id").limit(25)


@query("SELECT content_hash, byte_length, count(*) AS copies FROM artifacts GROUP BY 1, 2 HAVING count(*) > 1", artifacts=True)
def content_dedupe(spark, d):
    return A(spark, d).groupBy("content_hash", "byte_length").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS state FROM events GROUP BY 1, 2")
def capability_latest(spark, d):
    return sources.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("state"))


# ---------------------------------------------------------------- sets and joins


def _subjects(spark, d, kind: str, direction: str = "dst") -> DataFrame:
    return E(spark, d).where(F.col("kind") == kind).select(F.col(direction).alias("subject_id"), "classification")


_SETS = "s1 AS (SELECT dst AS subject_id, classification FROM edges WHERE kind = 'core:call'), s2 AS (SELECT src AS subject_id, classification FROM edges WHERE kind = 'core:covers' AND classification = 'possible')"


@query(f", {_SETS}, u AS (SELECT *, 'a' AS f FROM s1 UNION ALL SELECT *, 'b' FROM s2) SELECT subject_id, CASE WHEN bool_or(classification = 'confirmed') THEN 'confirmed' ELSE 'possible' END AS classification, string_agg(DISTINCT f, ',' ORDER BY f) AS provenance FROM u GROUP BY 1", edges=True)
def set_union(spark, d):
    return relational.set_union({"a": _subjects(spark, d, "core:call"), "b": _subjects(spark, d, "core:covers", "src").where("classification = 'possible'")})


@query(f", {_SETS} SELECT subject_id, CASE WHEN bool_or(classification = 'confirmed') THEN 'confirmed' ELSE 'possible' END AS classification, 'a,b' AS provenance FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE subject_id IN (SELECT subject_id FROM s1) AND subject_id IN (SELECT subject_id FROM s2) GROUP BY 1", edges=True)
def set_intersection(spark, d):
    return relational.set_intersection({"a": _subjects(spark, d, "core:call"), "b": _subjects(spark, d, "core:covers", "src").where("classification = 'possible'")})


@query("SELECT record_id AS subject_id FROM records WHERE kind = 'tpch:part' AND record_id NOT IN (SELECT dst FROM edges WHERE kind = 'core:covers')", records=True, edges=True)
def set_difference(spark, d):
    return relational.set_difference(R(spark, d).where("kind = 'tpch:part'").select(F.col("record_id").alias("subject_id")), _subjects(spark, d, "core:covers"))


@query("SELECT dst AS subject_id, min(edge_id) AS edge_id FROM edges WHERE kind = 'core:references' GROUP BY dst", edges=True)
def dedup_subject(spark, d):
    rows = E(spark, d).where("kind = 'core:references'").select(F.col("dst").alias("subject_id"), "edge_id")
    return relational.deduplicate(rows, "subject_id", order=[F.col("edge_id")])


@query("SELECT content_hash AS portable_key, min(artifact_id) AS artifact_id FROM artifacts GROUP BY 1", artifacts=True)
def dedup_portable_key(spark, d):
    return relational.deduplicate(A(spark, d).select(F.col("content_hash").alias("portable_key"), "artifact_id"), "portable_key", order=[F.col("artifact_id")], include_possible=True)


_PAIR = "l AS (SELECT 'nation:' || c_nationkey AS k, 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 8000), r AS (SELECT 'nation:' || s_nationkey AS k, 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal > 5000)"


def _sides(spark, d):
    c, s = sources.table(spark, d, "customer").where("c_acctbal > 8000"), sources.table(spark, d, "supplier").where("s_acctbal > 5000")
    return c.select(F.concat(F.lit("customer:"), "c_custkey").alias("subject_id"), F.concat(F.lit("nation:"), "c_nationkey").alias("artifact_id")), s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("subject_id"), F.concat(F.lit("nation:"), "s_nationkey").alias("artifact_id"))


@query(f"WITH {_PAIR} SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r USING (k)")
def join_same_artifact(spark, d):
    return relational.join(*_sides(spark, d), "same_artifact", "pairs")


@query(f"WITH {_PAIR} SELECT id AS subject_id, k AS artifact_id FROM l WHERE k IN (SELECT k FROM r)")
def join_left(spark, d):
    return relational.join(*_sides(spark, d), "same_artifact", "left").select("subject_id", "artifact_id")


@query(f"WITH {_PAIR} SELECT id AS subject_id, k AS artifact_id FROM r WHERE k IN (SELECT k FROM l)")
def join_right(spark, d):
    return relational.join(*_sides(spark, d), "same_artifact", "right").select("subject_id", "artifact_id")


@query(f"WITH {_PAIR} SELECT l.id AS left_id, string_agg(DISTINCT r.id, ',' ORDER BY r.id) AS right_ids FROM l JOIN r USING (k) GROUP BY 1")
def join_grouped(spark, d):
    return relational.join(*_sides(spark, d), "same_artifact", "grouped")


@query("SELECT DISTINCT a.dst AS left_id, b.src AS right_id FROM edges a JOIN edges b ON a.dst = b.src WHERE a.kind = 'core:call' AND b.kind = 'core:covers' AND a.classification = 'possible'", edges=True)
def join_same_subject(spark, d):
    left, right = _subjects(spark, d, "core:call").where("classification = 'possible'"), _subjects(spark, d, "core:covers", "src")
    return relational.join(left, right, "same_subject", "pairs")


@query("SELECT src AS left_id, dst AS right_id FROM edges WHERE kind = 'core:contains' AND src IN ('nation:1', 'nation:2') AND dst LIKE 'supplier:%'", edges=True)
def join_relation_exists(spark, d):
    e = E(spark, d).where("kind = 'core:contains'")
    left = ids(spark, "nation:1", "nation:2").withColumnRenamed("id", "subject_id")
    return relational.join(left, R(spark, d).where("kind = 'tpch:supplier'").select(F.col("record_id").alias("subject_id")), "relation_exists", "pairs", edges=e, direction="both")


@query("SELECT record_id, name FROM records WHERE kind = 'tpch:nation' AND name LIKE 'A%' OR kind = 'tpch:nation' AND name NOT LIKE 'A%' AND record_id IN ('nation:6')", records=True)
def select_outputs(spark, d):
    nations = R(spark, d).where("kind = 'tpch:nation'")
    out = relational.select_outputs({"n": nations.where("name like 'A%'"), "m": nations.where("name not like 'A%'")}, [{"name": "x", "input": "n", "projection": ["record_id", "name"]}, {"name": "y", "input": "m", "projection": ["record_id", "name", "kind"], "filter": {"kind": ["tpch:nation"]}}])
    return out["x"].union(out["y"].where("record_id = 'nation:6'").select("record_id", "name"))


@query("SELECT e.edge_id, s.name AS source_name, t.name AS target_name FROM edges e JOIN records s ON s.record_id = e.src JOIN records t ON t.record_id = e.dst WHERE e.kind = 'core:contains'", records=True, edges=True)
def relation_endpoints(spark, d):
    e, r = E(spark, d).where("kind = 'core:contains'"), R(spark, d).select("record_id", "name")
    return e.join(r.toDF("src", "source_name"), "src").join(r.toDF("dst", "target_name"), "dst").select("edge_id", "source_name", "target_name")


@query("SELECT record_id FROM records WHERE kind = 'tpch:order' AND record_id NOT IN (SELECT src FROM edges WHERE kind = 'core:call')", records=True, edges=True)
def missing_documents(spark, d):
    return R(spark, d).where("kind = 'tpch:order'").join(E(spark, d).where("kind = 'core:call'").select(F.col("src").alias("record_id")), "record_id", "left_anti").select("record_id")


# ---------------------------------------------------------------- graph


@query("SELECT edge_id, src, classification FROM edges WHERE dst IN ('part:1', 'part:2', 'supplier:3') AND kind IN ('core:references', 'core:call')", edges=True)
def find_references(spark, d):
    return graph.references(E(spark, d), ids(spark, "part:1", "part:2", "supplier:3"), ("core:references", "core:call")).select("edge_id", "src", "classification")


@query("SELECT DISTINCT src AS id FROM edges WHERE dst IN ('part:1', 'part:2', 'supplier:3')", edges=True)
def owners(spark, d):
    return graph.owners(E(spark, d), ids(spark, "part:1", "part:2", "supplier:3"))


@query(", a AS (SELECT dst AS id FROM edges WHERE kind = 'core:contains' AND src = 'region:1'), b AS (SELECT DISTINCT dst AS id FROM edges JOIN a ON src = a.id WHERE kind = 'core:contains') SELECT id, CAST(1 AS INTEGER) AS depth FROM a UNION ALL SELECT id, 2 FROM b", edges=True)
def outline_depth2(spark, d):
    return graph.expand(E(spark, d), ids(spark, "region:1"), min_depth=1, max_depth=2, kinds=("core:contains",)).select("id", "depth")


_STEP = """, walk AS (SELECT id, 0 AS depth FROM (VALUES {roots}) t(id) UNION SELECT {to}, depth + 1 FROM walk JOIN {edges} ON {by} = walk.id WHERE depth < {most}),
first AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT id, CAST(depth AS INTEGER) AS depth FROM first WHERE depth > 0"""


@query(_STEP.format(roots="('customer:1'), ('customer:4')", to="dst", by="src", edges="edges", most=3), edges=True)
def expand_outbound(spark, d):
    return graph.expand(E(spark, d), ids(spark, "customer:1", "customer:4"), max_depth=3).select("id", "depth")


@query(_STEP.format(roots="('part:5')", to="src", by="dst", edges="edges", most=2), edges=True)
def expand_inbound(spark, d):
    return graph.expand(E(spark, d), ids(spark, "part:5"), direction="inbound", max_depth=2).select("id", "depth")


@query(", two AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)" + _STEP.format(roots="('supplier:2')", to="dst", by="src", edges="two", most=2), edges=True)
def expand_both(spark, d):
    return graph.expand(E(spark, d), ids(spark, "supplier:2"), direction="both", max_depth=2).select("id", "depth")


@query(", nodes AS (SELECT 'customer:4' AS id UNION SELECT dst FROM edges WHERE src = 'customer:4' UNION SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'customer:4') SELECT edge_id FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)", edges=True)
def induced_relations(spark, d):
    roots, e = ids(spark, "customer:4"), E(spark, d)
    return graph.induced(e, graph.expand(e, roots, min_depth=1, max_depth=2).select("id").union(roots)).select("edge_id")


@query(""", p AS (SELECT 'region:1' AS tail, 'region:1' AS path, 0 AS length UNION ALL SELECT e.dst, path || '>' || e.dst, length + 1 FROM p JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = p.tail WHERE length < 4)
SELECT path, CAST(length AS INTEGER) AS length FROM p WHERE tail = 'part:5' AND length = (SELECT min(length) FROM p WHERE tail = 'part:5')""", edges=True)
def shortest_paths_all(spark, d):
    return graph.shortest_paths(E(spark, d), "region:1", "part:5", 4)


@query(", c AS (SELECT a.src AS root, a.src || '>' || a.dst AS path, 1 AS length, a.dst AS tail FROM edges a WHERE a.src IN ('nation:1') AND kind = 'core:contains') SELECT root, path, CAST(length AS INTEGER) AS length FROM c UNION ALL SELECT c.root, c.path || '>' || e.dst, 2 FROM c JOIN edges e ON e.src = c.tail WHERE e.kind IN ('core:contains', 'core:defines') UNION ALL SELECT root, path, length FROM c WHERE false", edges=True)
def simple_paths(spark, d):
    e = E(spark, d).where("kind = 'core:contains' or kind = 'core:defines'")
    return graph.simple_paths(e, ids(spark, "nation:1"), 2)


@query(", anc AS (SELECT 'part:5' AS id UNION SELECT src FROM anc JOIN edges ON dst = anc.id AND kind IN ('core:contains', 'core:defines')) SELECT DISTINCT src AS id FROM edges WHERE kind = 'core:covers' AND dst IN (SELECT id FROM anc)", edges=True)
def related_tests(spark, d):
    return graph.related_tests(E(spark, d), ids(spark, "part:5"))


@query("SELECT DISTINCT src AS id FROM edges WHERE dst = 'supplier:3' AND kind = 'core:call' AND classification = 'confirmed'", edges=True)
def impact_will_break(spark, d):
    return graph.impact(E(spark, d), ids(spark, "supplier:3"), include_transitive=False)["will_break"]


@query("SELECT 'uncertain_dynamic_usage' AS class, count(DISTINCT src) AS n FROM edges WHERE dst = 'supplier:3' AND kind IN ('core:call', 'core:references') AND classification = 'possible' UNION ALL SELECT 'tests_to_run', count(DISTINCT src) FROM edges WHERE kind = 'core:covers' AND dst = 'supplier:3'", edges=True)
def impact_other_classes(spark, d):
    found = graph.impact(E(spark, d), ids(spark, "supplier:3"), include_transitive=False)
    return found["uncertain_dynamic_usage"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("uncertain_dynamic_usage").alias("class"), "n").union(graph.related_tests(E(spark, d), ids(spark, "supplier:3")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tests_to_run"), "n"))


@query(", walk AS (SELECT 'customer:7' AS id UNION SELECT dst FROM walk JOIN edges ON src = walk.id) SELECT id FROM walk WHERE id <> 'customer:7'", edges=True)
def dependency_closure(spark, d):
    return graph.closure(E(spark, d), ids(spark, "customer:7")).select("id")


_RING = """ring AS (SELECT 'p' || p_partkey AS u, 'p' || CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN p_partkey - p_partkey % 7 ELSE p_partkey + 1 END AS v FROM part),
more AS (SELECT u, v FROM ring UNION SELECT 'p' || p_partkey, 'p' || (p_partkey + 7) FROM part WHERE p_size <= 25 AND p_partkey + 7 <= (SELECT max(p_partkey) FROM part)
 UNION SELECT 'p' || p_partkey, 'p' || (p_partkey - 7) FROM part WHERE p_size <= 10 AND p_partkey > 7)"""


@query()
def cycles(spark, d):
    """Rings of seven over all parts, tied together by the parts' sizes: most of them one large component."""
    p = sources.table(spark, d, "part")
    most = p.agg(F.max("p_partkey")).first()[0]
    key = F.col("p_partkey")
    to = F.when(key % 7 == 6, key - 6).when(key == most, key - key % 7).otherwise(key + 1)
    ways = [p.select(key.alias("a"), to.alias("b")), p.where((F.col("p_size") <= 25) & (key + 7 <= most)).select(key.alias("a"), (key + 7).alias("b")), p.where((F.col("p_size") <= 10) & (key > 7)).select(key.alias("a"), (key - 7).alias("b"))]
    every = ways[0].union(ways[1]).union(ways[2]).distinct()
    return graph.cycles(every.select(F.concat(F.lit("p"), "a").alias("src"), F.concat(F.lit("p"), "b").alias("dst"), F.lit("core:import").alias("kind"), F.lit("confirmed").alias("classification"), F.concat_ws(">", "a", "b").alias("edge_id")))


@query("SELECT edge_id, dst FROM edges WHERE src = 'order:1'", edges=True)
def neighbors(spark, d):
    return graph.directed(E(spark, d), "outbound").where("u = 'order:1'").select("edge_id", F.col("v").alias("dst")).orderBy("edge_id")


@query("WITH l AS (SELECT l_partkey AS subject, l_orderkey AS chain, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS r FROM lineitem), c AS (SELECT subject, chain, min(r) AS r FROM l GROUP BY 1, 2) SELECT subject, CASE max(r) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence FROM c GROUP BY 1")
def confidence_minmax(spark, d):
    c = F.when(F.col("l_returnflag") == "R", "low").when(F.col("l_returnflag") == "A", "medium").otherwise("high")
    return graph.chain_confidence(sources.table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("chain"), c.alias("confidence")))


@query("SELECT record_id, 'entry_points' AS view FROM records WHERE universal_kind = 'core:container' UNION ALL SELECT record_id, 'public_surfaces' FROM records WHERE universal_kind = 'core:type' AND name NOT LIKE '\\_%' ESCAPE '\\'", records=True)
def inspect_architecture(spark, d):
    return operations.inspect_architecture(R(spark, d), E(spark, d), views=("entry_points", "public_surfaces"))


# ---------------------------------------------------------------- text


@query(
    """, h AS (SELECT artifact_id, hex(encode(lower(nfc_normalize(text)))) AS h FROM artifacts),
g AS (SELECT DISTINCT artifact_id, lower(unnest(list_concat(regexp_extract_all(h, '.{6}'), regexp_extract_all(substr(h, 3), '.{6}'), regexp_extract_all(substr(h, 5), '.{6}')))) AS trigram FROM h)
SELECT trigram, count(*) AS documents FROM g GROUP BY 1""",
    artifacts=True,
)
def trigram_index_stats(spark, d):
    return text.trigram_index(A(spark, d)).groupBy("trigram").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT artifact_id, CAST(len(string_split(text, 'License')) - 1 AS BIGINT) AS matches FROM artifacts WHERE contains(text, 'License')", artifacts=True)
def search_by_trigrams(spark, d):
    a = A(spark, d)
    corpus = operations.Corpus(R(spark, d), E(spark, d), a, trigrams=text.trigram_index(a))
    return operations.evaluate(corpus, "core:search_text", {"pattern": "License", "filter": {"include_external": True, "include_generated": True}})["matches"]


_HITS = """hits AS (SELECT artifact_id, text, generate_subscripts(p, 1) - 1 AS n, p FROM (SELECT artifact_id, text, string_split({text}, '{lit}') AS p FROM artifacts WHERE contains({text}, '{lit}'))),
found AS (SELECT artifact_id, text, n, CAST(len(array_to_string(list_slice(p, 1, n + 1), '')) + n * {len} AS BIGINT) AS start_char FROM hits WHERE n < len(p) - 1)"""


@query(", " + _HITS.format(text="text", lit="the ", len=4) + " SELECT artifact_id, CAST(n AS INTEGER) AS n, start_char FROM found", artifacts=True)
def search_literal(spark, d):
    return text.literal_hits(A(spark, d), "the ")


@query(", " + _HITS.format(text="lower(text)", lit="tion and", len=8) + " SELECT artifact_id, CAST(n AS INTEGER) AS n, start_char FROM found", artifacts=True)
def search_literal_ci(spark, d):
    return text.literal_hits(A(spark, d), "Tion And", case_sensitive=False)


@query(", " + _HITS.format(text="text", lit="ß", len=1) + " SELECT artifact_id, CAST(n AS INTEGER) AS n, start_char, CAST(strlen(substr(text, 1, start_char)) AS BIGINT) AS start_byte, CAST(len(string_split(substr(text, 1, start_char), chr(10))) AS BIGINT) AS line FROM found", artifacts=True)
def match_line_spans(spark, d):
    return text.literal_spans(A(spark, d), "ß")


@query("SELECT artifact_id, CAST(len(regexp_extract_all(text, 'th[aeiou]+n[a-z]*')) AS BIGINT) AS matches FROM artifacts WHERE regexp_matches(text, 'th[aeiou]+n[a-z]*')", artifacts=True)
def search_regex(spark, d):
    return text.match_counts(A(spark, d), "th[aeiou]+n[a-z]*", syntax="safe_regex")


@query("SELECT artifact_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w = 'the')) AS BIGINT) AS matches FROM artifacts WHERE list_contains(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), 'the')", artifacts=True)
def search_word(spark, d):
    return text.match_counts(A(spark, d), "the", word_mode="token")


@query("SELECT artifact_id, string_split(text, chr(10))[1] AS signature FROM artifacts", artifacts=True)
def snippet_signature(spark, d):
    return A(spark, d).select("artifact_id", text.snippet(F.col("text"), "signature").alias("signature"))


@query(", s AS (SELECT namespace, artifact_id, doc_id, substr(text, 1, 4000) AS cut, sum(len(substr(text, 1, 4000))) OVER (PARTITION BY namespace ORDER BY doc_id) AS cum FROM artifacts) SELECT artifact_id, CAST(least(cum, 16000) - least(cum - len(cut), 16000) AS BIGINT) AS kept, md5(substr(cut, 1, CAST(least(cum, 16000) - least(cum - len(cut), 16000) AS BIGINT))) AS snippet_md5 FROM s", artifacts=True)
def snippet_budget(spark, d):
    out = text.snippet_budget(A(spark, d), order=[F.col("doc_id")], stream="namespace")
    return out.select("artifact_id", F.length("snippet").cast("long").alias("kept"), F.md5("snippet").alias("snippet_md5"))


@query("SELECT artifact_id, md5(regexp_replace(text, '" + text.SECRETS + "', '[REDACTED]', 'g')) AS redacted_md5 FROM artifacts", artifacts=True)
def redact_snippets(spark, d):
    return A(spark, d).select("artifact_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT artifact_id, token, count(*) AS tf FROM (SELECT artifact_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_$]+')) AS token FROM artifacts) GROUP BY 1, 2", artifacts=True)
def term_frequency(spark, d):
    return text.term_frequency(A(spark, d))


@query("SELECT record_id FROM records WHERE contains(lower(name || '|' || kind), 'supplier#00000000')", records=True)
def body_fallback_search(spark, d):
    return R(spark, d).where(F.lower(F.concat_ws("|", "name", "kind")).contains("supplier#00000000")).select("record_id")


# ---------------------------------------------------------------- semantic


def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    return [float(x) for x in sources.table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


@query(f"WITH {_Q} SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 20")
def vector_topk_cosine(spark, d):
    return semantic.vector_topk(sources.table(spark, d, "embeddings"), _query_vector(spark, d), 20)


@query(f"WITH {_Q} SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 20")
def vector_topk_l2(spark, d):
    return semantic.vector_topk(sources.table(spark, d, "embeddings"), _query_vector(spark, d), 20, metric="squared_l2")


_LANES = "a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 100), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 100)"


@query(f"WITH {_LANES}, u AS (SELECT id, 1.0 / rank AS s, 'price' AS l FROM a UNION ALL SELECT id, 0.5 / rank, 'size' FROM b) SELECT id, round(CAST(sum(s) AS DOUBLE), 6) AS score, string_agg(l, ',' ORDER BY l) AS lanes FROM (SELECT id, CAST(s AS DOUBLE) AS s, l FROM u) GROUP BY id".replace("1.0 / rank", "CAST(1 AS DOUBLE) / rank").replace("0.5 / rank", "CAST(0.5 AS DOUBLE) / rank"))
def rrf_fusion(spark, d):
    p = sources.table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    price, size = semantic.ranked(p, [F.desc("p_retailprice"), F.col("id")]), semantic.ranked(p, [F.desc("p_size"), F.col("id")])
    return semantic.fuse({"price": (semantic.check_lane(price.select("id", "rank")), 1.0), "size": (size.select("id", "rank"), 0.5)})


@query(f"""WITH {_Q}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6), vec_id) AS rank FROM embeddings, q QUALIFY rank <= 100),
t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY len(regexp_extract_all(text, 'tion')) DESC, doc_id) AS rank FROM documents WHERE contains(text, 'tion') QUALIFY rank <= 100)
SELECT id, round(sum(s), 6) AS score, string_agg(l, ',' ORDER BY l) AS lanes FROM (SELECT id, CAST(1 AS DOUBLE) / rank AS s, 'vector' AS l FROM v UNION ALL SELECT id, CAST(1 AS DOUBLE) / rank, 'lexical' FROM t) GROUP BY id""")
def hybrid_search(spark, d):
    found = semantic.vector_topk(sources.table(spark, d, "embeddings"), _query_vector(spark, d), 100)
    vector = semantic.ranked(found.withColumnRenamed("vec_id", "id"), [F.col("distance"), F.col("id")])
    counts = text.match_counts(A(spark, d), "tion").withColumn("id", F.substring_index("artifact_id", ":", -1).cast("long"))
    lexical = semantic.ranked(counts, [F.desc("matches"), F.col("id")])
    return semantic.fuse({"vector": (vector.select("id", "rank"), 1.0), "lexical": (lexical.select("id", "rank"), 1.0)})


_TOKENS = """t AS (SELECT artifact_id, lower(unnest(list_concat(regexp_extract_all(text, '[A-Za-z0-9_$]+'), regexp_extract_all(regexp_replace(text, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[0-9]+|[A-Z]?[a-z]+|[A-Z]+')))) AS t FROM artifacts),
tf AS (SELECT artifact_id, t, count(*) AS n FROM t GROUP BY 1, 2),
w AS (SELECT t, list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))) AS a, list_prepend(CAST(525069436 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))) AS b FROM (SELECT DISTINCT t FROM tf)),
h AS (SELECT t, list_reduce(a, lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 256 AS bucket, CASE WHEN list_reduce(b, lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 2 = 0 THEN 1 ELSE -1 END AS s FROM w)"""


@query(f", {_TOKENS} SELECT artifact_id, CAST(bucket AS INTEGER) AS bucket, round(sum(s * (1 + ln(n))), 6) AS value FROM tf JOIN h USING (t) GROUP BY 1, 2 HAVING sum(s * (1 + ln(n))) <> 0", artifacts=True)
def hash_buckets(spark, d):
    return semantic.hash_buckets(A(spark, d), "artifact_id", "text").withColumn("value", F.round("value", 6))


@query(
    f""", {_TOKENS}, v AS (SELECT artifact_id, bucket, sum(s * (1 + ln(n))) AS v FROM tf JOIN h USING (t) GROUP BY 1, 2 HAVING sum(s * (1 + ln(n))) <> 0)
SELECT artifact_id, CAST(256 AS INTEGER) AS dimensions, round(sum(CASE WHEN bucket % 2 = 1 THEN v ELSE 0 END) / sqrt(sum(v * v)), 6) AS odd_buckets FROM v GROUP BY 1""",
    artifacts=True,
)
def hash_embedding(spark, d):
    rows = semantic.hash_embedding(A(spark, d), "artifact_id", "text")
    odd = F.aggregate(F.filter("embedding", lambda x, i: i % 2 == 1), F.lit(0.0), lambda s, x: s + x)
    return rows.select("artifact_id", F.size("embedding").alias("dimensions"), F.round(odd, 6).alias("odd_buckets"))


@query("WITH m AS (SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS e, n_chars < 100 AS x FROM documents), n AS (SELECT count(*) AS expected, count_if(e) AS embedded, count_if(NOT e AND x) AS excluded FROM m) SELECT expected, CAST(embedded AS BIGINT) AS embedded, CAST(excluded AS BIGINT) AS excluded, CAST(expected - embedded - excluded AS BIGINT) AS pending, CASE WHEN embedded = 0 THEN 'unavailable' WHEN expected - embedded - excluded > 0 THEN 'updating' WHEN excluded > 0 THEN 'degraded' ELSE 'complete' END AS status FROM n")
def coverage_view(spark, d):
    docs = sources.table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return semantic.coverage(docs.select("id"), sources.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), docs.where("n_chars < 100").select("id"))


@query("SELECT label, round(avg(x), 6) AS mean, i FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def mean_pool(spark, d):
    pooled = semantic.mean_pool(sources.table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("i", "_m")).select("label", F.round("_m", 6).alias("mean"), F.col("i").cast("long").alias("i"))


@query("SELECT artifact_id FROM artifacts WHERE artifact_kind <> 'generated' AND len(text) >= 120 AND NOT regexp_matches(text, '^[ \\t]')", artifacts=True)
def entity_eligibility(spark, d):
    return A(spark, d).where((F.col("artifact_kind") != "generated") & (F.length("text") >= 120) & ~F.col("text").rlike("^[ \\t]")).select("artifact_id")


# ---------------------------------------------------------------- symbols


@query("SELECT record_id, count(*) OVER () > 1 AS ambiguous FROM records WHERE name = 'ASIA' OR identity_key = 'ASIA'", records=True)
def resolve_symbol(spark, d):
    return relational.resolve_symbol(R(spark, d), "ASIA").select("record_id", "ambiguous")


@query("WITH n AS (SELECT p_name AS name, count(*) AS declarations FROM part GROUP BY 1) SELECT name, declarations FROM n WHERE declarations > 1")
def symbol_ambiguity(spark, d):
    return R(spark, d).where("kind = 'tpch:part'").groupBy("name").agg(F.count(F.lit(1)).alias("declarations")).where("declarations > 1")


@query("SELECT * FROM (VALUES ('record_kind', 'core:call'), ('record_kind', 'core:container'), ('record_kind', 'core:configuration'), ('record_kind', 'core:contains'), ('record_kind', 'core:covers'), ('record_kind', 'core:captures'), ('record_kind', 'core:callable')) t(family, id)")
def discover_definitions(spark, d):
    return operations.discover_definitions(spark, {"mode": "prefix", "text": "core:c"}, families=("record_kind",)).select("family", "id")


# ---------------------------------------------------------------- time


@query(f"SELECT record_id, CASE WHEN {VISIBLE.replace(str(G), str(G + 6))} THEN 'added' ELSE 'removed' END AS change FROM records WHERE ({VISIBLE}) <> ({VISIBLE.replace(str(G), str(G + 6))})", records=True)
def snapshot_diff(spark, d):
    return temporal.diff(R(spark, d), G, G + 6)


_CMP = "b AS (SELECT path, content_hash AS c FROM artifacts WHERE doc_id % 5 <> 0), t AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new/' || path ELSE path END AS path, CASE WHEN doc_id % 11 = 0 THEN content_hash || 'x' ELSE content_hash END AS c FROM artifacts WHERE doc_id % 3 <> 0)"


@query(f""", {_CMP}, p AS (SELECT coalesce(b.path, t.path) AS path, b.c AS bc, t.c AS tc FROM b FULL JOIN t ON b.path = t.path), lost AS (SELECT path, bc AS c, count(*) OVER (PARTITION BY bc) AS n FROM p WHERE tc IS NULL), new AS (SELECT path, tc AS c, count(*) OVER (PARTITION BY tc) AS n FROM p WHERE bc IS NULL),
moved AS (SELECT lost.path AS bp, new.path AS tp FROM lost JOIN new USING (c) WHERE lost.n = 1 AND new.n = 1)
SELECT CASE WHEN bc = tc THEN 'correlated' ELSE 'changed' END AS change, path AS base_path, path AS target_path FROM p WHERE bc IS NOT NULL AND tc IS NOT NULL
UNION ALL SELECT 'moved', bp, tp FROM moved UNION ALL SELECT 'removed', path, NULL FROM lost WHERE path NOT IN (SELECT bp FROM moved) UNION ALL SELECT 'added', NULL, path FROM new WHERE path NOT IN (SELECT tp FROM moved)""", artifacts=True)
def compare_moved(spark, d):
    a = A(spark, d)
    base = a.where("doc_id % 5 <> 0").select("path", F.col("content_hash").alias("content"))
    target = a.where("doc_id % 3 <> 0").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 11 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content"))
    return temporal.compare(base, target)


@query("""WITH o AS (SELECT user_id, row_number() OVER w AS g, event_type AS c, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT user_id, g AS valid_from, lead(g) OVER (PARTITION BY user_id ORDER BY g) AS valid_to, c AS content FROM o WHERE g = 1 OR c IS DISTINCT FROM last) SELECT * FROM v""")
def scd2_from_events(spark, d):
    return temporal.versions(sources.table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type"))


_MERGE = "cur AS (SELECT doc_id AS key, lang AS content FROM documents WHERE doc_id % 4 <> 0), bat AS (SELECT doc_id AS key, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS content FROM documents WHERE doc_id % 5 <> 0)"


@query(f"""WITH {_MERGE} SELECT coalesce(cur.key, bat.key) AS key, cur.content AS content, CAST(1 AS BIGINT) AS valid_from, CAST(CASE WHEN bat.key IS NOT NULL AND cur.content IS NOT DISTINCT FROM bat.content THEN NULL ELSE 2 END AS BIGINT) AS valid_to FROM cur LEFT JOIN bat ON cur.key = bat.key
UNION ALL SELECT bat.key, bat.content, 2, NULL FROM bat LEFT JOIN cur ON cur.key = bat.key WHERE cur.key IS NULL OR cur.content IS DISTINCT FROM bat.content""")
def scd2_merge(spark, d):
    docs = sources.table(spark, d, "documents")
    current = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("key"), F.col("lang").alias("content"), F.lit(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    batch = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 6 == 0, "xx").otherwise(F.col("lang")).alias("content"))
    return temporal.merge(current, batch, 2, complete=True)


@query(f"SELECT record_id, valid_from, valid_to FROM records WHERE (valid_from > {G} AND valid_from <= {G + 3}) OR (valid_to > {G} AND valid_to <= {G + 3})", records=True)
def delta_window(spark, d):
    return temporal.delta_window(R(spark, d), G, G + 3).select("record_id", "valid_from", "valid_to")


@query(f"SELECT CAST(count_if(valid_to > {G} AND valid_to <= {G + 3}) AS BIGINT) AS removals, CAST(count_if(valid_from > {G} AND valid_from <= {G + 3}) AS BIGINT) AS additions, CAST(count_if({VISIBLE}) AS BIGINT) AS before FROM records", records=True)
def churn_counts(spark, d):
    return temporal.churn(R(spark, d), G, G + 3)


@query("SELECT 'order:' || o_orderkey AS record_id, lag('order:' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_record_id FROM orders")
def version_chain(spark, d):
    o = sources.table(spark, d, "orders").withColumn("record_id", F.concat(F.lit("order:"), "o_orderkey"))
    return temporal.version_chain(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "record_id").select("record_id", "previous_record_id")


@query("SELECT user_id AS workspace_id, event_id AS generation FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 32 OR event_type = 'purchase' OR ts > TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 24 HOUR")
def retained_snapshots(spark, d):
    s = sources.table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("event_id").alias("generation"), F.col("ts").alias("created_at"), (F.col("event_type") == "purchase").alias("pinned"))
    return temporal.retained(s, now=F.lit("2024-01-28 00:00:00").cast("timestamp")).select("workspace_id", "generation")


@query("SELECT content_hash, count(*) AS n FROM artifacts WHERE content_hash NOT IN (SELECT content_hash FROM artifacts WHERE doc_id % 2 = 0) GROUP BY 1", artifacts=True)
def gc_unreachable(spark, d):
    return temporal.unreachable(A(spark, d), A(spark, d).where("doc_id % 2 = 0"), "content_hash").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query(", walk AS (SELECT 'part:9' AS id UNION SELECT src FROM walk JOIN edges ON dst = walk.id) SELECT id FROM walk WHERE id <> 'part:9'", edges=True)
def invalidation_closure(spark, d):
    return graph.closure(E(spark, d), ids(spark, "part:9"), direction="inbound").select("id")


@query(f"SELECT 'w2/' || record_id AS record_id, 'w2/' || parent_id AS parent_id, CAST(0 AS BIGINT) AS valid_from FROM records WHERE {VISIBLE} AND kind <> 'tpch:order'", records=True)
def workspace_fork(spark, d):
    return temporal.fork(R(spark, d).where("kind <> 'tpch:order'"), G, "w2").select("record_id", "parent_id", "valid_from")


# ---------------------------------------------------------------- aggregates


@query("WITH s AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 4 ELSE 2 END AS r FROM events WHERE value < 20) SELECT user_id, ['complete', 'partial', 'unknown', 'unsupported', 'stale'][max(r) + 1] AS status FROM s GROUP BY 1")
def completeness_fold(spark, d):
    s = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "partial").when(F.col("event_type") == "purchase", "stale").otherwise("odd")
    return temporal.worst_status(sources.table(spark, d, "events").where("value < 20").withColumn("s", s), ["user_id"], "s")


@query("SELECT namespace, 'sha256:' || sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS digest FROM artifacts GROUP BY 1", artifacts=True)
def set_digest(spark, d):
    return temporal.set_digest(A(spark, d), ["namespace"], F.col("content_hash"))


@query("SELECT count(*) AS documents, CAST(sum(CASE WHEN byte_length > 4000 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(sum(byte_length) AS BIGINT) AS bytes FROM artifacts", artifacts=True)
def coverage_counts(spark, d):
    return A(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("byte_length") > 4000).cast("long")).alias("large"), F.sum("byte_length").alias("bytes"))


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def benchmark_stats(spark, d):
    return sources.table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS affected, array_to_string(list_slice(list_sort(list(DISTINCT 'part:' || l_partkey)), 1, 8), ',') AS sample FROM lineitem GROUP BY 1")
def affected_summary(spark, d):
    parts = F.array_sort(F.collect_set(F.concat(F.lit("part:"), "l_partkey")))
    return sources.table(spark, d, "lineitem").groupBy("l_suppkey").agg(parts.alias("_p")).select("l_suppkey", F.size("_p").cast("long").alias("affected"), F.array_join(F.slice("_p", 1, 8), ",").alias("sample"))


# ---------------------------------------------------------------- paging

_MANIFEST = "m AS (SELECT artifact_id, path, row_number() OVER (ORDER BY path, artifact_id) - 1 AS ordinal FROM artifacts)"


@query(f", {_MANIFEST} SELECT artifact_id, ordinal FROM m WHERE ordinal BETWEEN 50 AND 99", artifacts=True)
def manifest_page_forward(spark, d):
    return paging.page(paging.manifest(A(spark, d).select("artifact_id", "path"), [F.col("path"), F.col("artifact_id")]), after=49, limit=50).select("artifact_id", "ordinal")


@query(f", {_MANIFEST} SELECT artifact_id, ordinal FROM m WHERE ordinal BETWEEN 70 AND 99", artifacts=True)
def manifest_page_backward(spark, d):
    return paging.page(paging.manifest(A(spark, d).select("artifact_id", "path"), [F.col("path"), F.col("artifact_id")]), before=100, limit=30).select("artifact_id", "ordinal")


# ---------------------------------------------------------------- streams


@query("WITH e AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000, false) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS hints FROM b GROUP BY user_id, b")
def stream_quiet_batches(spark, d):
    return streaming.quiet_batches(sources.table(spark, d, "events"), 6 * 3600)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, ts, event_type = 'purchase' AS stop, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, us, ts, stop, us AS a, ts AS started, 1 AS hints, 0 AS batch, '' AS ended_by FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.us, e.ts, e.stop, CASE WHEN c.new THEN e.us ELSE w.a END, CASE WHEN c.new THEN e.ts ELSE w.started END, CASE WHEN c.new THEN 1 ELSE w.hints + 1 END, w.batch + CASE WHEN c.new THEN 1 ELSE 0 END,
  CASE WHEN NOT c.new THEN '' WHEN w.stop THEN 'barrier' WHEN e.us - w.us >= 21600000000 THEN 'quiet' ELSE 'cap' END
 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1, LATERAL (SELECT w.stop OR e.us - w.us >= 21600000000 OR e.us - w.a >= 86400000000 AS new) c),
b AS (SELECT user_id, batch, min(started) AS started, max(ts) AS ended, CAST(max(hints) AS BIGINT) AS hints, bool_or(stop) AS stopped FROM w GROUP BY 1, 2),
r AS (SELECT user_id, batch - 1 AS batch, ended_by FROM w WHERE ended_by <> '')
SELECT b.user_id, started, ended, hints, coalesce(ended_by, CASE WHEN stopped THEN 'barrier' ELSE 'quiet' END) AS reason FROM b LEFT JOIN r USING (user_id, batch)"""
)
def stream_max_window(spark, d):
    return streaming.capped_batches(sources.table(spark, d, "events"), 6 * 3600, 24 * 3600, barriers=("purchase",))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY NOT (event_type = 'click' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'click', false))")
def stream_dedup(spark, d):
    return streaming.coalesced(sources.table(spark, d, "events")).select("event_id", "user_id", "event_type")


@query("WITH a AS (SELECT event_id, ts, user_id * 100003 + event_id AS arrival FROM events) SELECT event_id, ts FROM (SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) WHERE epoch_us(seen) - epoch_us(ts) > 3600000000")
def stream_late_rows(spark, d):
    """Events arrive by user: most of a user's come after later ones of another."""
    arrived = sources.table(spark, d, "events").withColumn("own", F.col("event_id")).withColumn("event_id", F.col("user_id") * 100003 + F.col("event_id"))
    return streaming.late_rows(arrived, 3600).select(F.col("own").alias("event_id"), "ts")


# ---------------------------------------------------------------- recipes


@query(_STEP.format(roots="('part:5')", to="src", by="dst", edges="(SELECT * FROM edges WHERE kind IN ('core:call', 'core:references'))", most=1), edges=True)
def recipe_trace_behavior(spark, d):
    corpus = operations.Corpus(R(spark, d), E(spark, d), A(spark, d))
    return recipes.run(corpus, "core:trace_behavior", {"subjects": ["part:5"], "direction": "inbound", "max_depth": 1, "relations": {"universal_kinds": ["core:call", "core:references"]}})["subjects"].select("id", "depth")


@query("SELECT DISTINCT src AS id, 'will_break' AS output FROM edges WHERE dst = 'supplier:3' AND kind = 'core:call' AND classification = 'confirmed' UNION ALL SELECT 'supplier:3', 'target' UNION ALL SELECT DISTINCT src, 'references' FROM edges WHERE dst = 'supplier:3' AND kind <> 'core:contains'", edges=True)
def recipe_prepare_symbol_change(spark, d):
    corpus = operations.Corpus(R(spark, d), E(spark, d), A(spark, d))
    name = R(spark, d).where("record_id = 'supplier:3'").first()["name"]
    out = recipes.run(corpus, "core:prepare_symbol_change", {"reference": name, "change": {"kind": "signature"}})
    named = [out["target"].select(F.col("record_id").alias("id"), F.lit("target").alias("output")), out["will_break"].select("id", F.lit("will_break").alias("output")), out["references"].where("kind <> 'core:contains'").select(F.col("src").alias("id"), F.lit("references").alias("output")).distinct()]
    return named[0].union(named[1]).union(named[2])


@query("SELECT record_id FROM records WHERE list_contains(facets, 'core:test')", records=True)
def recipe_definition_to_instances(spark, d):
    corpus = operations.Corpus(R(spark, d), E(spark, d), A(spark, d))
    return recipes.run(corpus, "core:definition_to_instances", {"matcher": {"mode": "exact", "text": "core:test"}})["instances"].select("record_id")


@query("SELECT DISTINCT src AS id FROM edges WHERE kind = 'core:call' AND dst IN (SELECT record_id FROM records WHERE contains(lower(name), 'supplier#000000003') AND kind = 'tpch:supplier')", records=True, edges=True)
def recipe_semantic_to_callers(spark, d):
    corpus = operations.Corpus(R(spark, d), E(spark, d), A(spark, d))
    return recipes.run(corpus, "core:semantic_to_callers", {"query_text": "Supplier#000000003", "filter": {"kind": ["tpch:supplier"]}, "max_call_depth": 1})["callers"].select("id")


def _corpus(spark, d, **more) -> operations.Corpus:
    return operations.Corpus(R(spark, d), E(spark, d), A(spark, d), **more)


def _tagged(outputs: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """id, output of several streams; names: output -> its id column."""
    parts = [outputs[n].select(F.col(c).cast("string").alias("id"), F.lit(n).alias("output")) for n, c in names.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


@query("SELECT record_id AS id, name || chr(10) || identity_key AS snippet FROM records WHERE contains(lower(name), 'supplier#00000000') AND kind = 'tpch:supplier'", records=True)
def recipe_locate_implementation(spark, d):
    return recipes.run(_corpus(spark, d), "core:locate_implementation", {"query_text": "Supplier#00000000", "filter": {"kind": ["tpch:supplier"]}})["sources"]


_DEPENDS = "('core:call', 'core:references', 'core:import', 'core:inherits', 'core:implements')"
_IMPACT = f""", far AS (SELECT 'supplier:3' AS id UNION SELECT src FROM far JOIN edges ON dst = far.id AND kind IN {_DEPENDS}), wb AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 'supplier:3' AND kind = 'core:call' AND classification = 'confirmed')
SELECT id, 'will_break' AS output FROM wb UNION ALL SELECT DISTINCT id, 'may_be_affected' FROM far WHERE id <> 'supplier:3' AND id NOT IN (SELECT id FROM wb) UNION ALL SELECT DISTINCT src, 'uncertain_dynamic_usage' FROM edges WHERE dst = 'supplier:3' AND kind IN {_DEPENDS} AND classification = 'possible'"""


@query(_IMPACT, edges=True)
def recipe_understand_change_impact(spark, d):
    out = recipes.run(_corpus(spark, d), "core:understand_change_impact", {"target": ["supplier:3"], "change": {"change_type": "signature"}})
    return _tagged(out, {n: "id" for n in ("will_break", "may_be_affected", "uncertain_dynamic_usage")})


@query("SELECT record_id AS id, 'analogues' AS output FROM records WHERE kind = 'tpch:supplier' UNION ALL SELECT record_id, 'architecture' FROM records WHERE universal_kind = 'core:container' UNION ALL SELECT record_id, 'architecture' FROM records WHERE universal_kind = 'core:type' AND name NOT LIKE '\\_%' ESCAPE '\\'", records=True)
def recipe_prepare_new_feature(spark, d):
    out = recipes.run(_corpus(spark, d), "core:prepare_new_feature", {"task": "Supplier#000000003", "filter": {"kind": ["tpch:supplier"]}})
    return _tagged(out, {"analogues": "record_id", "architecture": "record_id"})


_TESTED = ", anc AS (SELECT 'part:5' AS id UNION SELECT src FROM anc JOIN edges ON dst = anc.id AND kind IN ('core:contains', 'core:defines')), found AS (SELECT DISTINCT src AS id FROM edges WHERE kind = 'core:covers' AND dst IN (SELECT id FROM anc))"


@query(_TESTED + " SELECT id, 'tests' AS output, '' AS snippet FROM found UNION ALL SELECT record_id, 'sources', name || chr(10) || identity_key FROM records JOIN found ON record_id = id", records=True, edges=True)
def recipe_find_relevant_tests(spark, d):
    out = recipes.run(_corpus(spark, d), "core:find_relevant_tests", {"subjects": ["part:5"]})
    return out["tests"].select("id", F.lit("tests").alias("output"), F.lit("").alias("snippet")).union(out["sources"].select("id", F.lit("sources"), "snippet"))


@query("SELECT record_id, 'entry_points' AS view FROM records WHERE universal_kind = 'core:container' UNION ALL SELECT record_id, 'public_surfaces' FROM records WHERE universal_kind = 'core:type' AND name NOT LIKE '\\_%' ESCAPE '\\' UNION ALL SELECT DISTINCT a.src, 'boundaries' FROM edges e JOIN edges a ON a.dst = e.src AND a.kind = 'core:contains' JOIN edges b ON b.dst = e.dst AND b.kind = 'core:contains' WHERE e.kind <> 'core:contains' AND a.src <> b.src", records=True, edges=True)
def recipe_explain_architecture_slice(spark, d):
    return recipes.run(_corpus(spark, d), "core:explain_architecture_slice", {"views": ["entry_points", "public_surfaces", "boundaries"]})["architecture"]


@query(", b AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256('old' || text) ELSE content_hash END AS content FROM artifacts WHERE doc_id % 13 <> 0), t AS (SELECT path, content_hash AS content FROM artifacts WHERE doc_id % 17 <> 1) SELECT CASE WHEN b.content = t.content THEN 'correlated' ELSE 'changed' END AS change, path FROM b JOIN t USING (path)", artifacts=True)
def recipe_compare_workspaces(spark, d):
    a = A(spark, d)
    base = a.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat(F.lit("old"), "text"), 256)).otherwise(F.col("content_hash")).alias("content"))
    corpus = operations.Corpus(R(spark, d), E(spark, d), a.where("doc_id % 17 <> 1"), base=base)
    out = recipes.run(corpus, "core:compare_workspaces", {})
    return out["changed"].union(out["correlated"]).select("change", F.col("target_path").alias("path"))


@query("SELECT 'supplier:3' AS id, 'declarations' AS output UNION ALL SELECT src, 'references' FROM edges WHERE dst = 'supplier:3' AND kind NOT IN ('core:contains', 'core:defines') UNION ALL SELECT DISTINCT src, 'owners' FROM edges WHERE dst = 'supplier:3' AND kind NOT IN ('core:contains', 'core:defines')", edges=True)
def recipe_resolve_and_find_references(spark, d):
    name = R(spark, d).where("record_id = 'supplier:3'").first()["name"]
    out = recipes.run(_corpus(spark, d), "core:resolve_and_find_references", {"reference": name})
    return _tagged(out, {"declarations": "record_id", "references": "src", "owners": "id"})


@query(_STEP.format(roots="('part:5')", to="src", by="dst", edges="(SELECT * FROM edges WHERE kind IN ('core:call', 'core:references'))", most=1).replace("SELECT id, CAST(depth AS INTEGER) AS depth FROM first WHERE depth > 0", "") + ", s AS (SELECT id FROM first) SELECT DISTINCT 'part:5>' || src AS item, 'paths' AS output FROM edges WHERE dst = 'part:5' AND kind IN ('core:call', 'core:references') UNION ALL SELECT edge_id, 'relations' FROM edges WHERE kind IN ('core:call', 'core:references') AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)", edges=True)
def recipe_trace_behavior_paths(spark, d):
    out = recipes.run(_corpus(spark, d), "core:trace_behavior", {"subjects": ["part:5"], "direction": "inbound", "max_depth": 1, "relations": {"universal_kinds": ["core:call", "core:references"]}})
    return out["paths"].select(F.col("path").alias("item"), F.lit("paths").alias("output")).union(out["relations"].select("edge_id", F.lit("relations")))


# ---------------------------------------------------------------- operations with all their arguments


@query("SELECT b.dst AS id FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'region:1' AND a.kind = 'core:contains' AND b.kind = 'core:contains' AND b.dst LIKE 'supplier:%'", edges=True)
def outline_filtered(spark, d):
    return operations.evaluate(_corpus(spark, d), "core:get_outline", {"container": "region:1", "depth": 2, "filter": {"kind": ["tpch:supplier"]}, "include_non_public": False})["members"].select("id")


@query(f", v AS (SELECT record_id FROM records WHERE {VISIBLE}) SELECT edge_id FROM edges WHERE dst = 'supplier:3' AND kind IN ('core:call', 'core:contains', 'core:defines') AND src IN (SELECT record_id FROM v WHERE record_id LIKE 'order:%')", records=True, edges=True)
def references_of_roles(spark, d):
    return operations.evaluate(_corpus(spark, d, generation=G), "core:find_references", {"target": ["supplier:3"], "reference_roles": ["call"], "include_declarations": True, "filter": {"kind": ["tpch:order"]}})["references"].select("edge_id")


@query(f"SELECT record_id FROM records WHERE {VISIBLE} AND universal_kind = 'core:callable'", records=True)
def find_records_visible(spark, d):
    return operations.evaluate(_corpus(spark, d, generation=G), "core:find_records", {"selector": {"kind_selector": {"universal_kinds": ["core:callable"]}}})["records"].select("record_id")


@query("SELECT DISTINCT src AS id FROM edges WHERE kind = 'core:covers' AND dst IN ('part:5', 'part:6')", edges=True)
def related_tests_direct(spark, d):
    return operations.evaluate(_corpus(spark, d), "core:find_related_tests", {"subjects": ["part:5", "part:6"], "relationship_scope": "direct", "filter": {"kind": ["tpch:supplier"]}})["tests"]


@query("SELECT dst AS id FROM edges WHERE src = 'region:1' AND kind = 'core:contains' UNION SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'region:1' AND a.kind = 'core:contains' AND b.kind = 'core:contains' AND b.dst LIKE 'customer:%'", edges=True)
def architecture_slice(spark, d):
    """Containers and their customers within two steps of a region, by a pipeline: expansion, filter, union, deduplication."""
    ref = lambda s, o="subjects": {"stage_id": s, "output": o}
    contains = {"universal_kinds": ["core:contains"]}
    stages = [
        {"id": "roots", "operator": "source.operation", "operation": "core:find_records", "arguments": {"selector": {"filter": {"kind": ["tpch:region"]}}}},
        {"id": "one", "operator": "filter", "inputs": [ref("roots", "records")], "arguments": {"predicate": {"path": ["region:1"]}}},
        {"id": "near", "operator": "expand.relations", "inputs": [ref("one")], "arguments": {"direction": "outbound", "relations": contains, "max_depth": 1}},
        {"id": "all", "operator": "expand.relations", "inputs": [ref("near")], "arguments": {"direction": "outbound", "relations": contains, "max_depth": 1}},
        {"id": "customers", "operator": "source.operation", "operation": "core:find_records", "arguments": {"selector": {"filter": {"kind": ["tpch:customer"]}}}},
        {"id": "both", "operator": "set.intersection", "inputs": [ref("all"), ref("customers", "records")]},
        {"id": "every", "operator": "set.union", "inputs": [ref("near"), ref("both")]},
        {"id": "once", "operator": "deduplicate", "inputs": [ref("every")], "arguments": {"identity": "subject"}},
    ]
    corpus = operations.Corpus(R(spark, d).withColumn("path", F.col("record_id")), E(spark, d), A(spark, d))
    return pipeline.run(corpus, stages, {"subjects": ref("once")})["subjects"].select(F.col("subject_id").alias("id"))


@query(", hit AS (SELECT artifact_id, doc_id, text FROM artifacts WHERE contains(text, 'stupid') OR contains(text, 'License')), s AS (SELECT artifact_id, doc_id, substr(text, 1, 4000) AS cut, sum(len(substr(text, 1, 4000))) OVER (ORDER BY doc_id) AS cum FROM hit) SELECT artifact_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS ordinal, substr(cut, 1, CAST(least(cum, 16000) - least(cum - len(cut), 16000) AS BIGINT)) AS snippet FROM s ORDER BY doc_id LIMIT 50", artifacts=True)
def search_then_source(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """search_text -> get_source over documents: matched artifacts, ordered snippets within a budget, first page."""
    a = A(spark, d)
    hits = text.match_counts(a, "stupid|License", syntax="safe_regex").select("artifact_id")
    order = [F.col("doc_id")]
    first = a.join(hits, "artifact_id", "left_semi").orderBy(*order).limit(50)
    placed = text.snippet_budget(first, order=order)
    return placed.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).select("artifact_id", "ordinal", "snippet")
