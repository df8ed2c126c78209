"""The closed set of operations: each takes a corpus and checked arguments and returns named streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import matches_any
from stratagraph.operators import graph, relational, semantic, temporal, text
from stratagraph.operators.relational import QueryError

Streams = dict[str, DataFrame]

#: Vocabularies, fixed values of the model.
ENTITY_KINDS = ("core:container", "core:type", "core:callable", "core:value", "core:field", "core:parameter", "core:module", "core:package", "core:namespace", "core:test", "core:resource", "core:endpoint", "core:event", "core:configuration", "core:external")
RELATION_KINDS = ("core:contains", "core:defines", "core:aliases", "core:type_of", "core:references", "core:call", "core:read", "core:write", "core:import", "core:export", "core:inherits", "core:implements", "core:overrides", "core:returns", "core:binds_argument", "core:captures", "core:throws", "core:handles", "core:depends_on", "core:binds", "core:covers")
FACETS = ("core:definition", "core:exported", "core:test", "core:execution")


@dataclass
class Corpus:
    """One snapshot: records, edges and artifacts, with vectors (id, embedding) if there are any."""

    records: DataFrame
    edges: DataFrame
    artifacts: DataFrame
    vectors: DataFrame | None = None
    base: DataFrame | None = None  # the other side of a comparison: path, content
    generation: int | None = None  # of records (and edges) with intervals, those visible then
    trigrams: DataFrame | None = None  # trigram, artifact_id: the projection that literal searches use

    def snapshot(self) -> Corpus:
        """The corpus as every operation sees it: rows outside of the generation are never answers."""
        if self.generation is None:
            return self
        at = lambda df: df.where(relational.visible(self.generation)) if {"valid_from", "valid_to"} <= set(df.columns) else df
        return replace(self, records=at(self.records), edges=at(self.edges), generation=None)

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    def subjects(self, value) -> DataFrame:
        """id of subjects given as a stream or a list of record ids."""
        if isinstance(value, DataFrame):
            name = next((c for c in ("id", "record_id", "subject_id", "src", "artifact_id") if c in value.columns), None)
            if name is None:
                raise QueryError("core:stage_reference_invalid")
            return value.select(F.col(name).alias("id")).distinct()
        if not value:
            raise QueryError("core:selector_not_found")
        return self.spark.range(1).select(F.explode(F.array(*map(F.lit, value))).alias("id"))


def discover_definitions(spark: SparkSession, matcher: dict, families=()) -> DataFrame:
    """family, id of registered definitions that match exactly, by prefix or as a part (semantic and hybrid too)."""
    every = [("record_kind", x) for x in (*ENTITY_KINDS, *RELATION_KINDS)] + [("facet", x) for x in FACETS]
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("id")) for a, b in every])).alias("s")).select("s.*")
    mode, wanted = matcher.get("mode", "contains"), matcher["text"]
    local = F.substring_index("id", ":", -1)
    test = {"exact": (F.col("id") == wanted) | (local == wanted), "prefix": F.col("id").startswith(wanted) | local.startswith(wanted)}.get(mode, F.col("id").contains(wanted))
    return table.where(test & (F.col("family").isin(*families) if families else F.lit(True)))


def inspect_architecture(records: DataFrame, edges: DataFrame, views=("entry_points", "public_surfaces")) -> DataFrame:
    """record_id, view.  boundaries (containers with relations to another container's members) and cycles are rules of our own;
    extension_points and layers have none and are empty."""
    made = []
    for view in views:
        if view == "entry_points":
            rows = records.where("universal_kind = 'core:container'").select("record_id")
        elif view == "public_surfaces":
            rows = records.where((F.col("universal_kind") == "core:type") & ~F.col("name").startswith("_")).select("record_id")
        elif view == "boundaries":
            inside = edges.where("kind = 'core:contains'").select(F.col("dst").alias("m"), F.col("src").alias("c"))
            across = edges.where("kind <> 'core:contains'").join(inside.toDF("src", "a"), "src").join(inside.toDF("dst", "b"), "dst").where("a <> b")
            rows = across.select(F.col("a").alias("record_id")).distinct()
        elif view == "cycles":
            rows = graph.cycles(edges, graph.DEPENDS).select(F.col("id").alias("record_id"))
        elif view in ("extension_points", "layers"):
            rows = records.limit(0).select("record_id")
        else:
            raise QueryError("core:invalid_arguments", view)
        made.append(rows.withColumn("view", F.lit(view)))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def _filtered(df: DataFrame, filter: dict | None) -> DataFrame:
    return df.where(relational.predicate(filter)) if filter else df


def _kept(c: Corpus, a: dict, df: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose `col` names a record that satisfies the request's filter."""
    if not a.get("filter"):
        return df
    return df.join(_filtered(c.records, a["filter"]).select(F.col("record_id").alias(col)), col, "left_semi").select(df.columns)


def _find_records(c: Corpus, a: dict) -> Streams:
    s = a.get("selector", {})
    if any(isinstance(v, (list, tuple)) and not v for v in s.values()):
        raise QueryError("core:invalid_selector", "an empty array")
    return {"records": relational.find_records(c.records, categories=s.get("record_categories", ()), filter=s.get("filter"), **s.get("kind_selector", {}))}


def _resolve(c: Corpus, a: dict) -> Streams:
    found = relational.resolve_symbol(c.records, a["reference"], context_owner=a.get("context_artifact"), scope=a.get("scope"), **a.get("kind_selector", {}))
    return {"declarations": found.where("not ambiguous").drop("ambiguous"), "candidates": found.where("ambiguous").drop("ambiguous")}


def _outline(c: Corpus, a: dict) -> Streams:
    root = c.subjects([a["container"]] if isinstance(a["container"], str) else a["container"])
    if c.records.join(root.withColumnRenamed("id", "record_id"), "record_id", "left_semi").isEmpty():
        raise QueryError("core:selector_not_found")
    members = _kept(c, a, graph.expand(c.edges, root, min_depth=1, max_depth=a.get("depth", 1), kinds=("core:contains",)))
    if not a.get("include_non_public", True):  # names that begin with an underscore are private
        members = members.join(c.records.where(F.col("name").startswith("_")).select(F.col("record_id").alias("id")), "id", "left_anti")
    return {"members": members}


def _relations(edges: DataFrame, selector: dict | None) -> DataFrame:
    s = selector or {}
    for field in ("relation_kinds", "universal_kinds"):
        edges = edges.where(F.col("kind").isin(*s[field])) if s.get(field) else edges
    return edges.where(F.col("classification") == s["evidence_class"]) if s.get("evidence_class", "both") != "both" else edges


#: Reference roles and the relation kinds that have them; declarations are kinds that define or contain.
ROLES = {"call": ("core:call",), "read": ("core:read",), "write": ("core:write",), "import": ("core:import",), "type": ("core:type_of", "core:inherits", "core:implements"), "reference": ("core:references",), "cover": ("core:covers",)}
DECLARES = ("core:contains", "core:defines")


def _references(c: Corpus, a: dict) -> Streams:
    edges = _relations(c.edges, a.get("relations"))
    wanted = a.get("reference_roles") or ()
    if unknown := set(wanted) - set(ROLES):
        raise QueryError("core:invalid_arguments", f"reference_roles {sorted(unknown)}")
    roles = F.col("kind").isin([k for r in wanted for k in ROLES[r]]) if wanted else ~F.col("kind").isin(*DECLARES)
    edges = edges.where(roles | F.col("kind").isin(*DECLARES) if a.get("include_declarations") else roles)
    found = _kept(c, a, graph.references(edges, c.subjects(a["target"])), "src")
    return {"references": found, "owners": found.select(F.col("src").alias("id")).distinct()}


def _expand(c: Corpus, a: dict) -> Streams:
    roots, e = c.subjects(a["subjects"]), _relations(c.edges, a.get("relations"))
    reached = _kept(c, a, graph.expand(e, roots, direction=a.get("direction", "outbound"), min_depth=a.get("min_depth", 1), max_depth=a.get("max_depth")))
    out = {"subjects": reached, "relations": graph.induced(e, reached.select("id").union(roots))}
    if a.get("path_policy"):
        out["paths"] = graph.simple_paths(e, roots, a.get("max_depth") or a.get("min_depth", 1), direction=a.get("direction", "outbound"), policy=a["path_policy"])
    return out


def _paths(c: Corpus, a: dict) -> Streams:
    return {"paths": graph.shortest_paths(_relations(c.edges, a.get("relations")), a["source"], a["target"], a.get("max_depth", 4), direction=a.get("direction", "outbound"), all_shortest=a.get("all_shortest", True))}


def _artifacts(c: Corpus, a: dict) -> Streams:
    return {"artifacts": c.artifacts.where(relational.structural_filter(**a.get("filter", {})))}


def _search_text(c: Corpus, a: dict) -> Streams:
    """A literal's candidates come from the trigram projection, where the corpus has one."""
    literal = a.get("syntax", "literal") == "literal"
    some = text.prefiltered(_artifacts(c, a)["artifacts"], a["pattern"], c.trigrams if literal else None)
    found = text.match_counts(some, a["pattern"], syntax=a.get("syntax", "literal"), word_mode=a.get("word_mode", "substring"), case_sensitive=a.get("case_sensitive", True))
    projection = a.get("result_projection", "matches")
    if projection not in ("matches", "artifacts"):
        raise QueryError("core:invalid_arguments", projection)
    return {"matches": found if projection == "matches" else found.select("artifact_id"), "subjects": found.select("artifact_id")}


def _vectors(c: Corpus, a: dict) -> DataFrame:
    """The vectors whose owners satisfy the filter: it is applied before any distance."""
    return semantic.filtered_vectors(c.vectors, _filtered(c.records, a["filter"]).select(F.col("record_id").alias("id")), "id") if a.get("filter") else c.vectors


def _search_semantic(c: Corpus, a: dict) -> Streams:
    if c.vectors is None:
        raise QueryError("core:required_capability_unsupported")
    return {"candidates": semantic.vector_topk(_vectors(c, a), a["vector"], a.get("limit", 100), id_col="id").withColumn("classification", F.lit("possible"))}


def _search_hybrid(c: Corpus, a: dict) -> Streams:
    """Lexical lane over names; a vector lane where the corpus and the request have vectors; ranks fused."""
    wanted = a["query_text"].lower()
    named = _filtered(c.records, a.get("filter")).where(F.lower("name").contains(wanted)).select(F.col("record_id").alias("id"), F.length("name").alias("n"))
    lanes = {"lexical": (semantic.ranked(named, [F.col("n"), F.col("id")]).select("id", "rank"), 1.0)}
    if c.vectors is not None and a.get("vector"):
        near = semantic.vector_topk(_vectors(c, a), a["vector"], 100, id_col="id")
        lanes["vector"] = (semantic.ranked(near, [F.col("distance"), F.col("id")]).select("id", "rank"), 1.0)
    return {"candidates": semantic.fuse(lanes).withColumn("classification", F.lit("possible"))}


def _get_source(c: Corpus, a: dict) -> Streams:
    """Snippets of subjects that are artifacts; others are answered by their name and key."""
    options = a.get("source", {})
    ids = graph.held(c.subjects(a["subjects"]))
    docs = c.artifacts.join(ids.withColumnRenamed("id", "artifact_id"), "artifact_id", "left_semi").select(F.col("artifact_id").alias("id"), "text")
    recs = c.records.join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_semi").select(F.col("record_id").alias("id"), F.concat_ws("\n", "name", "identity_key").alias("text"))
    placed = text.snippet_budget(docs.union(recs), mode=options.get("mode", "relevant"), order=[F.col("id")], per_snippet=options.get("max_characters", text.SNIPPET), total=options.get("total_characters", text.TOTAL))
    return {"sources": placed.select("id", text.redact(F.col("snippet")).alias("snippet"))}


#: Change types, and the classes that each leaves empty: a rename, a move or a new visibility breaks references, not behaviour.
CHANGES = {"delete": (), "signature": (), "type": (), "contract": (), "behavior": ("will_break", "must_update"), "rename": ("may_be_affected",), "move": ("may_be_affected",), "visibility": ("may_be_affected",)}


def _impact(c: Corpus, a: dict) -> Streams:
    change = a["change"].get("change_type", a["change"].get("kind", "signature"))
    if change not in CHANGES:
        raise QueryError("core:invalid_arguments", change)
    found = graph.impact(c.edges, c.subjects(a["target"]), include_transitive=a.get("include_transitive", True) and "may_be_affected" not in CHANGES[change])
    found = {k: _kept(c, a, df if k not in CHANGES[change] else df.limit(0)) for k, df in found.items()}
    if not a.get("include_tests", True):
        found["tests_to_run"] = found["tests_to_run"].limit(0)
    every = None
    for df in found.values():
        every = df.select("id") if every is None else every.union(df.select("id"))
    return found | {"all_classified_subjects": every.distinct()}


def _tests(c: Corpus, a: dict) -> Streams:
    """tests; what they use (their outbound calls and references) that bears the facet of a fixture, mock or helper."""
    found = graph.held(_kept(c, a, graph.related_tests(c.edges, c.subjects(a["subjects"]), a.get("relationship_scope", "both"))))
    out = {"tests": found}
    used = graph.directed(c.edges, "outbound", ("core:call", "core:references")).join(found.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("record_id")).distinct()
    for role in ("fixture", "mock", "helper"):
        some = c.records.where(F.array_contains("facets", f"core:{role}")).join(used, "record_id", "left_semi").select(F.col("record_id").alias("id"))
        out[f"{role}s"] = _kept(c, a, some) if a.get("include_fixtures", True) else found.limit(0)
    return out


def _architecture(c: Corpus, a: dict) -> Streams:
    """Views of the whole corpus, or of the slice that the scope's subjects reach within max_relation_depth."""
    views = a.get("views", ("entry_points", "public_surfaces"))
    records = _filtered(c.records, a.get("filter"))
    edges = c.edges
    if a.get("scope"):
        roots = c.subjects(a["scope"])
        inside = graph.expand(c.edges, roots, max_depth=a.get("max_relation_depth", 5)).select("id").union(roots)
        records, edges = records.join(inside.withColumnRenamed("id", "record_id"), "record_id", "left_semi"), graph.induced(edges, inside)
    return {"all_requested_views": inspect_architecture(records, edges, views)} | {v: inspect_architecture(records, edges, (v,)) for v in views}


KINDS_OF_CHANGE = ("added", "removed", "changed", "moved", "correlated")


def _compare(c: Corpus, a: dict) -> Streams:
    """base and target; the filter is applied to the target's artifacts and to the base's paths."""
    if c.base is None:
        raise QueryError("core:invalid_query_scope", "base and target are needed")
    wanted = a.get("comparison_kinds") or KINDS_OF_CHANGE
    if not set(wanted) <= set(KINDS_OF_CHANGE):
        raise QueryError("core:invalid_arguments", str(wanted))
    base, target = c.base, c.artifacts
    if f := a.get("filter"):
        target = target.where(relational.structural_filter(**f))
        base = base.where(matches_any(F.col("path"), list(f["paths"]))) if f.get("paths") else base
    if a.get("selection"):
        target = target.join(c.subjects(a["selection"]).withColumnRenamed("id", "artifact_id"), "artifact_id", "left_semi")
        base = base.join(target.select("path"), "path", "left_semi")
    found = temporal.compare(base, target.select("path", F.col("content_hash").alias("content")), include_possible=a.get("correlation_policy") == "include_possible")
    return {k: found.where(F.col("change") == k) for k in wanted}


def _context(c: Corpus, a: dict) -> Streams:
    """Ordered bundles without repetition: what the task's words name, then what that depends on, then its tests."""
    seeds = c.subjects(a["seeds"]) if a.get("seeds") else _search_hybrid(c, {"query_text": a["task"], "filter": a.get("filter")})["candidates"].select("id")
    lanes = [("definitions", seeds), ("dependencies", graph.expand(c.edges, seeds).select("id")), ("tests", graph.related_tests(c.edges, seeds))]
    wanted = a.get("facets") or [n for n, _ in lanes]
    rows = None
    for n, (name, df) in enumerate(lanes):
        part = df.select("id", F.lit(name).alias("facet"), F.lit(n).alias("_order")).where(F.lit(name in wanted))
        rows = part if rows is None else rows.union(part)
    return {"context": relational.deduplicate(rows, "id", order=[F.col("_order")]).drop("_order")}


def _status(c: Corpus, a: dict) -> Streams:
    counts = c.artifacts.agg(F.count(F.lit(1)).alias("artifacts")).join(c.records.agg(F.count(F.lit(1)).alias("records"))).join(c.edges.agg(F.count(F.lit(1)).alias("relations")))
    ready = F.when(F.col("records") > 0, F.lit("structural") if c.vectors is None else F.lit("semantic")).otherwise("source")
    return {"workspaces": counts.withColumn("readiness", ready), "activation_issues": counts.limit(0), "candidate_issues": counts.limit(0)}


def _definitions(c: Corpus, a: dict) -> Streams:
    found = discover_definitions(c.spark, a["matcher"], a.get("selector", {}).get("definition_types", ()))
    return {"definitions": found, "definition_set": found}


#: name -> (handler, required arguments, all arguments)
OPERATIONS: dict[str, tuple[Callable[[Corpus, dict], Streams], set[str], set[str]]] = {
    "core:discover_definitions": (_definitions, {"matcher"}, {"matcher", "selector", "include_full_definitions"}),
    "core:find_records": (_find_records, {"selector"}, {"selector"}),
    "core:find_artifacts": (_artifacts, set(), {"filter"}),
    "core:resolve_symbol": (_resolve, {"reference"}, {"reference", "context_artifact", "context_byte_offset", "kind_selector", "scope"}),
    "core:get_outline": (_outline, {"container"}, {"container", "depth", "filter", "include_non_public"}),
    "core:find_references": (_references, {"target"}, {"target", "relations", "reference_roles", "include_declarations", "filter"}),
    "core:expand_relations": (_expand, {"subjects"}, {"subjects", "direction", "relations", "min_depth", "max_depth", "path_policy", "filter"}),
    "core:find_paths": (_paths, {"source", "target"}, {"source", "target", "relations", "direction", "max_depth", "all_shortest"}),
    "core:search_text": (_search_text, {"pattern"}, {"pattern", "syntax", "case_sensitive", "word_mode", "filter", "result_projection"}),
    "core:search_semantic": (_search_semantic, {"vector"}, {"vector", "limit", "filter"}),
    "core:search_hybrid": (_search_hybrid, {"query_text"}, {"query_text", "query_class", "vector", "filter", "require_structural_subject"}),
    "core:get_source": (_get_source, {"subjects"}, {"subjects", "source", "include_related_evidence"}),
    "core:analyze_impact": (_impact, {"target", "change"}, {"target", "change", "include_transitive", "include_tests", "filter"}),
    "core:find_related_tests": (_tests, {"subjects"}, {"subjects", "relationship_scope", "include_fixtures", "filter"}),
    "core:inspect_architecture": (_architecture, set(), {"scope", "views", "max_relation_depth", "filter"}),
    "core:compare": (_compare, set(), {"selection", "comparison_kinds", "correlation_policy", "filter"}),
    "core:build_context": (_context, {"task"}, {"task", "seeds", "facets", "query_class", "filter"}),
    "core:index_status": (_status, set(), set()),
}


#: Arguments of the contract that the handlers don't apply: a request that gives one is refused.
NOT_APPLIED: dict[str, set[str]] = {
    "core:discover_definitions": {"include_full_definitions"},
    "core:resolve_symbol": {"context_byte_offset"},
    "core:search_hybrid": {"require_structural_subject", "query_class"},
    "core:get_source": {"include_related_evidence"},
    "core:build_context": {"query_class"},
}


def evaluate(corpus: Corpus, name: str, arguments: dict) -> Streams:
    """The streams of one operation; unknown names and arguments are refused."""
    if name not in OPERATIONS:
        raise QueryError("core:operation_unknown", name)
    handler, required, allowed = OPERATIONS[name]
    if required - set(arguments) or set(arguments) - allowed:
        raise QueryError("core:invalid_arguments", f"{name}: {sorted(required - set(arguments) | set(arguments) - allowed)}")
    if given := sorted(k for k in NOT_APPLIED.get(name, ()) if arguments.get(k) is not None and arguments[k] != {}):
        raise QueryError("core:required_capability_unsupported", f"{name}: {given}")
    return handler(corpus.snapshot(), arguments)
