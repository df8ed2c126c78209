"""Recipes: named stage lists.  A stage is (id, operation, bindings); a binding is a recipe argument ("$name"),
an upstream stream ("stage.output"), several joined ("a.x+b.y"), or a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.relational import QueryError
from stratagraph.plans.operations import Corpus, Streams, evaluate

SOURCE = {"source": {"mode": "relevant"}}
TREE = ("will_break", "must_update", "may_be_affected", "tests_to_run", "uncertain_dynamic_usage")
TESTS = ("tests", "fixtures", "mocks", "helpers")

RECIPES: dict[str, dict] = {
    "core:locate_implementation": {
        "stages": [("search", "core:search_hybrid", {"query_text": "$query_text", "filter": "$filter"}), ("implementations", "filter", {"input": "search.candidates", "any_facets": ["core:definition"]}), ("source", "core:get_source", {"subjects": "implementations.subjects", **SOURCE})],
        "outputs": {"implementations": "implementations.subjects", "sources": "source.sources"},
    },
    "core:understand_change_impact": {
        "stages": [("impact", "core:analyze_impact", {"target": "$target", "change": "$change"}), ("source", "core:get_source", {"subjects": "impact.all_classified_subjects", **SOURCE})],
        "outputs": {x: f"impact.{x}" for x in TREE} | {"sources": "source.sources"},
    },
    "core:prepare_symbol_change": {
        "stages": [("resolve", "core:resolve_symbol", {"reference": "$reference", "kind_selector": "$kind_selector"}), ("guard", "one_confirmed_subject", {"input": "resolve.declarations", "others": "resolve.candidates"}), ("impact", "core:analyze_impact", {"target": "resolve.declarations", "change": "$change"}), ("references", "core:find_references", {"target": "resolve.declarations"}), ("tests", "core:find_related_tests", {"subjects": "resolve.declarations"}), ("source", "core:get_source", {"subjects": "impact.all_classified_subjects+references.references+tests.tests", **SOURCE})],
        "outputs": {"target": "resolve.declarations", "references": "references.references", "sources": "source.sources"} | {x: f"impact.{x}" for x in TREE} | {x: f"tests.{x}" for x in TESTS},
    },
    "core:prepare_new_feature": {
        "stages": [("seeds", "core:search_hybrid", {"query_text": "$task", "filter": "$filter"}), ("analogues", "records_like", {"input": "seeds.candidates"}), ("architecture", "core:inspect_architecture", {"views": ["entry_points", "boundaries", "public_surfaces", "extension_points", "layers"]}), ("context", "core:build_context", {"task": "$task", "filter": "$filter"}), ("tests", "core:find_related_tests", {"subjects": "analogues.records"})],
        "outputs": {"analogues": "analogues.records", "architecture": "architecture.all_requested_views", "context": "context.context"} | {x: f"tests.{x}" for x in TESTS},
    },
    "core:trace_behavior": {
        "stages": [("trace", "core:expand_relations", {"subjects": "$subjects", "direction": "$direction", "relations": "$relations", "max_depth": "$max_depth", "min_depth": 1, "path_policy": "simple_relations"}), ("source", "core:get_source", {"subjects": "trace.subjects", **SOURCE})],
        "outputs": {"subjects": "trace.subjects", "relations": "trace.relations", "paths": "trace.paths", "sources": "source.sources"},
    },
    "core:find_relevant_tests": {
        "stages": [("tests", "core:find_related_tests", {"subjects": "$subjects"}), ("source", "core:get_source", {"subjects": "tests.tests+tests.fixtures+tests.mocks+tests.helpers", **SOURCE})],
        "outputs": {x: f"tests.{x}" for x in TESTS} | {"sources": "source.sources"},
    },
    "core:explain_architecture_slice": {
        "stages": [("architecture", "core:inspect_architecture", {"views": "$views"}), ("source", "core:get_source", {"subjects": "architecture.all_requested_views", **SOURCE})],
        "outputs": {"architecture": "architecture.all_requested_views", "sources": "source.sources"},
    },
    "core:compare_workspaces": {
        "stages": [("compare", "core:compare", {"correlation_policy": "strict"})],
        "outputs": {x: f"compare.{x}" for x in ("added", "removed", "changed", "moved", "correlated")},
    },
    "core:semantic_to_callers": {
        "stages": [("search", "core:search_hybrid", {"query_text": "$query_text", "filter": "$filter"}), ("callers", "core:expand_relations", {"subjects": "search.candidates", "direction": "inbound", "relations": {"universal_kinds": ["core:call"]}, "min_depth": 1, "max_depth": "$max_call_depth", "path_policy": "simple_relations"}), ("tests", "core:find_related_tests", {"subjects": "callers.subjects"}), ("source", "core:get_source", {"subjects": "search.candidates+callers.subjects+tests.tests", **SOURCE})],
        "outputs": {"matches": "search.candidates", "callers": "callers.subjects", "call_paths": "callers.paths", "tests": "tests.tests", "sources": "source.sources"},
    },
    "core:resolve_and_find_references": {
        "stages": [("resolve", "core:resolve_symbol", {"reference": "$reference"}), ("references", "core:find_references", {"target": "resolve.declarations"}), ("source", "core:get_source", {"subjects": "resolve.declarations+references.references", **SOURCE})],
        "outputs": {"declarations": "resolve.declarations", "candidates": "resolve.candidates", "references": "references.references", "owners": "references.owners", "sources": "source.sources"},
    },
    "core:definition_to_instances": {
        "stages": [("definitions", "core:discover_definitions", {"matcher": "$matcher", "selector": {"definition_types": ["record_kind", "facet", "language"]}}), ("instances", "instances_of", {"input": "definitions.definition_set"})],
        "outputs": {"definitions": "definitions.definitions", "instances": "instances.records"},
    },
}


def _bound(corpus: Corpus, value, arguments: dict, done: dict[str, Streams]):
    if isinstance(value, str) and value.startswith("$"):
        return arguments.get(value[1:])
    if isinstance(value, str) and all(x.count(".") == 1 and x.split(".")[0] in done for x in value.split("+")):
        streams = [done[s][o] for s, o in (x.split(".") for x in value.split("+"))]
        if len(streams) == 1:
            return streams[0]
        out = corpus.subjects(streams[0])
        for more in streams[1:]:
            out = out.union(corpus.subjects(more))
        return out.distinct()
    return value


def _special(corpus: Corpus, kind: str, a: dict) -> Streams:
    """Stages that only recipes have, and guards (a small action each)."""
    if kind == "filter":
        facets = F.array(*map(F.lit, a["any_facets"]))
        keep = corpus.records.where(F.arrays_overlap("facets", facets)).select(F.col("record_id").alias("id"))
        return {"subjects": a["input"].join(keep, "id", "left_semi")}
    if kind == "records_like":
        kinds = corpus.records.join(corpus.subjects(a["input"]).withColumnRenamed("id", "record_id"), "record_id", "left_semi").select("kind").distinct()
        return {"records": corpus.records.join(kinds, "kind", "left_semi")}
    if kind == "instances_of":  # an empty definition set selects nothing, never everything
        chosen: DataFrame = a["input"]
        if not chosen.where(~F.col("family").isin("record_kind", "facet", "language")).isEmpty():
            raise QueryError("core:invalid_definition_instance_selector")
        names = chosen.select(F.col("id").alias("_d"))
        each = corpus.records.withColumn("_d", F.explode(F.array_union(F.array("kind", "universal_kind"), "facets")))
        return {"records": each.join(names, "_d", "left_semi").drop("_d").dropDuplicates(["record_id"])}
    if len(a["input"].limit(2).collect()) != 1:
        raise QueryError("core:selector_not_found" if a["others"].isEmpty() else "core:selector_ambiguous")
    return {}


def run(corpus: Corpus, name: str, arguments: dict) -> Streams:
    """The recipe's outputs; stages stay lazy, guards run one small action."""
    if name not in RECIPES:
        raise QueryError("core:recipe_unknown", name)
    done: dict[str, Streams] = {}
    for stage, operation, bindings in RECIPES[name]["stages"]:
        bound = {k: v for k, v in ((k, _bound(corpus, v, arguments, done)) for k, v in bindings.items()) if v is not None}
        done[stage] = evaluate(corpus, operation, bound) if operation.startswith("core:") else _special(corpus, operation, bound)
    return {out: done[s][o] for out, (s, o) in ((k, v.split(".")) for k, v in RECIPES[name]["outputs"].items())}
