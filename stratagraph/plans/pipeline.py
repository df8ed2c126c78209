"""Pipelines: an acyclic list of stages over operations and the set algebra, checked before anything runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stratagraph.functions import canonical_digest
from stratagraph.operators import relational
from stratagraph.operators.relational import QueryError
from stratagraph.plans.operations import Corpus, Streams, evaluate

ARITY = {"set.union": (2, None), "set.intersection": (2, None), "set.difference": (2, 2), "filter": (1, 1), "join": (2, 2), "deduplicate": (1, None), "select": (1, None), "source.operation": (0, None), "source.registry": (0, 0), "expand.operation": (1, 1), "expand.relations": (1, 1)}
DEFAULTS = {"budget": {"items": 50, "characters": 20_000}, "require_complete": False}


def _refs(value) -> list[tuple[str, str]]:
    if isinstance(value, dict):
        if set(value) == {"stage_id", "output"}:
            return [(value["stage_id"], value["output"])]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def normalize(request: dict) -> dict:
    """The request with defaults, checked, and the digest that names its manifest."""
    plan = DEFAULTS | request
    items, characters = plan["budget"].get("items", 50), plan["budget"].get("characters", 20_000)
    if not 1 <= items <= 100_000 or not 1 <= characters <= 10_000_000:
        raise QueryError("core:budget_invalid")
    if "stages" in plan:
        validate(plan["stages"], plan["outputs"])
    return plan | {"plan_digest": canonical_digest(plan)}


def validate(stages: list[dict], outputs: dict[str, dict]) -> None:
    """Unique ids, known operators with their arity, references to earlier stages only, every stage used."""
    seen: dict[str, dict] = {}
    used: dict[str, set[str]] = {}
    for s in stages:
        if s["id"] in seen or s["operator"] not in ARITY:
            raise QueryError("core:invalid_pipeline", s["id"])
        inputs = s.get("inputs", [])
        low, high = ARITY[s["operator"]]
        if len(inputs) < low or (high is not None and len(inputs) > high):
            raise QueryError("core:invalid_pipeline", f"{s['id']} takes {low} to {high} inputs")
        for stage, _ in [(i["stage_id"], i["output"]) for i in inputs] + _refs(s.get("arguments", {})):
            if stage not in seen:
                raise QueryError("core:stage_reference_invalid", stage)
            used.setdefault(s["id"], set()).add(stage)
        seen[s["id"]] = s
    reached, todo = set(), [o["stage_id"] for o in outputs.values()]
    while todo:
        x = todo.pop()
        if x not in seen:
            raise QueryError("core:stage_reference_invalid", x)
        if x not in reached:
            reached.add(x)
            todo += used.get(x, ())
    if reached != set(seen):
        raise QueryError("core:invalid_pipeline", f"unused: {sorted(set(seen) - reached)}")


def run(corpus: Corpus, stages: list[dict], outputs: dict[str, dict]) -> Streams:
    """The named outputs; every stage stays a lazy DataFrame."""
    validate(stages, outputs)
    done: dict[str, Streams] = {}

    def stream(ref: dict) -> DataFrame:
        streams = done[ref["stage_id"]]
        if ref["output"] not in streams:
            raise QueryError("core:stage_reference_invalid", ref["output"])
        return streams[ref["output"]]

    def bound(value):
        if isinstance(value, dict):
            return stream(value) if set(value) == {"stage_id", "output"} else {k: bound(v) for k, v in value.items()}
        return [bound(v) for v in value] if isinstance(value, list) else value

    def subjects(df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        classification = F.col("classification") if "classification" in df.columns else F.lit("confirmed")
        name = next(c for c in ("subject_id", "id", "record_id", "artifact_id", "src") if c in df.columns)
        return df.withColumn("classification", classification).withColumn("subject_id", F.col(name))

    for s in stages:
        inputs, a, op = [stream(i) for i in s.get("inputs", [])], s.get("arguments", {}), s["operator"]
        if op in ("source.operation", "expand.operation", "expand.relations"):
            name = s.get("operation", "core:expand_relations")
            arguments = bound(a) | ({s.get("field", "subjects"): inputs[0]} if inputs else {})
            done[s["id"]] = evaluate(corpus, name, arguments)
        elif op == "source.registry":
            done[s["id"]] = evaluate(corpus, "core:discover_definitions", a)
        elif op == "filter":
            done[s["id"]] = {"subjects": inputs[0].where(relational.predicate(a["predicate"]))}
        elif op == "set.difference":
            done[s["id"]] = {"subjects": relational.set_difference(*map(subjects, inputs))}
        elif op in ("set.union", "set.intersection"):
            f = relational.set_union if op == "set.union" else relational.set_intersection
            done[s["id"]] = {"subjects": f({f"{i:03}": subjects(df) for i, df in enumerate(inputs)})}
        elif op == "join":
            done[s["id"]] = {"subjects": relational.join(*map(subjects, inputs), a["mode"], a.get("output", "pairs"), edges=corpus.edges, direction=a.get("direction", "outbound"))}
        elif op == "deduplicate":
            rows = relational.set_union({f"{i:03}": subjects(df) for i, df in enumerate(inputs)}) if len(inputs) > 1 else subjects(inputs[0])
            key = {"subject": "subject_id", "entity": "entity_id", "artifact": "artifact_id", "portable_key": "portable_key"}[a.get("identity", "subject")]
            done[s["id"]] = {"subjects": relational.deduplicate(rows, key, order=[rows["subject_id"]], include_possible=a.get("include_possible", False))}
        else:
            done[s["id"]] = relational.select_outputs({i["output"]: df for i, df in zip(s["inputs"], inputs)}, a["outputs"])
    return {name: stream(o) for name, o in outputs.items()}
