"""Selection, set algebra and joins over records and subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import matches_any, name_tail


class QueryError(ValueError):
    """A query refused with one of the contract's error codes."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code} {detail}".strip())
        self.code = code


def visible(generation: int) -> Column:
    """Half-open interval: valid_from <= g < valid_to, an absent end being open."""
    return (F.col("valid_from") <= generation) & (F.col("valid_to").isNull() | (F.col("valid_to") > generation))


def kind_selector(*, kinds=(), universal_kinds=(), all_facets=(), any_facets=(), excluded_facets=()) -> Column:
    """Fields combine by AND; values of a field by OR (all_facets: by AND)."""
    facets = F.coalesce(F.col("facets"), F.array().cast("array<string>"))
    tests = [F.lit(True)]
    tests += [F.col("kind").isin(*kinds)] if kinds else []
    tests += [F.col("universal_kind").isin(*universal_kinds)] if universal_kinds else []
    tests += [F.array_contains(facets, f) for f in all_facets]
    tests += [F.arrays_overlap(facets, F.array(*map(F.lit, any_facets)))] if any_facets else []
    tests += [~F.arrays_overlap(facets, F.array(*map(F.lit, excluded_facets)))] if excluded_facets else []
    return reduce(Column.__and__, tests)


def structural_filter(*, paths=(), languages=(), namespaces=(), include_external=False, include_generated=False, kind=None) -> Column:
    """Hard eligibility of artifacts; a null language is out as soon as languages are named."""
    tests = [F.lit(True)]
    tests += [matches_any(F.col("path"), list(paths))] if paths else []
    tests += [F.coalesce(F.col("language").isin(*languages), F.lit(False))] if languages else []
    tests += [F.col("namespace").isin(*namespaces)] if namespaces else []
    kinds = F.coalesce(F.col("artifact_kind"), F.lit(""))
    tests += [] if include_external else [~kinds.contains("external")]
    tests += [] if include_generated else [~kinds.contains("generated")]
    tests += [kind_selector(**kind)] if kind else []
    return reduce(Column.__and__, tests)


LEAVES = {"path": "path", "language": "language", "namespace": "namespace", "subject_type": "category", "kind": "kind", "universal_kind": "universal_kind", "evidence_class": "classification", "confidence": "confidence", "completeness": "completeness", "participant_role": "participant_role"}


def predicate(tree: dict, depth: int = 0) -> Column:
    """A tree of all / any / not and leaves {field: [values]}; one key in each node, depth at most 32."""
    if depth > 32 or not isinstance(tree, dict) or len(tree) != 1:
        raise QueryError("core:invalid_filter", str(tree)[:80])
    (key, value), = tree.items()
    if key in ("all", "any"):
        if not value:
            raise QueryError("core:invalid_filter", f"{key} is empty")
        return reduce(Column.__and__ if key == "all" else Column.__or__, [predicate(x, depth + 1) for x in value])
    if key == "not":
        return ~predicate(value, depth + 1)
    if not value:
        raise QueryError("core:invalid_filter", f"{key} has no values")
    if key == "facet":
        return F.coalesce(F.arrays_overlap("facets", F.array(*map(F.lit, value))), F.lit(False))
    if key == "path":
        return F.coalesce(matches_any(F.col("path"), value), F.lit(False))
    if key not in LEAVES:
        raise QueryError("core:invalid_filter", key)
    return F.coalesce(F.col(LEAVES[key]).isin(*value), F.lit(False))


def find_records(records: DataFrame, *, generation: int | None = None, categories=(), filter: dict | None = None, **kind) -> DataFrame:
    """Records that satisfy a selector; at least one field must be given."""
    if not (categories or filter or any(kind.values())):
        raise QueryError("core:invalid_selector", "no field")
    out = records.where(visible(generation)) if generation is not None else records
    out = out.where(F.col("category").isin(*categories)) if categories else out
    return out.where(kind_selector(**kind)).where(predicate(filter) if filter else F.lit(True))


def lookup_any_id(records: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Records whose record id or identity key is asked for, each once.  A list of ids is a filter that reaches
    the scan; for a table of them (one column id) two semi joins, neither of which copies a record."""
    if not isinstance(ids, DataFrame):
        return records.where(F.col("record_id").isin(ids) | F.col("identity_key").isin(ids)).dropDuplicates(["record_id"])
    wanted = ids.select("id").distinct()
    found = [records.join(wanted.withColumnRenamed("id", c), c, "left_semi").select(records.columns) for c in ("record_id", "identity_key")]
    return found[0].union(found[1]).dropDuplicates(["record_id"])


def with_identity(records: DataFrame, identities: DataFrame, generation: int) -> DataFrame:
    """Records at a generation, each with its identity's row where one is visible then."""
    return records.where(visible(generation)).join(identities.where(visible(generation)).drop("valid_from", "valid_to"), "identity_key", "left")


def lookup_name_tail(records: DataFrame, name: str) -> DataFrame:
    return records.where(name_tail(F.col("identity_key")) == name)


def resolve_symbol(records: DataFrame, name: str, *, context_owner: str | None = None, scope: str | None = None, **kind) -> DataFrame:
    """Declarations of a name; `ambiguous` if several.  scope: visible (the default with a context: its own owner's
    if there are any, else all), workspace (the default without one), exports (exported declarations only)."""
    scope = scope or ("workspace" if context_owner is None else "visible")
    if scope not in ("visible", "workspace", "exports"):
        raise QueryError("core:invalid_arguments", scope)
    found = records.where((F.col("name") == name) | (F.col("identity_key") == name)).where(kind_selector(**kind))
    found = found.where(F.coalesce(F.array_contains("facets", "core:exported"), F.lit(False))) if scope == "exports" else found
    if scope == "visible" and context_owner is not None:
        near = found.where(F.col("parent_id").eqNullSafe(F.lit(context_owner)))
        some = F.broadcast(near.agg((F.count(F.lit(1)) > 0).alias("_any")))  # one row
        found = found.join(some).where(F.col("parent_id").eqNullSafe(F.lit(context_owner)) | ~F.col("_any")).drop("_any")
    many = F.broadcast(found.agg((F.count(F.lit(1)) > 1).alias("ambiguous")))  # one row
    return found.join(many)


# ---------------------------------------------------------------- sets

def set_union(inputs: dict[str, DataFrame]) -> DataFrame:
    """subject_id, classification (confirmed wins), provenance (input names, sorted)."""
    rows = reduce(DataFrame.unionByName, [df.select("subject_id", "classification").withColumn("_from", F.lit(n)) for n, df in inputs.items()])
    return rows.groupBy("subject_id").agg(F.when(F.bool_or(F.col("classification") == "confirmed"), "confirmed").otherwise("possible").alias("classification"), F.array_join(F.array_sort(F.collect_set("_from")), ",").alias("provenance"))


def set_intersection(inputs: dict[str, DataFrame]) -> DataFrame:
    both = set_union(inputs)
    return both.where(F.size(F.split("provenance", ",")) == len(inputs))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("subject_id").distinct(), "subject_id", "left_anti")


def deduplicate(df: DataFrame, key: str, *, order: list[Column], include_possible: bool = False) -> DataFrame:
    """The first row of each identity; portable keys may unite different subjects, so they need include_possible."""
    if key == "portable_key" and not include_possible:
        raise QueryError("core:invalid_deduplication", "portable_key needs include_possible")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


#: Parts of a key's pairs, made side by side.
SPREAD = 16


def _spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join by a key, few of which may have nearly all rows: each key's left rows are dealt out into SPREAD parts that
    all meet the right ones.  The numbers of partitions are given, so that a small input with a large output isn't put together."""
    n = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deal = F.pmod(F.xxhash64("left_id"), F.lit(SPREAD)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    dealt = left.withColumn("_s", deal).repartition(n, key, "_s").sortWithinPartitions(key, "_s")
    return dealt.join(right.withColumn("_s", parts).repartition(n, key, "_s"), [key, "_s"])


def _pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    """left_id, right_id of distinct (left_id, _k) and (right_id, _k): subjects that share several keys pair at the least."""
    keys = lambda df, c: df.where("_k is not null").groupBy(c).agg(F.collect_set("_k").alias(f"_{c}")).select(c, f"_{c}", F.explode(f"_{c}").alias("_k"))
    both = _spread(keys(one, "left_id"), keys(other, "right_id"), "_k")
    least = F.array_min(F.array_intersect("_left_id", "_right_id"))
    single = (F.size("_left_id") == 1) | (F.size("_right_id") == 1)
    return both.where(single | (F.col("_k") == least)).select("left_id", "right_id")


def _grouped(one: DataFrame, other: DataFrame) -> DataFrame:
    """left_id, right_ids of distinct (left_id, _k) and (right_id, _k)."""
    held = one.join(other.select("_k").distinct(), "_k", "left_semi").groupBy("left_id").agg(F.array_sort(F.collect_set("_k")).alias("_keys"))
    sets = held.select("_keys").distinct()
    rights = sets.select("_keys", F.explode("_keys").alias("_k")).join(other, "_k").groupBy("_keys").agg(F.array_join(F.array_sort(F.collect_set("right_id")), ",").alias("right_ids"))
    return _spread(held, rights, "_keys").select("left_id", "right_ids")


JOINS = {"same_subject": "subject_id", "same_entity": "entity_id", "same_artifact": "artifact_id", "portable_key_equal": "portable_key"}


def join(left: DataFrame, right: DataFrame, mode: str, output: str = "pairs", *, edges: DataFrame | None = None, direction: str = "outbound") -> DataFrame:
    """Of two subject tables: pairs (left_id, right_id), the left or right rows that pair, or grouped (left_id, right_ids).
    Pairs by a key are as many as the product of its subjects on both sides, so they are made where they are needed, each
    once, and not shuffled; grouped collects each set of keys once, not once for every subject that has it."""
    if mode not in (*JOINS, "relation_exists") or output not in ("pairs", "left", "right", "grouped"):
        raise QueryError("core:invalid_join", f"{mode} {output}")
    if output == "right":
        flipped = {"outbound": "inbound", "inbound": "outbound"}.get(direction, direction)
        return join(right, left, mode, "left", edges=edges, direction=flipped)
    if mode == "relation_exists":
        ways = [edges.select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"))] if direction in ("outbound", "both") else []
        ways += [edges.select(F.col("dst").alias("left_id"), F.col("src").alias("right_id"))] if direction in ("inbound", "both") else []
        by = reduce(DataFrame.union, ways).distinct()
        by = by.join(left.select(F.col("subject_id").alias("left_id")).distinct(), "left_id", "left_semi")
        pairs = by.join(right.select(F.col("subject_id").alias("right_id")).distinct(), "right_id", "left_semi").select("left_id", "right_id")
    elif output == "left":
        key = JOINS[mode]
        return left.join(right.select(key).distinct(), key, "left_semi")
    else:
        key = JOINS[mode]
        one = left.select(F.col("subject_id").alias("left_id"), F.col(key).alias("_k")).distinct()
        other = right.select(F.col("subject_id").alias("right_id"), F.col(key).alias("_k")).distinct()
        return _grouped(one, other) if output == "grouped" else _pairs(one, other)
    if output == "left":
        return left.join(pairs.select(F.col("left_id").alias("subject_id")).distinct(), "subject_id", "left_semi")
    if output == "grouped":
        return pairs.groupBy("left_id").agg(F.array_join(F.array_sort(F.collect_set("right_id")), ",").alias("right_ids"))
    return pairs


def select_outputs(inputs: dict[str, DataFrame], outputs: list[dict]) -> dict[str, DataFrame]:
    """Named outputs {name, input, projection (columns), filter?} of declared inputs."""
    names = [o["name"] for o in outputs]
    if len(set(names)) != len(names) or any(o["input"] not in inputs for o in outputs):
        raise QueryError("core:invalid_select")
    return {o["name"]: (inputs[o["input"]].where(predicate(o["filter"])) if o.get("filter") else inputs[o["input"]]).select(*o["projection"]) for o in outputs}
