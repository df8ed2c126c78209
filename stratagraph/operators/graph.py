"""Graph operators over edges(edge_id, src, dst, kind, classification)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.relational import QueryError


def directed(edges: DataFrame, direction: str, kinds=()) -> DataFrame:
    """u, v, kind, edge_id, classification along a direction."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "kind", "edge_id", "classification")
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "kind", "edge_id", "classification")
    return {"outbound": out, "inbound": back}.get(direction) if direction != "both" else out.union(back)


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the session's checkpoint folder, which all executors share; one of its own only on a
    single machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if at is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


#: Rows that every executor may hold whole, as a set of ids.
FEW = 100_000


def held(df: DataFrame) -> DataFrame:
    """The rows, computed now; few of them meet a large table where that lies, which then isn't shuffled."""
    df = _cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def expand(edges: DataFrame, roots: DataFrame, *, direction: str = "outbound", min_depth: int = 1, max_depth: int | None = None, kinds=()) -> DataFrame:
    """id, depth, via (the smallest "source>kind" of the first reach): breadth-first from all roots at
    once; a node counts at its first depth, roots never again."""
    max_depth = min_depth if max_depth is None else max_depth
    if min_depth < 0 or max_depth < min_depth:
        raise QueryError("core:budget_invalid")
    step = directed(edges, direction, kinds).select("u", "v", "kind")
    keep = held if max_depth > 1 else lambda df: df
    seen = keep(roots.select(F.col("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).dropDuplicates(["id"]))
    frontier, known = seen, seen.select("id")
    for depth in range(1, max_depth + 1):
        reached = step.join(frontier.select(F.col("id").alias("u")), "u").groupBy("v").agg(F.min(F.concat_ws(">", "u", "kind")).alias("via"))
        frontier = keep(reached.join(known.select(F.col("id").alias("v")), "v", "left_anti").select(F.col("v").alias("id"), F.lit(depth).alias("depth"), "via"))
        seen = seen.union(frontier)
        if max_depth > 1 and frontier.isEmpty():
            break
        known = keep(known.union(frontier.select("id"))) if depth < max_depth else known
    return seen.where((F.col("depth") >= max(1, min_depth)) & (F.col("depth") <= max_depth))


def closure(edges: DataFrame, roots: DataFrame, *, direction: str = "outbound", kinds=()) -> DataFrame:
    """Everything reached, with its distance: expansion until the frontier is empty."""
    return expand(edges, roots, direction=direction, min_depth=1, max_depth=10_000, kinds=kinds)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_paths(edges: DataFrame, source: str, target: str, max_depth: int, *, direction: str = "outbound", kinds=(), all_shortest: bool = True) -> DataFrame:
    """path ("a>b>c"), length: levels from both ends, the side with fewer nodes going on, until they meet; then only edges
    that lead from a level to the next on the way to and from where they met; source == target has none."""
    if max_depth < 1:
        raise QueryError("core:budget_invalid")
    one = lambda name: edges.sparkSession.range(1).select(F.lit(name).cast("string").alias("id"))
    step = directed(edges, direction, kinds).select("u", "v")
    none = one(source).select(F.col("id").alias("path"), F.lit(0).alias("length")).limit(0)
    levels, seen, size = [[one(source)], [one(target)]], [one(source), one(target)], [1, 1]
    met = None
    while source != target and sum(map(len, levels)) - 2 < max_depth:
        k = 0 if size[0] <= size[1] else 1
        near, far = ("u", "v") if k == 0 else ("v", "u")
        new = step.join(levels[k][-1].withColumnRenamed("id", near), near, "left_semi").select(F.col(far).alias("id")).where("id is not null").distinct()
        new = held(new.join(seen[k], "id", "left_anti"))
        size[k] = new.count()
        levels[k].append(new)
        met = held(new.join(levels[1 - k][-1], "id", "left_semi"))
        if not size[k] or not met.isEmpty():
            break
        seen[k] = held(seen[k].union(new))
    if met is None or met.isEmpty():
        return none
    steps: dict[int, DataFrame] = {}
    length = sum(map(len, levels)) - 2
    for k, (here, there) in enumerate((("v", "u"), ("u", "v"))):
        at = met
        for i in range(len(levels[k]) - 2, -1, -1):
            pairs = step.join(at.withColumnRenamed("id", here), here, "left_semi").join(levels[k][i].withColumnRenamed("id", there), there, "left_semi")
            steps[i if k == 0 else length - 1 - i] = pairs = held(pairs.select("u", "v").distinct())
            at = held(pairs.select(F.col(there).alias("id")).distinct())
    paths = one(source).select(F.col("id").alias("tail"), F.col("id").alias("path"))
    for n in range(length):
        paths = paths.join(steps[n], F.col("tail") == F.col("u")).select(F.col("v").alias("tail"), F.concat_ws(">", "path", "v").alias("path"))
    found = paths.select("path", F.lit(length).alias("length"))
    return found if all_shortest else found.orderBy("length", "path").limit(1)


#: Paths that simple_paths may hold at a depth; beyond it the request is refused.
MOST_PATHS = 10_000_000


def simple_paths(edges: DataFrame, roots: DataFrame, max_depth: int, *, direction: str = "outbound", kinds=(), policy: str = "simple_subjects", most: int = MOST_PATHS) -> DataFrame:
    """root, path, length: all paths up to max_depth that repeat no subject (or no relation).  Their number may
    grow with a power of the depth: more than `most` at a depth of three or more is core:budget_exceeded, never a cut answer."""
    step = directed(edges, direction, kinds)
    now = roots.select(F.col("id").alias("root"), F.col("id").alias("tail"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("used"))
    out = None
    for depth in range(1, max_depth + 1):
        fresh = ~F.array_contains("nodes", F.col("v")) if policy == "simple_subjects" else ~F.array_contains("used", F.col("edge_id"))
        now = now.join(step, F.col("tail") == F.col("u")).where(fresh).select("root", F.col("v").alias("tail"), F.array_append("nodes", F.col("v")).alias("nodes"), F.array_append("used", F.col("edge_id")).alias("used"))
        if depth > 2:
            now = _cut(now)
            if now.count() > most:
                raise QueryError("core:budget_exceeded", f"more than {most} paths of {depth} relations")
        out = now if out is None else out.union(now)
    return out.select("root", F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("length"))


def references(edges: DataFrame, targets: DataFrame, kinds=()) -> DataFrame:
    """Edges into the targets(id): one join for a whole set."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return edges.join(held(targets.select(F.col("id").alias("dst")).distinct()), "dst", "left_semi")


def owners(edges: DataFrame, targets: DataFrame, kinds=()) -> DataFrame:
    return references(edges, targets, kinds).select(F.col("src").alias("id")).distinct()


def ancestors(edges: DataFrame, nodes: DataFrame, kinds=("core:contains", "core:defines")) -> DataFrame:
    return closure(edges, nodes, direction="inbound", kinds=kinds)


def related_tests(edges: DataFrame, subjects: DataFrame, scope: str = "both") -> DataFrame:
    """Sources of covering edges into the subjects (direct), what contains them (transitive), or both."""
    if scope not in ("direct", "transitive", "both"):
        raise QueryError("core:invalid_arguments", scope)
    around = ancestors(edges, subjects).select("id") if scope != "direct" else None
    targets = subjects.select("id") if scope == "direct" else around if scope == "transitive" else subjects.select("id").union(around)
    return owners(edges, targets.distinct(), ("core:covers",))


DEPENDS = ("core:call", "core:references", "core:import", "core:inherits", "core:implements")


def impact(edges: DataFrame, target: DataFrame, *, include_transitive: bool = True) -> dict[str, DataFrame]:
    """will_break: confirmed callers.  tests_to_run: tests of callers and target.  Rules of our own for the
    classes without one: must_update: confirmed references; may_be_affected: further transitive dependants;
    uncertain_dynamic_usage: possible dependants."""
    target = held(target.select("id").distinct())
    sure, unsure = edges.where("classification = 'confirmed'"), edges.where("classification <> 'confirmed'")
    will_break = owners(sure, target, ("core:call",))
    must_update = owners(sure, target, ("core:references", "core:import", "core:inherits", "core:implements"))
    far = closure(edges, target, direction="inbound", kinds=DEPENDS).select("id") if include_transitive else will_break.limit(0)
    return {
        "will_break": will_break,
        "must_update": must_update,
        "may_be_affected": far.join(will_break.union(must_update), "id", "left_anti"),
        "tests_to_run": related_tests(edges, target.select("id").union(will_break)),
        "uncertain_dynamic_usage": owners(unsure, target, DEPENDS),
    }


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges (u, v) left once nodes without a way in or out are taken away, again and again while a tenth goes: a long
    way without cycles would take a round for each of its steps."""
    size = None
    while True:
        e = _cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        now = e.count()
        if now == 0 or size is not None and now > 0.9 * size:
            return e
        size = now


def _spread_colours(e: DataFrame, colours: DataFrame, where: str = "true") -> DataFrame:
    """node, colour: the smallest colour that reaches a node along the edges, among those `where` allows."""
    while True:
        come = e.join(colours.select(F.col("node").alias("u"), "colour"), "u").join(colours.select(F.col("node").alias("v"), F.col("colour").alias("own")), "v").where(f"colour < own and {where}")
        better = come.groupBy("v").agg(F.min("colour").alias("new"))
        now = _cut(colours.join(better, F.col("node") == F.col("v"), "left").select("node", F.coalesce("new", "colour").alias("colour"), F.col("new").isNotNull().alias("changed")))
        if now.where("changed").isEmpty():
            return now.drop("changed")
        colours = now.drop("changed")


#: Edges whose components one task finds (as whole numbers in its memory); more are contracted by blocks first.
ONE_TASK = 1_000_000


def _search():
    """What finds the components of a table, made here so that workers get it whole: they may lack this package."""

    def strong(heads: list[int], to: list[int]) -> list[int]:
        """A node of each node's component, by Tarjan's algorithm: linear time, whatever the paths' length."""
        n = len(heads) - 1
        index, low, own, at = [0] * n, [0] * n, [-1] * n, heads[:-1]
        count, open_nodes = 0, []
        for root in range(n):
            way = [] if index[root] else [root]
            while way:
                x = way[-1]
                if not index[x]:
                    count += 1
                    index[x] = low[x] = count
                    open_nodes.append(x)
                if at[x] < heads[x + 1]:
                    y = to[at[x]]
                    at[x] += 1
                    if not index[y]:
                        way.append(y)
                    elif own[y] < 0:
                        low[x] = min(low[x], index[y])
                    continue
                way.pop()
                if low[x] == index[x]:
                    while own[x] < 0:
                        own[open_nodes.pop()] = x
                if way:
                    low[way[-1]] = min(low[way[-1]], low[x])
        return own

    def components(table: pa.Table) -> pa.Table:
        """id, component of the nodes on cycles of a table (u, v)."""
        both = pa.chunked_array([*table["u"].chunks, *table["v"].chunks], pa.string())
        ids = pc.unique(both)
        ids = ids.take(pc.sort_indices(ids))
        codes = pc.index_in(both, ids).to_numpy()
        u, v = codes[: len(table)], codes[len(table) :]
        order = np.argsort(u, kind="stable")
        heads = np.searchsorted(u[order], np.arange(len(ids) + 1))
        own = np.array(strong(heads.tolist(), v[order].tolist()), np.int64)
        smallest = np.full(len(ids), len(ids), np.int64)
        np.minimum.at(smallest, own, np.arange(len(ids)))
        ringed = np.bincount(own, minlength=len(ids))[own] > 1
        ringed[u[u == v]] = True
        part = np.flatnonzero(ringed)
        return pa.table({"id": ids.take(pa.array(part)), "component": ids.take(pa.array(smallest[own[part]]))})

    return components


def _components_at_once(e: DataFrame) -> DataFrame:
    """id, component of e(u, v)'s nodes on cycles, in one task."""
    components = _search()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("u", pa.string()), ("v", pa.string())]))
        yield from components(table).to_batches(10_000)

    return e.coalesce(1).mapInArrow(find, "id string, component string")


def _components_by_blocks(e: DataFrame, blocks: int) -> DataFrame:
    """id, component of nodes on cycles that lie within a block; the blocks are ranges of ids with about as many nodes each.
    Such a component is a part of one of the whole graph."""
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    block = _cut(nodes.repartitionByRange(blocks, "node").select("node", F.spark_partition_id().alias("block")))
    inside = e.join(block.toDF("u", "block"), "u").join(block.toDF("v", "_b"), "v").where("block = _b").select("u", "v", "block")
    components = _search()
    return _cut(inside.groupBy("block").applyInArrow(lambda table: components(table.select(["u", "v"])), "id string, component string"))


def _joined_up(own: DataFrame | None, found: DataFrame) -> DataFrame:
    """id, component of all nodes in components so far, after those in `own`, each under its component's id, were joined into `found`."""
    if own is None:
        return found
    to = found.select(F.col("id").alias("component"), F.col("component").alias("_c"))
    moved = own.join(to, "component", "left").select("id", F.coalesce("_c", "component").alias("component"))
    return _cut(moved.union(found.join(own.select("id"), "id", "left_anti").select("id", "component")))


def _components_by_colours(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, component of some of e(u, v)'s nodes on cycles, and the edges left to search, by forward and backward colouring:
    every node takes the smallest id that reaches it; whatever of a colour also reaches that id is its component."""
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    colours = _spread_colours(e, nodes.withColumn("colour", F.col("node")))
    # backward from each colour's own node, within the colour
    inside = _cut(e.join(colours.toDF("u", "cu"), "u").join(colours.toDF("v", "cv"), "v").where("cu = cv").select("u", "v", F.col("cu").alias("colour")))
    parts = inside.rdd.getNumPartitions()
    found = front = _cut(colours.where("node = colour"))
    while not front.isEmpty():
        back = inside.join(front.select(F.col("node").alias("v"), "colour"), ["v", "colour"]).select(F.col("u").alias("node"), "colour").distinct()
        front = _cut(back.join(found, ["node", "colour"], "left_anti"))
        found = _cut(found.union(front).coalesce(max(1, parts)))  # a union's partitions would grow with the rounds
    rings = found.join(inside.select(F.col("u").alias("node"), F.col("v").alias("to"), "colour"), ["node", "colour"]).join(found.select(F.col("node").alias("to"), "colour"), ["to", "colour"], "left_semi")
    part = _cut(rings.select(F.col("node").alias("id"), F.col("colour").alias("component")).distinct())
    gone = found.select("node")
    return part, _cut(e.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))


def cycles(edges: DataFrame, kinds=()) -> DataFrame:
    """id, component (its smallest id) of nodes on cycles.  Up to ONE_TASK edges are searched at once.  Of more, components
    within blocks of neighbouring ids are found side by side and each becomes one node, as long as a tenth of the edges goes
    by that; what is still more is coloured, in as many rounds as the longest way has steps.  Tables have a row a node or an edge."""
    every = directed(edges, "outbound", kinds).select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    e = _cut(every.distinct().where("u is not null and v is not null"))
    loops = e.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    own, count, turn = None, e.count(), 0
    while count > ONE_TASK:
        found = _components_by_blocks(e, -(-2 * count // max(1, ONE_TASK)) + turn % 2)  # other borders each time
        own, turn = _joined_up(own, found), turn + 1
        ends = [found.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in ("u", "v")]
        e = e.where("u <> v").join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
        e = _trimmed(_cut(e.where("u <> v").distinct()))
        before, count = count, e.count()
        if count > max(ONE_TASK, 0.9 * before):
            found, e = _components_by_colours(e)
            own, count = _joined_up(own, found), e.count()
    own = _joined_up(own, _cut(_components_at_once(e)))
    return own.union(loops.join(own.select("id"), "id", "left_anti").select("id", "component"))


def chain_confidence(links: DataFrame) -> DataFrame:
    """subject, confidence: links(subject, chain, confidence): a chain is as sure as its weakest link, a
    subject as its surest chain; confirmed links are neutral."""
    rank = F.when(F.col("confidence") == "low", 1).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "high", 3).otherwise(4)
    chains = links.groupBy("subject", "chain").agg(F.min(rank).alias("r"))
    best = chains.groupBy("subject").agg(F.max("r").alias("r"))
    return best.select("subject", F.when(F.col("r") == 1, "low").when(F.col("r") == 2, "medium").when(F.col("r") == 3, "high").otherwise("confirmed").alias("confidence"))
