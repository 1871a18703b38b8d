"""Graph operators over edge DataFrames: typed relations, closures, impact, neighbourhoods, paths, degrees.

Closures are frontier loops: each hop joins the frontier with the edges, drops what was visited and is checkpointed, so plans
stay small and lost executors cost one hop. Only an emptiness test and counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut

MAX_DEPTH = 25
#: Rows of a part in which equal edges meet.
PART_ROWS = 1_000_000
#: Hops after which the visited parts are written as one.
COMPACT = 4


def relations(parts: dict[str, tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """One typed edge table (src, dst, type) from {type: (rows, source column, source prefix, target column, target prefix)}.

    Equal edges meet in parts of about PART_ROWS rows, so more edges make more parts and not larger ones."""
    n = reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("type")) for kind, (rows, *_) in parts.items()]).count()
    edges = [
        rows.select(
            F.concat(F.lit(p + ":"), F.upper(F.trim(F.col(a).cast("string")))).alias("src"),
            F.concat(F.lit(q + ":"), F.upper(F.trim(F.col(b).cast("string")))).alias("dst"), F.lit(kind).alias("type"),
        )
        for kind, (rows, a, p, b, q) in parts.items()
    ]
    every = reduce(DataFrame.unionByName, edges).filter("src is not null and dst is not null")
    return every.repartition(-(-n // PART_ROWS), "src", "dst", "type").distinct() if n > PART_ROWS else every.distinct()


def graph_summary(edges: DataFrame) -> DataFrame:
    """type, n_edges, n_sources, n_targets. Each end is grouped by itself, so there is no copy of the edges for each count."""
    into = edges.groupBy("type", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("type").agg(F.sum("n").alias("n_edges"), F.count("dst").alias("n_targets"))
    out = edges.select("type", "src").distinct().groupBy("type").agg(F.count("src").alias("n_sources"))
    return into.join(out, into["type"].eqNullSafe(out["type"])).select(into["type"], "n_edges", "n_sources", "n_targets")


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, a: str = "src", b: str = "dst") -> DataFrame:
    """node, depth (least number of edges from a seed) of all nodes reached along a -> b; seeds(node) have depth 0."""
    visited = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    # the edges are computed once, not at each hop
    steps = cut(edges.select(F.col(a).alias("from_"), F.col(b).alias("node")).distinct())
    for depth in range(1, max_depth + 1):
        # neither side goes through the driver: what is small at one hop need not be at the next
        reached = frontier.select(F.col("node").alias("at")).hint("merge").join(steps.hint("merge"), F.col("at") == F.col("from_")).select("node").distinct()
        frontier = cut(reached.hint("merge").join(visited.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % COMPACT == 0:
            visited = cut(visited)
    return visited


def impact(edges: DataFrame, target: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node, scope of what depends on target: 'direct' users, and 'indirect' ones upstream of them.

    The target itself is no seed, so in a cycle it shows up among its own indirect dependants."""
    direct = edges.filter(F.col("dst") == target).select(F.col("src").alias("node")).distinct()
    reached = closure(edges, direct, max_depth, "dst", "src")
    return reached.select("node", F.when(F.col("depth") == 0, "direct").otherwise("indirect").alias("scope"), (F.col("depth") + 1).cast("long").alias("depth"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, edges with both ends among them), edges taken both ways."""
    pairs = edges.select("src", "dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    nodes = closure(both, seeds, hops)
    return nodes, induced(edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are in nodes."""
    ends = nodes.select("node")
    return edges.join(ends, edges["src"] == ends["node"], "left_semi").join(ends.withColumnRenamed("node", "other"), F.col("dst") == F.col("other"), "left_semi")


def paths(edges: DataFrame, seeds: DataFrame, max_edges: int, types: list[str] | None = None) -> DataFrame:
    """node, path (ids and edge types in turn) of a shortest undirected path from a seed, the least one where several are."""
    kept = edges if types is None else edges.filter(F.col("type").isin(types))
    both = kept.select("src", "dst", "type").unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    visited = cut(seeds.select("node").distinct().withColumn("path", F.array("node")))
    frontier = visited
    for _ in range(max_edges):
        grown = frontier.select(F.col("node").alias("at"), "path").join(both, F.col("at") == F.col("src"))
        grown = grown.select(F.col("dst").alias("node"), F.concat("path", F.array("type", "dst")).alias("path"))
        grown = grown.groupBy("node").agg(F.min("path").alias("path")).join(visited.select("node"), "node", "left_anti")
        frontier = cut(grown)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def degrees(edges: DataFrame) -> DataFrame:
    """node, incoming, outgoing; each side is aggregated before they meet."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    zero = F.lit(0).cast("long")
    return into.join(out, "node", "full_outer").select("node", F.coalesce("incoming", zero).alias("incoming"), F.coalesce("outgoing", zero).alias("outgoing"))


def resolve_callees(calls: DataFrame, members: DataFrame) -> DataFrame:
    """calls(caller, callee), members(name, path) -> caller, callee, status, path: none unresolved, one resolved, more ambiguous."""
    known = members.groupBy(F.upper(F.trim("name")).alias("m_name")).agg(F.countDistinct("path").alias("n_paths"), F.min("path").alias("path"))
    joined = calls.join(known, F.upper(F.trim("callee")) == F.col("m_name"), "left")
    status = F.when(F.col("n_paths").isNull(), "unresolved").when(F.col("n_paths") == 1, "resolved").otherwise("ambiguous")
    return joined.select("caller", "callee", status.alias("status"), F.when(F.col("n_paths") == 1, F.col("path")).alias("path"))


def bounded_closure(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int) -> tuple[DataFrame, list[str]]:
    """closure() cut at max_nodes by depth and name, with the codes of the bounds that were met."""
    nodes = closure(edges, seeds, max_depth)
    codes = []
    ahead = nodes.filter(F.col("depth") == max_depth).select(F.col("node").alias("at")).join(edges, F.col("at") == F.col("src")).select(F.col("dst").alias("node"))
    if not ahead.join(nodes, "node", "left_anti").isEmpty():
        codes.append("MAX_DEPTH")
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        codes.append("MAX_NODES")
        nodes = nodes.orderBy("depth", "node").limit(max_nodes)
    return nodes, codes


def topological_order(before: dict[str, list[str]]) -> list[str]:
    """Stage names so that each comes after those it names; registration order breaks ties; a cycle fails (driver side, tens of stages)."""
    left, done = dict(before), []
    while left:
        ready = next((n for n, needs in left.items() if all(x in done or x not in before for x in needs)), None)
        if ready is None:
            raise ValueError(f"stages form a cycle: {sorted(left)}")
        done.append(ready)
        del left[ready]
    return done


def lineage_mentions(nodes: DataFrame, label: str, target: str, cap: int = 30) -> DataFrame:
    """Nodes whose label contains target, case ignored, the first `cap` by label."""
    return nodes.filter(F.upper(label).contains(target.upper())).orderBy(label).limit(cap)


def mermaid(edges: DataFrame) -> DataFrame:
    """One line of graph text an edge, in order: text."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), safe("src"), F.lit(" -->|"), F.col("type"), F.lit("| "), safe("dst"))
    return edges.select(line.alias("text"), F.row_number().over(Window.orderBy("src", "dst", "type")).alias("line"))
