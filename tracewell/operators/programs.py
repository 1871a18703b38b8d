"""Graphs of programs: the bounded graph around one program, native file targets, evidence graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut

# The bounds of a program graph.
MAX_DEPTH, MAX_PROGRAMS, MAX_NODES, MAX_EDGES, MAX_FILES, MAX_CALLS = 25, 500, 5000, 4000, 500, 200


@dataclass(frozen=True)
class Bounds:
    depth: int = MAX_DEPTH
    programs: int = MAX_PROGRAMS
    nodes: int = MAX_NODES
    edges: int = MAX_EDGES
    files: int = MAX_FILES
    calls: int = MAX_CALLS


@dataclass(frozen=True)
class ProgramGraph:
    nodes: DataFrame
    """id, type (PROGRAM, TABLE, COPY)"""
    edges: DataFrame
    """src, dst, type (CALLS_PROGRAM, USES_TABLE, INCLUDES_COPY)"""
    unresolved: DataFrame
    """name, status (unresolved, ambiguous) of programs that are called, or not followed for want of room"""
    reached: tuple[str, ...]
    """codes of the bounds that were met, in alphabetical order"""


def program_graph(facts: DataFrame, members: DataFrame, root: str, bounds: Bounds = Bounds()) -> ProgramGraph:
    """What a program reaches: facts(program, type, name), of types CALLS_PROGRAM, USES_TABLE and INCLUDES_COPY, and members(name, path).

    Breadth first, and the walk stops at a bound, so its cost follows the bounds and not the corpus: at most `files` programs
    with one source are read, `programs` visited, `calls` calls followed of each (the first by name), to `depth`. Nodes and
    edges beyond their bounds are left out, those of greater depth, then name, first. Names are trimmed and in upper case;
    calls of other than plain names are no edges. Only counts reach the driver."""
    name = lambda c: F.upper(F.trim(c))
    clean = facts.select(name("program").alias("src"), name("name").alias("dst"), "type").filter("dst <> ''").filter((F.col("type") != "CALLS_PROGRAM") | F.col("dst").rlike("^[A-Z0-9_#$@]+$")).distinct()
    known = members.groupBy(name("name").alias("node")).agg((F.countDistinct("path") == 1).alias("single"))
    sources = cut(known)
    place = F.row_number().over(Window.partitionBy("src", "type").orderBy("dst"))
    steps = cut(clean.withColumn("place", place).filter((F.col("type") != "CALLS_PROGRAM") | (F.col("place") <= bounds.calls + 1)))
    spark, reached = facts.sparkSession, set()
    frontier = spark.createDataFrame([(root.strip().upper(), 0)], "node string, depth int").join(sources.filter("single"), "node", "left_semi")
    visited = cut(spark.createDataFrame([(root.strip().upper(), 0)], "node string, depth int"))
    scanned = cut(frontier)
    frontier, n_visited, n_scanned, dropped = scanned, 1, scanned.count(), []
    for depth in range(1, bounds.depth + 2):
        calls = steps.filter((F.col("type") == "CALLS_PROGRAM") & (F.col("place") <= bounds.calls))
        called = frontier.select(F.col("node").alias("src")).join(calls, "src").select(F.col("dst").alias("node")).distinct()
        ahead = cut(called.join(visited, "node", "left_anti").join(sources.filter("single"), "node", "left_semi").withColumn("depth", F.lit(depth)))
        n_ahead = ahead.count()
        if n_ahead == 0:
            break
        if depth > bounds.depth:
            reached.add("MAX_DEPTH")
            break
        if n_ahead > bounds.programs - n_visited:
            reached.add("MAX_PROGRAMS")
            kept = cut(ahead.orderBy("node").limit(max(bounds.programs - n_visited, 0)))
            dropped.append(ahead.join(kept, "node", "left_anti").select("node"))
            ahead, n_ahead = kept, max(bounds.programs - n_visited, 0)
        visited, n_visited = cut(visited.unionByName(ahead)), n_visited + n_ahead
        if n_ahead > bounds.files - n_scanned:
            reached.add("MAX_FILES")
            n_ahead = max(bounds.files - n_scanned, 0)
            ahead = cut(ahead.orderBy("node").limit(n_ahead))
        scanned, n_scanned, frontier = cut(scanned.unionByName(ahead)), n_scanned + n_ahead, ahead
    mine = cut(steps.join(scanned.withColumnRenamed("node", "src"), "src"))
    if not mine.filter((F.col("type") == "CALLS_PROGRAM") & (F.col("place") > bounds.calls)).isEmpty():
        reached.add("MAX_CALLS")
        mine = mine.filter((F.col("type") != "CALLS_PROGRAM") | (F.col("place") <= bounds.calls))
    kind = F.when(F.col("type") == "USES_TABLE", "TABLE").when(F.col("type") == "INCLUDES_COPY", "COPY").otherwise("PROGRAM")
    ends = mine.select(F.col("dst").alias("id"), kind.alias("type"), (F.col("depth") + 1).alias("depth"))
    nodes = cut(visited.select(F.col("node").alias("id"), F.lit("PROGRAM").alias("type"), "depth").unionByName(ends).groupBy("id", "type").agg(F.min("depth").alias("depth")))
    if nodes.limit(bounds.nodes + 1).count() > bounds.nodes:
        reached.add("MAX_NODES")
        nodes = cut(nodes.orderBy("depth", "id", "type").limit(bounds.nodes))
    edges = mine.withColumn("kind", kind).join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind")), ["dst", "kind"], "left_semi")
    edges = cut(edges.join(nodes.filter("type = 'PROGRAM'").select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "type", "depth"))
    if edges.limit(bounds.edges + 1).count() > bounds.edges:
        reached.add("MAX_EDGES")
        edges = cut(edges.orderBy("depth", "src", "type", "dst").limit(bounds.edges))
    called = mine.filter("type = 'CALLS_PROGRAM'").select(F.col("dst").alias("node"))
    status = F.when(F.col("single").isNull(), "unresolved").otherwise("ambiguous")
    unresolved = called.distinct().join(sources, "node", "left").filter("single is null or not single").select(F.col("node").alias("name"), status.alias("status"))
    for part in dropped:
        unresolved = unresolved.unionByName(part.select(F.col("node").alias("name"), F.lit("unresolved").alias("status")))
    return ProgramGraph(nodes.select("id", "type"), edges.select("src", "dst", "type"), unresolved.distinct(), tuple(sorted(reached)))


def program_graph_summary(graph: ProgramGraph) -> DataFrame:
    """One row: numbers of programs, tables, copies, edges, unresolved and ambiguous names, and whether a bound cut the graph."""
    n = lambda t, k: F.count_if(F.col("type") == t).alias(k)
    left = graph.unresolved.agg(F.count(F.lit(1)).alias("n_unresolved"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"))
    counts = graph.nodes.agg(n("PROGRAM", "n_programs"), n("TABLE", "n_tables"), n("COPY", "n_copies"))
    one = counts.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(left)  # one row each
    return one.withColumn("truncated", F.lit(bool(graph.reached))).withColumn("reached", F.lit(",".join(graph.reached)))


def native_targets(operations: DataFrame, files: DataFrame) -> DataFrame:
    """operations(program, opcode, target), files(program, name, kind, keyed, line) -> program, opcode, target, file, kind, keyed, record.

    A declared file of that name (the first by line) is the target. Else the name is a record format: EXFMT goes to the program's
    only WORKSTN file, WRITE to its only PRINTER file or, without one, its only WORKSTN file. Others get nulls."""
    up = lambda c: F.upper(F.trim(c))
    declared = files.select(up("program").alias("program"), up("name").alias("name"), F.coalesce("kind", F.lit("FILE")).alias("kind"), F.coalesce("keyed", F.lit(False)).alias("keyed"), "line")
    first = declared.groupBy("program", "name").agg(F.min(F.struct("line", "kind", "keyed")).alias("d"))
    sole = lambda k: F.when(F.count_if(F.col("kind") == k) == 1, F.max(F.when(F.col("kind") == k, F.struct("name", "kind", "keyed")))).alias(k)
    only = declared.groupBy("program").agg(sole("WORKSTN"), sole("PRINTER"))
    ops = operations.select(up("program").alias("program"), up("opcode").alias("opcode"), up("target").alias("target"))
    met = ops.join(first.withColumnRenamed("name", "target"), ["program", "target"], "left").join(only, "program", "left")
    direct = F.when(F.col("d").isNotNull(), F.struct(F.col("target").alias("name"), F.col("d.kind"), F.col("d.keyed")))
    by_format = F.when(F.col("opcode") == "EXFMT", F.col("WORKSTN")).when(F.col("opcode") == "WRITE", F.coalesce("PRINTER", "WORKSTN"))
    t = F.coalesce(direct, F.when(F.col("target") != "", by_format))
    found = met.withColumn("t", t)
    record = F.when(F.col("d").isNull() & F.col("t").isNotNull(), F.col("target"))
    return found.select("program", "opcode", "target", F.col("t.name").alias("file"), F.col("t.kind").alias("kind"), F.col("t.keyed").alias("keyed"), record.alias("record"))


def evidence_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(type, name, file, line) and edges(src_type, src, type, dst_type, dst), repeated ones too -> one row each.

    Nodes: id, type, name, n_evidence (distinct file and line), first (the least). Edges: id, src, dst, type. Rows without a name or
    with an end that is no node are left out; evidence is counted before the shuffle, not gathered."""
    ident = lambda t, n: F.concat_ws(":", F.upper(F.trim(t)), F.upper(F.trim(n)))
    place = F.when(F.col("file").isNotNull(), F.struct("file", "line"))
    named = nodes.filter("trim(name) <> ''").select(ident(F.col("type"), F.col("name")).alias("id"), F.upper(F.trim("type")).alias("type"), F.upper(F.trim("name")).alias("name"), place.alias("place"))
    out = named.groupBy("id", "type", "name").agg(F.countDistinct("place").alias("n_evidence"), F.min("place").alias("first"))
    pairs = edges.select(ident(F.col("src_type"), F.col("src")).alias("src"), ident(F.col("dst_type"), F.col("dst")).alias("dst"), F.upper("type").alias("type")).distinct()
    ends = out.select("id")
    linked = pairs.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out, linked.select(F.concat_ws("|", "type", "src", "dst").alias("id"), "src", "dst", "type")
