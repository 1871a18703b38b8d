"""Context packages: lexical hits, their neighbourhood and their evidence, packed bucket by bucket under one token budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.candidates import workflow_score
from tracewell.functions.text import content_hash, estimate_tokens
from tracewell.operators import budget, graph
from tracewell.session import cut

BODY_CHARS = 1500
# Scores of the summary, of graph seeds and neighbours, and of evidence that the graph leads to.
SUMMARY_SCORE, SEED_SCORE, NEIGHBOUR_SCORE, EVIDENCE_SCORE = 1e9, 1000.0, 100.0, 50.0
_ITEM = ("bucket", "id", "kind", "title", "body", "text", "score", "reason")


def seed_ids(hits: DataFrame) -> DataFrame:
    """hits(id, ...) -> node: ids of the symbols that the hits stand for (doc:symbol:X is X, sym:... itself; others lead nowhere)."""
    own = F.when(F.col("id").startswith("doc:symbol:"), F.expr("substring(id, 12)")).when(F.col("id").startswith("sym:"), F.col("id"))
    return hits.select(own.alias("node")).filter("node is not null").distinct()


def _item(bucket: str, id_, kind, title, text, score, body=None, reason=None):
    null = F.lit(None).cast("string")
    return [F.lit(bucket).alias("bucket"), id_.alias("id"), kind.alias("kind"), title.alias("title"), (null if body is None else body).alias("body"), text.alias("text"), score.cast("double").alias("score"), (null if reason is None else reason).alias("reason")]


def context_package(
    hits: DataFrame, symbols: DataFrame, relationships: DataFrame, evidence: DataFrame, contents: DataFrame, query: str,
    total: int = 4000, hops: int = 1, project: str = "project", snapshot: str = "current", diagnostics: DataFrame | None = None,
) -> DataFrame:
    """Five buckets (summary, graph, source, diagnostics, unresolved), each packed greedily by score, then id, under its share of the budget.

    hits(id, kind, title, score, path, hash), symbols(id, name, kind, unit), relationships(src, dst, type), evidence(id, unit, path,
    hash), contents(path, content), diagnostics(id, title, text, score) -> bucket, id, kind, score, cost, status.

    Seeds and their neighbours within the hops are graph items, unresolved symbols among them also unresolved items. Source items are
    the hits and the evidence of the neighbourhood's units, one an id (the best score); a hash that the content does not have is
    STALE, a content that is not there MISSING, and neither is packed. The cost is that of the item as JSON, verified bodies (cut
    at BODY_CHARS) included. status: SELECTED, TOKEN_BUDGET, STALE or MISSING."""
    c, seeds = F.col, seed_ids(hits)
    nodes, _ = graph.neighbourhood(relationships, seeds, hops)
    near = cut(nodes.join(symbols.select(c("id").alias("node"), c("name").alias("s_name"), c("kind").alias("s_kind"), "unit"), "node", "left"))  # met three times
    named = F.when(c("s_name").isNotNull(), F.concat("s_kind", F.lit(" "), "s_name", F.lit(" ("), "node", F.lit(")"))).otherwise(F.concat(F.lit("symbol "), "node"))
    worth = F.when(c("depth") == 0, SEED_SCORE).otherwise(NEIGHBOUR_SCORE)
    title = F.coalesce("s_name", "node")
    graph_items = near.select(*_item("graph", c("node"), F.lit("symbol"), title, named, worth))
    unresolved = near.filter("s_kind = 'UNRESOLVED_SYMBOL'").select(*_item("unresolved", c("node"), F.lit("unresolved"), title, named, worth))

    n_seeds, n_nodes = seeds.agg(F.count(F.lit(1)).alias("n_seeds")), nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    told = F.concat(F.lit(f"Project {project} snapshot {snapshot}. Query: {query}. Seeds: "), "n_seeds", F.lit(". Neighborhood: "), "n_nodes", F.lit("."))
    summary = n_seeds.crossJoin(n_nodes).select(*_item("summary", F.lit(f"summary:{project}:{snapshot}"), F.lit("summary"), F.lit("project-snapshot"), told, F.lit(SUMMARY_SCORE)))  # one row each

    linked = near.filter("unit is not null").select("unit").join(evidence.select(c("id").alias("e_id"), "unit", "path", "hash"), "unit")
    found = linked.select(F.concat(F.lit("doc:evidence:"), "e_id").alias("id"), F.lit("evidence").alias("kind"), F.coalesce("path", "e_id").alias("title"), F.lit(EVIDENCE_SCORE).alias("score"), "path", "hash")
    asked = hits.select("id", F.coalesce("kind", F.lit("source-unit")).alias("kind"), F.coalesce("title", "id").alias("title"), F.coalesce(c("score"), F.lit(0.0)).alias("score"), "path", "hash")
    best = budget.best_per_key(asked.unionByName(found), "id", -c("score"), c("kind"), c("title"), c("path"), c("hash"))
    claims = best.filter("hash is not null").select("id", "path", "hash")
    checked = verified_sources(contents, claims).select("id", c("status").alias("reason"), "body")
    sources = best.join(checked, "id", "left").select(*_item("source", c("id"), c("kind"), c("title"), F.coalesce("body", "title"), c("score"), c("body"), F.when(c("reason") != "OK", c("reason"))))

    items = summary.unionByName(graph_items).unionByName(sources).unionByName(unresolved)
    if diagnostics is not None:
        items = items.unionByName(diagnostics.select(*_item("diagnostics", c("id"), F.lit("diagnostic"), c("title"), c("text"), c("score"))))
    shares = budget.budget_slices(items.sparkSession, total).select(c("name").alias("bucket"), "tokens")  # five rows
    payload = F.to_json(F.struct("id", "kind", "title", "body", "text"))
    costed = items.withColumn("cost", estimate_tokens(payload)).join(F.broadcast(shares), "bucket")
    packed = budget.pack_with_omissions(costed.filter("reason is null"), "bucket", [-c("score"), c("id")], "tokens")
    left_out = costed.filter("reason is not null").withColumn("omitted", F.lit(True))
    status = F.coalesce("reason", F.when(c("omitted"), "TOKEN_BUDGET"), F.lit("SELECTED"))
    return packed.unionByName(left_out).select("bucket", "id", "kind", "score", "cost", status.alias("status"))


def verified_sources(units: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(path, hash, ...) against units(path, content): path, the claims' other columns, status (OK, MISSING, STALE), body cut at BODY_CHARS where OK."""
    # joined first, so that only claimed contents are hashed
    both = claims.join(units.select("path", "content"), "path", "left").withColumn("now", content_hash(F.col("content")))
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("now") != F.col("hash"), "STALE").otherwise("OK")
    kept = [c for c in claims.columns if c not in ("path", "hash")]
    return both.select("path", *kept, status.alias("status"), F.when(status == "OK", F.substring("content", 1, BODY_CHARS)).alias("body"))


#: The order in which categories give their first item.
CATEGORY_ORDER = {"errorAnalysis": ("errorPaths", "sql", "calls", "fileUsage", "conditionals")}
OTHER_ORDER = ("sql", "fileUsage", "calls", "conditionals", "errorPaths")


def workflow_selection(items: DataFrame, workflow: str, total: int, caps: Mapping[str, int]) -> DataFrame:
    """items(id, category, score, cost) -> id, cost, place of what a workflow takes under max(120, total - 220) tokens.

    First the best item by score of every category, in the workflow's order of categories, then all others by the score weighed for the workflow.
    The first item of all is taken whatever it costs; a later one if it fits what is left and its category has taken fewer than its cap; only what is
    taken counts. Ties go to the lesser id; categories without a cap give nothing; null scores and costs count as 0.

    Of a category's items of one cost only the first `cap` can be taken: where one is refused, so are those after it. The fold sees no others, so its
    size follows budget and caps, not the table."""
    budget_, order = max(120, total - 220), CATEGORY_ORDER.get(workflow, OTHER_ORDER)
    number = F.element_at(F.create_map(*(x for k, c in enumerate(order) for x in (F.lit(c), F.lit(k)))), F.col("category"))
    cap = F.element_at(F.create_map(*(x for c in order for x in (F.lit(c), F.lit(int(caps.get(c, 0)))))), F.col("category"))
    zero = F.lit(0).cast("long")
    known = items.filter(F.col("category").isin(*order)).select("id", "category", F.coalesce("score", F.lit(0)).alias("score"), F.greatest(F.coalesce(F.col("cost").cast("long"), zero), zero).alias("cost"), number.alias("number"), cap.alias("cap")).filter("cap > 0")
    heads = known.groupBy("number").agg(F.min_by(F.struct("id", "cost", "number"), F.struct(-F.col("score"), "id")).alias("h")).select("h.*")
    rest = known.join(heads.select("id"), "id", "left_anti").withColumn("weighed", workflow_score(F.col("category"), F.col("score"), workflow))
    # taken items are at most the heads and the caps, so a cost beyond the budget can only be a head's
    place = F.row_number().over(Window.partitionBy("number", "cost").orderBy(F.desc("weighed"), "id"))
    able = rest.filter(F.col("cost") <= budget_).withColumn("place", place).filter("place <= cap")
    kind = items.schema["id"].dataType.simpleString()
    entry = lambda phase, key: F.struct(F.lit(phase).alias("phase"), key.cast("double").alias("key"), F.col("id"), F.col("cost"), F.col("number")).alias("e")
    every = heads.select(entry(0, F.col("number"))).unionByName(able.select(entry(1, -F.col("weighed"))))
    listed = every.agg(F.array_sort(F.collect_list("e")).alias("listed"))
    most = F.array(*(F.lit(int(caps.get(c, 0))) for c in order))
    start = F.struct(zero.alias("used"), F.array(*(F.lit(0) for _ in order)).alias("counts"), F.array().cast(f"array<struct<id:{kind},cost:bigint>>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        fits = (F.get(acc["counts"], x["number"]) < F.get(most, x["number"])) & ((acc["used"] + x["cost"] <= budget_) | (F.size(acc["out"]) == 0))
        counts = F.transform(acc["counts"], lambda n, i: n + (i == x["number"]).cast("int"))
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), counts.alias("counts"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), x["cost"].alias("cost")))).alias("out"))).otherwise(acc)

    taken = listed.select(F.posexplode(F.aggregate("listed", start, take, lambda acc: acc["out"])).alias("place", "x"))
    return taken.select("x.id", "x.cost", (F.col("place") + 1).cast("long").alias("place"))
