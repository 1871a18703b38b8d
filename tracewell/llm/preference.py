"""Preference formatting: common turn prefix rendered once, and paired completions with loss masks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template of a turn; the mask covers the text and the end mark of assistant turns.
HEAD, MID, END = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def gather_turns(turns: DataFrame, key: str) -> DataFrame:
    """turns(key, turn, role, text) -> key, turns: array<struct<turn, role, text>> in order.

    One conversation is one record. Rows that repeat exactly count once; different rows with one turn number are
    ordered by role and text, nulls first; a null role reads as 'unknown' and a null text as empty. Rows with a null
    key belong to no conversation and are left out."""
    return turns.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(_turn())).alias("turns"))


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns with equal role and text."""
    n = F.least(F.size(chosen), F.size(rejected))
    differs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.get(chosen, i)["role"] != F.get(rejected, i)["role"]) | (F.get(chosen, i)["text"] != F.get(rejected, i)["text"]),
    )
    first = F.array_position(differs, F.lit(True))
    return F.when(n <= 0, F.lit(0)).when(first > 0, first - 1).otherwise(n).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MID), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Character ranges [begin, end) of the rendered turns that count for the loss."""
    frame = len(HEAD) + len(MID)
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + frame + len(END)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin, end = acc["at"] + F.length(t["role"]) + frame, acc["at"] + size(t)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, chosen, rejected: gathered turns) -> key, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    The prompt is the longest common prefix, rendered once; spans mask the completions (the prompt never counts). Equal
    conversations have empty completions; a null side counts as one without turns."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r")).withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.size(side))
    return both.select(
        key, F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"),
        loss_spans(rest("c")).alias("chosen_spans"), loss_spans(rest("r")).alias("rejected_spans"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is the chosen side of one pair; its rejected side ends with the last turn of its neighbour (conv_id
    xor 1) instead of its own, or lacks a last turn where there is no neighbour. The table has no preferences of its own."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    gathered = gather_turns(turns, "conv_id")
    # the neighbour's last turn alone, so that whole conversations are shuffled once
    last = turns.filter("conv_id is not null").groupBy(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("of_conv")).agg(F.max(_turn()).alias("other"))
    head = F.slice("turns", F.lit(1), F.size("turns") - 1)
    pairs = gathered.join(last, F.col("conv_id") == F.col("of_conv"), "left").select(
        "conv_id", F.col("turns").alias("chosen"), F.when(F.col("other").isNotNull(), F.concat(head, F.array("other"))).otherwise(head).alias("rejected")
    )
    return format_pairs(pairs, "conv_id").withColumns({c: spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


ORACLE = r"""
WITH g AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS c
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), p AS (
  SELECT g.conv_id, g.c, list_concat(list_slice(g.c, 1, len(g.c) - 1), CASE WHEN o.c IS NULL THEN [] ELSE [o.c[-1]] END) AS r
  FROM g LEFT JOIN g o ON o.conv_id = xor(g.conv_id, 1)
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, least(len(c), len(r))) AS k FROM p
), s AS (
  SELECT conv_id, k, list_slice(c, 1, k) AS head, list_slice(c, k + 1, len(c)) AS c2, list_slice(r, k + 1, len(r)) AS r2 FROM n
)
SELECT conv_id, k::BIGINT AS n_prompt_turns,
  coalesce(array_to_string(list_transform(head, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c2, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r2, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c2) + 1), lambda i: c2[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(list_slice(c2, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)::BIGINT + length(c2[i].role) + 5)::VARCHAR || '-' ||
    (coalesce(list_sum(list_transform(list_slice(c2, 1, i), lambda t: length(t.role) + length(t.text) + 13)), 0)::BIGINT)::VARCHAR), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r2) + 1), lambda i: r2[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(list_slice(r2, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)::BIGINT + length(r2[i].role) + 5)::VARCHAR || '-' ||
    (coalesce(list_sum(list_transform(list_slice(r2, 1, i), lambda t: length(t.role) + length(t.text) + 13)), 0)::BIGINT)::VARCHAR), ','), '') AS rejected_spans
FROM s
"""
