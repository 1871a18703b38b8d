"""Lexical search (postings, TF-IDF, AND queries), line search with contexts, and vector top-k.

Postings are aggregated per document before the shuffle; a query touches only its own terms' postings, filtered at the
scan, and document counts come from the whole index, before filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import analyze_text, cosine, document_text

DEFAULT_LIMIT, MAX_LIMIT = 20, 200


def search_documents(df: DataFrame, doc_id: str, title: str, body: str) -> DataFrame:
    """doc_id, title, body, tokens, title_tokens."""
    return df.select(
        F.col(doc_id).alias("doc_id"), F.col(title).alias("title"), F.col(body).alias("body"),
        analyze_text(document_text(F.col(title), F.col(body))).alias("tokens"), analyze_text(F.col(title)).alias("title_tokens"),
    )


def postings(docs: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """term, doc_id, tf; with terms, only theirs, kept before rows are exploded."""
    tokens = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(list(terms)))
    return docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def query_terms(query: str) -> list[str]:
    """The analyzer of texts, for a query string on the driver."""
    import re

    return [t for t in re.split(r"\W+", query.lower()) if t]


def lexical_search(docs: DataFrame, query: str, limit: int = DEFAULT_LIMIT, offset: int = 0, keep: Column | None = None) -> DataFrame:
    """Documents with every query term, by score, then doc_id: doc_id, score, n_terms.

    A term adds (1 + ln tf) * ln(1 + N / df), doubled in the title; repeated query terms add again. keep filters hits
    after scoring, so N and df cover the whole index. Bad limits fail."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}, offset not negative")
    asked = query_terms(query)
    terms = sorted(set(asked))
    if not terms:
        raise ValueError("the query has no term")
    weights = F.create_map(*(F.lit(x) for t in terms for x in (t, asked.count(t))))
    posts = postings(docs, terms)
    found = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    titles = docs.select(F.col("doc_id").alias("t_id"), F.filter("title_tokens", lambda t: t.isin(terms)).alias("in_title")).filter(F.size("in_title") > 0)
    scored = (
        posts.join(F.broadcast(found), "term")
        .crossJoin(F.broadcast(total))  # one row
        .join(titles, F.col("doc_id") == F.col("t_id"), "left")
        .withColumn("part", (1 + F.log("tf")) * F.log(1 + F.col("n_docs") / F.col("df")) * F.element_at(weights, F.col("term")))
        .withColumn("part", F.when(F.array_contains("in_title", F.col("term")), F.col("part") * 2).otherwise(F.col("part")))
    )
    hits = scored.groupBy("doc_id").agg(F.sum("part").alias("raw"), F.count(F.lit(1)).alias("n_terms")).filter(F.col("n_terms") == len(terms))
    if keep is not None:
        hits = hits.join(docs.filter(keep).select("doc_id"), "doc_id", "left_semi")
    return hits.select("doc_id", F.round("raw", 6).alias("score"), "n_terms").orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (1-based), text: one row a line of whole texts."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "text")).select(key, (F.col("pos") + 1).cast("long").alias("line"), "text")


def line_matches(lines: DataFrame, key: str, terms: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """key, line, term, text for each term in a line (case ignored); keys that hold an ignored part are skipped."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.contains(t.lower()), F.lit(t)) for t in terms)))
    out = lines
    for part in ignore:
        out = out.filter(~F.lower(F.col(key).cast("string")).contains(part.lower()))
    return out.withColumn("term", F.explode(found)).select(key, "line", "term", "text")


def first_matches(matches: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` matches in scan order (key, term, line), by key, line and term, with a flag that the cap was met.

    Kept partition by partition first, so the single ordered pass sees at most `most` rows of each."""
    capped = matches.orderBy(key, "term", "line").limit(most)
    return capped.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) >= most).orderBy(key, "line", "term")


def line_context(lines: DataFrame, key: str, hit: Column, reach: int = 2) -> DataFrame:
    """key, line, context (the line with `reach` lines before and after, joined) of lines where hit holds."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-reach, reach)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n")).filter(hit).select(key, "line", "context")


def vector_top_k(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k nearest by cosine, ties by key; each task keeps its own k first."""
    if not 1 <= k <= 100:
        raise ValueError("k must be 1 to 100")
    asked = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), asked), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
