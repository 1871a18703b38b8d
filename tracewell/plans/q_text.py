"""Queries of text scalars, search and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import budget, search
from tracewell.session import table

QUERY = "the license of"
TERMS = ("license", "public", "token")
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"


def _docs(spark, d):
    return search.search_documents(table(spark, d, "documents"), "doc_id", "source", "text")


def lexical_search(spark, d):
    return search.lexical_search(_docs(spark, d), QUERY)


def doc_freq(spark, d):
    return search.document_frequency(search.postings(_docs(spark, d)))


def fulltext_lines(spark, d):
    lines = search.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return search.first_matches(search.line_matches(lines, "doc_id", TERMS), "doc_id", 200)


def line_context(spark, d):
    lines = search.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return search.line_context(lines, "doc_id", F.lower("text").contains("license"))


def text_scalars(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.estimate_tokens(t).alias("tokens"), X.newline_style(t).alias("newlines"), X.content_hash(t).alias("content_hash"),
        F.size(X.analyze_text(t)).cast("long").alias("n_terms"), X.truncated(t, 40).alias("head"),
        X.reduction_percent(F.length(t), F.length(F.trim(t))).alias("saved"), X.rolling_hash(t).alias("rolling"),
    )


def privacy_signals(spark, d):
    lines = search.text_lines(table(spark, d, "documents"), "doc_id", "text")
    found = lines.withColumn("code", F.explode(X.privacy_codes(F.col("text"))))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def path_families(spark, d):
    lines = search.text_lines(table(spark, d, "pages"), "page_id", "html")
    paths = lines.select("page_id", "line", F.explode(X.path_mentions(F.col("text"))).alias("path")).withColumn("family", X.path_family(F.col("path")))
    return paths.groupBy("family").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("path").alias("paths"), F.countDistinct("page_id").alias("files"))


def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 0").select("embedding").first()["embedding"]
    return search.vector_top_k(vectors, "vec_id", "embedding", asked)


def embed_bytes(spark, d):
    return table(spark, d, "region").select("r_regionkey", X.byte_embedding(F.col("r_name"), 4).alias("v")).select("r_regionkey", *(F.round(F.get("v", F.lit(k)), 9).alias(f"v{k}") for k in range(4)))


def conversation_search(spark, d):
    turns = table(spark, d, "conversations").withColumn("text", F.lower("text"))
    return turns.filter(F.col("text").contains("the")).groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"))


def budget_slices(spark, d):
    totals = [1000, 4000, 777]
    out = None
    for total in totals:
        part = budget.budget_slices(spark, total).withColumn("total", F.lit(total).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def greedy_pack(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars"), X.estimate_tokens(F.col("text")).alias("cost"))
    return budget.greedy_pack(docs, "source", [-F.col("n_chars"), F.col("id")], 8000)


def best_per_source(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return budget.best_per_key(docs, "source", -F.col("n_chars"), F.col("doc_id"))


def category_first(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return budget.category_first(parts, "p_brand", "p_retailprice", "p_partkey", 3).select("p_partkey", "p_brand", "in_category", "rank")


def decay_scores(spark, d):
    return budget.decay_score(table(spark, d, "nation").select("n_name"), F.col("n_name"))


QUERIES = {f.__name__: f for f in (lexical_search, doc_freq, fulltext_lines, line_context, text_scalars, privacy_signals, path_families, vector_topk, embed_bytes, conversation_search, budget_slices, greedy_pack, best_per_source, category_first, decay_scores)}

_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"

ORACLES = {
    "lexical_search": rf"""
WITH d AS (SELECT doc_id, {_TOK.format("source || chr(10) || text")} AS tokens, {_TOK.format("source")} AS title FROM documents),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'license', 'of']) AS term) GROUP BY 1),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) JOIN q USING (term) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df) * times * CASE WHEN list_contains(title, term) THEN 2 ELSE 1 END), 6) AS score, count(*)::BIGINT AS n_terms
FROM p JOIN f USING (term) JOIN q USING (term) JOIN d USING (doc_id) GROUP BY doc_id HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 20""",
    "doc_freq": rf"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM (SELECT doc_id, unnest({_TOK.format("source || chr(10) || text")}) AS term FROM documents) GROUP BY term""",
    "fulltext_lines": f"""
WITH {_LINES}, m AS (SELECT doc_id, line, term, text FROM lines, (SELECT unnest(['license', 'public', 'token']) AS term) WHERE contains(lower(text), term)),
c AS (SELECT * FROM m ORDER BY doc_id, term, line LIMIT 200) SELECT *, (SELECT count(*) FROM c) >= 200 AS truncated FROM c""",
    "line_context": f"""
WITH {_LINES}, c AS (SELECT doc_id, line, text, array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM lines)
SELECT doc_id, line, context FROM c WHERE contains(lower(text), 'license')""",
    "privacy_signals": rf"""
WITH {_LINES}, s AS (SELECT doc_id, code FROM lines, LATERAL (SELECT unnest([
  CASE WHEN regexp_matches(text, '\b[A-Z][A-Z0-9_]{{5,}}\b') THEN 'SUSPICIOUS_IDENTIFIER' END,
  CASE WHEN regexp_matches(text, '\b[A-Z0-9_]{{1,10}}/[A-Z0-9_]{{1,10}}\b') THEN 'LIBRARY_MEMBER_PATTERN' END,
  CASE WHEN regexp_matches(text, '(^|[\s"''`(])(?:\.{{1,2}}/|/home/|/tmp/|/usr/|[A-Za-z]:\\)') THEN 'FILE_PATH' END,
  CASE WHEN regexp_matches(text, '(?i)https?://|ftp://|\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,}}\b') AND NOT regexp_matches(lower(trim(text)), '^(ui|program|data|workflow)\.[a-z0-9-]+$') THEN 'URL_OR_HOST' END,
  CASE WHEN regexp_matches(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') THEN 'IP_ADDRESS' END,
  CASE WHEN regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b') THEN 'EMAIL' END,
  CASE WHEN regexp_matches(text, '(?i)\b(api[_-]?key|token|secret|password|passwd|authorization)\b') THEN 'TOKEN_OR_SECRET' END,
  CASE WHEN regexp_matches(text, '\b[A-Z][A-Z0-9_]{{1,29}}\.[A-Z][A-Z0-9_]{{1,29}}\b') THEN 'SQL_OBJECT_NAME' END,
  CASE WHEN regexp_matches(text, '(?i)(\*\*FREE\b|\bDCL-(F|S|DS|PR|PI)\b|\bEXFMT\b|\bCHAIN\b|\bREADC\b|\bSFL(CLR|RRN|PAG|SIZ)\b|\bPGM\b|\bENDPGM\b|\bMONMSG\b|\bEXEC\s+SQL\b|\bSELECT\b.+\bFROM\b)') THEN 'SOURCE_FRAGMENT' END,
  CASE WHEN length(trim(text)) >= 60 AND regexp_matches(trim(text), '\s') THEN 'LONG_BUSINESS_LABEL' END]) AS code) WHERE code IS NOT NULL)
SELECT code, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY code""",
    "path_families": r"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS text FROM pages),
p AS (SELECT page_id, unnest(list_filter(regexp_extract_all(text, '(?i)(?:^|[^A-Z0-9_])((?:/[A-Z0-9._$#@%+-]+)+)', 1), lambda x: regexp_matches(x, '(?i)/[A-Z0-9]'))) AS path FROM l)
SELECT CASE WHEN upper(path) = '/TMP' OR starts_with(upper(path), '/TMP/') THEN 'TEMP' WHEN starts_with(upper(path), '/QSYS.LIB/') THEN 'QSYS_LIB' WHEN starts_with(upper(path), '/QDLS/') THEN 'QDLS'
  WHEN starts_with(upper(path), '/HOME/') THEN 'HOME' WHEN starts_with(upper(path), '/WWW/') THEN 'WEB' ELSE 'IFS' END AS family,
  count(*) AS mentions, count(DISTINCT path) AS paths, count(DISTINCT page_id) AS files FROM p GROUP BY 1""",
    "vector_topk": """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(round(list_cosine_similarity(embedding::DOUBLE[], q), 12), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""",
    "conversation_search": "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations FROM conversations WHERE contains(lower(text), 'the') GROUP BY role",
    "budget_slices": """
WITH w AS (SELECT * FROM (VALUES ('summary', 0.1::DOUBLE), ('graph', 0.25), ('source', 0.45), ('diagnostics', 0.1), ('unresolved', 0.1)) v(name, w)), t AS (SELECT unnest([1000, 4000, 777])::BIGINT AS total),
e AS (SELECT name, total, w * total AS exact, floor(w * total)::BIGINT AS base FROM w, t),
r AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY exact - base DESC, name) AS k, total - sum(base) OVER (PARTITION BY total) AS rest FROM e)
SELECT name, total, (base + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS tokens FROM r""",
    "greedy_pack": """
WITH RECURSIVE o AS (SELECT source, doc_id AS id, ceil(length(text) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
f(source, k, id, cost, used, selected) AS (
  SELECT source, k, id, cost, CASE WHEN cost <= 8000 THEN cost ELSE 0 END, cost <= 8000 FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.k, o.id, o.cost, f.used + CASE WHEN f.used + o.cost <= 8000 THEN o.cost ELSE 0 END, f.used + o.cost <= 8000 FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, id, cost FROM f WHERE selected""",
    "best_per_source": "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1",
    "category_first": """
WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS in_category FROM part)
SELECT p_partkey, p_brand, in_category, row_number() OVER (ORDER BY CASE WHEN in_category > 1 THEN 1 ELSE 0 END, p_retailprice DESC, p_partkey) AS rank FROM r WHERE in_category <= 3""",
    "decay_scores": "SELECT n_name, greatest(1, 101 - row_number() OVER (ORDER BY n_name))::BIGINT AS score FROM nation",
    "text_scalars": rf"""
SELECT doc_id, coalesce(ceil(length(text) / 4.0), 0)::BIGINT AS tokens, CASE WHEN text IS NULL THEN NULL WHEN contains(text, chr(13)) THEN 'CR' WHEN contains(text, chr(10)) THEN 'LF' ELSE 'NONE' END AS newlines,
  sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash, len({_TOK.format("text")})::BIGINT AS n_terms, CASE WHEN length(text) > 40 THEN substring(text, 1, 39) || chr(8230) ELSE text END AS head,
  CASE WHEN length(text) > 0 THEN floor((length(text) - length(trim(text, ' '))) * 100.0 / length(text) + 0.5) ELSE 0 END::BIGINT AS saved,
  printf('%x', abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)) AS rolling
FROM (SELECT doc_id, text, list_reduce(flatten([[0::BIGINT], flatten(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END))]), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM documents)""",
    "embed_bytes": """
WITH b AS (SELECT r_regionkey, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS v FROM (SELECT r_regionkey, list_transform(regexp_extract_all(r_name, '(?s).'), lambda c: ascii(c)) AS l FROM region)),
s AS (SELECT r_regionkey, coalesce(sum(v) FILTER (i % 4 = 0), 0)::DOUBLE AS a, coalesce(sum(v) FILTER (i % 4 = 1), 0)::DOUBLE AS b, coalesce(sum(v) FILTER (i % 4 = 2), 0)::DOUBLE AS c, coalesce(sum(v) FILTER (i % 4 = 3), 0)::DOUBLE AS d FROM b GROUP BY 1)
SELECT r_regionkey, round(a / sqrt(a*a + b*b + c*c + d*d), 9) AS v0, round(b / sqrt(a*a + b*b + c*c + d*d), 9) AS v1, round(c / sqrt(a*a + b*b + c*c + d*d), 9) AS v2, round(d / sqrt(a*a + b*b + c*c + d*d), 9) AS v3 FROM s""",
}
