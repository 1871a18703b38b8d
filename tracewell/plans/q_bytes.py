"""Queries of files as bytes: encodings and integrity, over documents written in several encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.sources import files
from tracewell.session import table


def _bytes(spark, d):
    k, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    mark = lambda m, raw: F.concat(F.unhex(F.lit(m)), raw)
    raw = (
        F.when(k == 1, mark("EFBBBF", F.encode(text, "UTF-8"))).when(k == 2, mark("FFFE", F.encode(text, "UTF-16LE"))).when(k == 3, mark("FEFF", F.encode(text, "UTF-16BE")))
        .when(k == 4, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("C328")))).when(k == 5, F.concat(mark("FFFE", F.encode(text, "UTF-16LE")), F.unhex(F.lit("00D8")))).otherwise(F.encode(text, "UTF-8"))
    )
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length(raw).cast("long").alias("size"), raw.alias("bytes"))


def source_encodings(spark, d):
    return files.decoded(_bytes(spark, d)).select("path", "size", "encoding", "had_bom", "converted", F.sha2("content", 256).alias("text_hash"))


def source_status(spark, d):
    """A ninth of the files is missing, an eleventh has another checksum than expected."""
    have, k = _bytes(spark, d), F.col("doc_id")
    expected = have.select("path", F.when(k % 11 == 0, "0").otherwise(F.sha2("bytes", 256)).alias("sha256"))
    return files.source_status(have.filter(k % 9 > 0).drop("doc_id"), expected).withColumn("issues", F.array_join("issues", ","))


QUERIES = {f.__name__: f for f in (source_encodings, source_status)}

_D = "WITH d AS (SELECT doc_id, doc_id % 7 AS k, 'd/' || doc_id AS path, coalesce(text, '') AS x, doc_id % 9 = 0 AS missing FROM documents)"
_ENCODING = "CASE WHEN k IN (4, 5) THEN NULL WHEN k = 2 THEN 'UTF-16LE' WHEN k = 3 THEN 'UTF-16BE' ELSE 'UTF-8' END"
ORACLES = {
    "source_encodings": f"""{_D} SELECT path, CASE WHEN k IN (2, 3) THEN 2 + 2 * (length(x) + len(regexp_extract_all(x, '[\\x{{10000}}-\\x{{10FFFF}}]'))) WHEN k = 5 THEN 4 + 2 * (length(x) + len(regexp_extract_all(x, '[\\x{{10000}}-\\x{{10FFFF}}]'))) ELSE octet_length(encode(x)) + CASE k WHEN 1 THEN 3 WHEN 4 THEN 2 ELSE 0 END END::BIGINT AS size,
{_ENCODING} AS encoding, k IN (1, 2, 3) AS had_bom, k IN (2, 3) AS converted, CASE WHEN k NOT IN (4, 5) THEN sha256(x) END AS text_hash FROM d""",
    "source_status": f"""{_D}, s AS (SELECT *, NOT missing AND k IN (4, 5) AS broken, NOT missing AND doc_id % 11 = 0 AS other, CASE WHEN missing OR k IN (4, 5) THEN '' ELSE x END AS y FROM d),
n AS (SELECT *, contains(y, chr(13)) AS cr, CASE WHEN (contains(y, chr(13) || chr(10)))::INT + (contains(replace(y, chr(13) || chr(10), ''), chr(10)))::INT + (contains(replace(y, chr(13) || chr(10), ''), chr(13)))::INT > 1 THEN 'MIXED' WHEN contains(y, chr(13) || chr(10)) THEN 'CRLF' WHEN contains(y, chr(10)) THEN 'LF' WHEN contains(y, chr(13)) THEN 'CR' ELSE 'NONE' END AS style FROM s)
SELECT path, CASE WHEN missing OR broken OR other THEN 'invalid' WHEN k IN (1, 2, 3) OR cr THEN 'normalized' ELSE 'valid' END AS status, CASE WHEN NOT missing THEN {_ENCODING} END AS encoding, CASE WHEN missing OR broken THEN 'UNKNOWN' ELSE style END AS newlines,
CASE WHEN missing THEN 'SOURCE_FILE_MISSING' ELSE concat_ws(',', CASE WHEN broken THEN 'INVALID_UTF8' END, CASE WHEN style = 'CR' THEN 'LEGACY_CR_NEWLINES' END, CASE WHEN NOT broken AND style = 'MIXED' THEN 'MIXED_NEWLINES' END, CASE WHEN k IN (1, 2, 3) THEN 'SOURCE_BOM_REMOVED' END, CASE WHEN other THEN 'SOURCE_CHANGED_SINCE_IMPORT' END, CASE WHEN k IN (2, 3) THEN 'SOURCE_ENCODING_CONVERTED' END, CASE WHEN NOT broken AND cr THEN 'SOURCE_LINE_ENDINGS_NORMALIZED' END) END AS issues FROM n""",
}
