"""Text scalars as Column expressions: analysis, token estimates, newline styles, paths, privacy signals, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}_]+"
CHARS_PER_TOKEN = 4
BOM = chr(0xFEFF)


def analyze_text(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order. Null text: empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def document_text(title: Column, body: Column, fields: Column | None = None) -> Column:
    """What a search document is indexed by: title, body and its scalar fields in key order, one a line."""
    parts = [title, body]
    if fields is not None:
        parts.append(F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: e["value"]), "\n"))
    return F.concat_ws("\n", *parts)


def estimate_tokens(text: Column, chars_per_token: int = CHARS_PER_TOKEN) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def reduction_percent(original: Column, optimized: Column) -> Column:
    """Saved share in whole percent, half up, never negative; 0 for an empty original."""
    return F.when(original > 0, F.greatest(F.lit(0), F.floor((original - optimized) * 100.0 / original + 0.5))).otherwise(0).cast("long")


def newline_style(text: Column) -> Column:
    crlf, lf, cr = text.contains("\r\n"), F.regexp_replace(text, "\r\n", "").contains("\n"), F.regexp_replace(text, "\r\n", "").contains("\r")
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(kinds > 1, "MIXED").when(crlf, "CRLF").when(lf, "LF").when(cr, "CR").when(text.isNotNull(), "NONE")


def canonical_text(text: Column) -> Column:
    """Without a byte-order mark and with \\n line ends, so that equal content hashes equally."""
    return F.regexp_replace(F.regexp_replace(text, f"^{BOM}", ""), "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, max(width - 1, 0)), F.lit(chr(0x2026)))).otherwise(text)


def rolling_hash(text: Column) -> Column:
    """Hex of the absolute 32-bit h = 31 * h + unit over UTF-16 units."""
    two32, two31 = F.lit(1 << 32), F.lit(1 << 31)
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    folded = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, two32))
    return F.lower(F.hex(F.abs(F.when(folded >= two31, folded - two32).otherwise(folded))))


def lines(text: Column) -> Column:
    """array<struct<line, text>>, 1-based."""
    return F.transform(F.split(text, "\n", -1), lambda t, i: F.struct((i + 1).cast("long").alias("line"), t.alias("text")))


# Path shapes, path families and privacy signals with their codes.
PATH = r"(?i)(?:^|[^A-Z0-9_])((?:/[A-Z0-9._$#@%+-]+)+)"
PATH_FAMILIES = (("/QSYS.LIB/", "QSYS_LIB"), ("/QDLS/", "QDLS"), ("/HOME/", "HOME"), ("/TMP/", "TEMP"), ("/WWW/", "WEB"))
PRIVACY_SIGNALS = {
    "SUSPICIOUS_IDENTIFIER": r"\b[A-Z][A-Z0-9_]{5,}\b",
    "LIBRARY_MEMBER_PATTERN": r"\b[A-Z0-9_]{1,10}/[A-Z0-9_]{1,10}\b",
    "FILE_PATH": r"(^|[\s\"'`(])(?:\.{1,2}/|/home/|/tmp/|/usr/|[A-Za-z]:\\)",
    "URL_OR_HOST": r"(?i)https?://|ftp://|\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "TOKEN_OR_SECRET": r"(?i)\b(api[_-]?key|token|secret|password|passwd|authorization)\b",
    "SQL_OBJECT_NAME": r"\b[A-Z][A-Z0-9_]{1,29}\.[A-Z][A-Z0-9_]{1,29}\b",
    "SOURCE_FRAGMENT": r"(?i)(\*\*FREE\b|\bDCL-(F|S|DS|PR|PI)\b|\bEXFMT\b|\bCHAIN\b|\bREADC\b|\bSFL(CLR|RRN|PAG|SIZ)\b|\bPGM\b|\bENDPGM\b|\bMONMSG\b|\bEXEC\s+SQL\b|\bSELECT\b.+\bFROM\b)",
}
LONG_LABEL = 60
#: What a value with the signal must hold: tests without lookarounds that most lines fail before the full pattern is tried.
PRIVACY_HINTS = {
    "SUSPICIOUS_IDENTIFIER": "[A-Z][A-Z0-9_]{5}", "LIBRARY_MEMBER_PATTERN": "[A-Z0-9_]/[A-Z0-9_]", "FILE_PATH": r"/|:\\",
    "URL_OR_HOST": r"://|[A-Za-z0-9]\.[A-Za-z]{2}", "IP_ADDRESS": r"\d\.\d", "EMAIL": "@", "TOKEN_OR_SECRET": "(?i)key|token|secret|passw|authorization",
    "SQL_OBJECT_NAME": r"[A-Z0-9_]\.[A-Z]", "SOURCE_FRAGMENT": r"(?i)\*\*free|dcl-|exfmt|chain|readc|sfl|pgm|monmsg|exec|select",
}
#: Word boundary over ASCII letters, digits and underscores, whatever the regex engine's own one takes in.
ASCII_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SAMPLE = 80


def path_mentions(text: Column) -> Column:
    """Paths of one line that hold a name, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(PATH), F.lit(1)), lambda p: p.rlike("(?i)/[A-Z0-9]"))


def path_family(path: Column) -> Column:
    upper = F.upper(path)
    chain = F.when(upper == "/TMP", "TEMP")
    for prefix, family in PATH_FAMILIES:
        chain = chain.when(upper.startswith(prefix), family)
    return chain.otherwise("IFS")


def privacy_codes(value: Column) -> Column:
    """Codes of the signals that a value shows, in the order above; a dotted catalogue key of four known heads is no host."""
    known_key = F.lower(F.trim(value)).rlike(r"^(ui|program|data|workflow)\.[a-z0-9-]+$")
    tests = [F.when(value.rlike(PRIVACY_HINTS[code]) & value.rlike(p.replace(r"\b", ASCII_EDGE)) & (~known_key if code == "URL_OR_HOST" else F.lit(True)), code) for code, p in PRIVACY_SIGNALS.items()]
    trimmed = F.trim(value)
    tests.append(F.when((F.length(trimmed) >= LONG_LABEL) & trimmed.rlike(r"\s"), "LONG_BUSINESS_LABEL"))
    return F.array_compact(F.array(*tests))


def privacy_sample(value: Column) -> Column:
    return F.when(F.length(value) > SAMPLE, F.concat(F.substring(value, 1, SAMPLE), F.lit("..."))).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays to 12 places, 0 where one is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.round(dot(a, b) / norm, 12)).otherwise(F.lit(0.0))


def byte_embedding(text: Column, dims: int = 8) -> Column:
    """Sums of UTF-8 bytes by place modulo dims, scaled to length 1 (12 places); zeros for an empty text."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    values = F.transform(F.regexp_extract_all(hexed, F.lit(".."), F.lit(0)), lambda b: F.conv(b, 16, 10).cast("long"))
    slot = lambda k: F.filter(values, lambda v, i: i % dims == k)
    sums = F.array(*(F.aggregate(slot(k), F.lit(0).cast("long"), lambda s, v: s + v) for k in range(dims)))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.when(F.length(hexed) > 0, F.transform(sums, lambda v: F.round(v / norm, 12))).otherwise(F.array(*[F.lit(0.0)] * dims))
