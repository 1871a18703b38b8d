"""Source files in: directory and glob scans, inventories with content hashes, manifests, fixed-width records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import BOM, canonical_text, newline_style

EXTENSIONS = ("rpgle", "sqlrpgle", "rpg", "clle", "clp", "sql", "pf", "lf", "dspf", "prtf", "bnd", "txt", "md")
RECORD_WIDTHS = (80, 92, 100, 112, 120, 132)


def scan_bytes(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, pattern: str | None = None) -> DataFrame:
    """path (below root), size, bytes of files; an empty list of extensions takes all. Dot files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").replace("file://", "").replace("file:", "")
    files = reader.load(root).select(F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/*', '/'), {len(base) + 2})").alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return files.filter(~F.col("path").rlike(r"(^|/)\."))


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, pattern: str | None = None) -> DataFrame:
    """path, size, content of text files; content is null where the bytes are no text."""
    return decoded(scan_bytes(spark, root, extensions, pattern)).select("path", "size", "content")


def _sound_utf16(raw: Column, little: bool) -> Column:
    """Whole units, and surrogates only in pairs."""
    units = F.regexp_replace(F.hex(raw), "(.{4})", "$1 ")
    high, low, any_ = ("..D[89AB] ", "..D[CDEF] ", "..D[89A-F] ") if little else ("D[89AB].. ", "D[CDEF].. ", "D[89A-F].. ")
    # units begin after a blank or at the start, so the patterns meet whole ones only
    left = F.regexp_replace(units, rf"(?<=^|\s){high}{low}", "")
    return (F.octet_length(raw) % 2 == 0) & ~left.rlike(rf"(?:^|\s){any_}")


def decoding(raw: Column, utf8_only: bool = False) -> Column:
    """struct<encoding, had_bom, converted, text> of bytes: by their byte-order mark UTF-8, UTF-16LE or UTF-16BE, else UTF-8; null where they are not
    sound in that encoding. The mark is no part of the text."""
    head, rest2, rest3 = F.hex(F.substring(raw, 1, 3)), F.substring(raw, 3, 1 << 30), F.substring(raw, 4, 1 << 30)
    found = lambda name, bom, converted, text: F.struct(F.lit(name).alias("encoding"), F.lit(bom).alias("had_bom"), F.lit(converted).alias("converted"), text.alias("text"))
    plain, marked = raw.cast("string"), rest3.cast("string")
    out = F.when((head == "EFBBBF") & F.is_valid_utf8(marked), found("UTF-8", True, False, marked))
    if not utf8_only:
        for name, mark in (("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF")):
            out = out.when(head.startswith(mark) & _sound_utf16(rest2, mark == "FFFE"), found(name, True, True, F.decode(rest2, name)))
    return out.when(F.is_valid_utf8(plain), found("UTF-8", False, False, plain))


def decoded(files: DataFrame, utf8_only: bool = False) -> DataFrame:
    """files(path, size, bytes) -> path, size, sha256 (of the bytes), encoding, had_bom, converted, content (null where the bytes are no text)."""
    out = files.withColumn("d", decoding(F.col("bytes"), utf8_only))
    return out.select("path", "size", F.sha2("bytes", 256).alias("sha256"), "d.encoding", F.coalesce("d.had_bom", F.lit(False)).alias("had_bom"), F.coalesce("d.converted", F.lit(False)).alias("converted"), F.col("d.text").alias("content"))


def source_status(files: DataFrame, expected: DataFrame, utf8_only: bool = False) -> DataFrame:
    """files(path, size, bytes) against expected(path, sha256; a null one is not compared) -> path, status (valid, normalized, invalid), encoding, newlines, issues (sorted).

    Invalid: missing, no text, or another checksum than expected. Normalized: a mark was taken off, an encoding converted, or line ends changed to \\n."""
    have = decoded(files, utf8_only).withColumn("there", F.lit(True))
    both = have.join(expected.select("path", F.col("sha256").alias("wanted")), "path", "full_outer")
    there, text = F.coalesce("there", F.lit(False)), F.col("content")
    lines = newline_style(text)
    issue = lambda test, code: F.when(F.coalesce(test, F.lit(False)), code)
    bad = [issue(~there, "SOURCE_FILE_MISSING"), issue(there & text.isNull(), "INVALID_UTF8"), issue(there & (F.col("wanted") != F.col("sha256")), "SOURCE_CHANGED_SINCE_IMPORT")]
    changed = [issue(F.col("had_bom"), "SOURCE_BOM_REMOVED"), issue(F.col("converted"), "SOURCE_ENCODING_CONVERTED"), issue(text.contains("\r"), "SOURCE_LINE_ENDINGS_NORMALIZED"), issue(lines == "MIXED", "MIXED_NEWLINES"), issue(lines == "CR", "LEGACY_CR_NEWLINES")]
    wrong, eased = F.coalesce(*bad).isNotNull(), F.coalesce(*changed).isNotNull()
    status = F.when(wrong, "invalid").when(eased, "normalized").otherwise("valid")
    return both.select("path", status.alias("status"), "encoding", F.coalesce(lines, F.lit("UNKNOWN")).alias("newlines"), F.array_sort(F.array_compact(F.array(*bad, *changed))).alias("issues"))


def safe_path(path: Column) -> Column:
    """Relative, without a drive, a leading slash or a parent step."""
    return ~path.rlike(r"^([A-Za-z]:|[/\\])|(^|[/\\])\.\.([/\\]|$)") & (F.length(path) > 0)


def inventory(files: DataFrame, root: str) -> DataFrame:
    """root, path, hash (sha256 of canonical text), size, n_lines, newlines, has_bom, language."""
    text = canonical_text(F.col("content"))
    return files.filter(safe_path(F.col("path"))).select(
        F.lit(root).alias("root"), "path", F.sha2(text, 256).alias("hash"), "size", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        newline_style(F.col("content")).alias("newlines"), F.col("content").startswith(BOM).alias("has_bom"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("language"),
    )


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against manifest(path, hash): path, issue (MISSING, UNLISTED, HASH_MISMATCH, MIXED_NEWLINES) for what is wrong."""
    have = inventory(files, "").select("path", "hash", "newlines")
    both = have.join(manifest.select("path", F.col("hash").alias("listed")), "path", "full_outer")
    issues = F.array_compact(F.array(
        F.when(F.col("hash").isNull(), "MISSING"), F.when(F.col("listed").isNull(), "UNLISTED"), F.when(F.col("hash") != F.col("listed"), "HASH_MISMATCH"), F.when(F.col("newlines") == "MIXED", "MIXED_NEWLINES"),
    ))
    return both.select("path", F.explode(issues).alias("issue"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of an import manifest {files: [...]}."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("files").alias("f")).select("f.*")


def fixed_records(text: Column, widths: Sequence[int] = RECORD_WIDTHS, least: float = 0.6) -> Column:
    """Text without line ends cut at the width whose records end in a blank most often (least share, else one record)."""
    n = F.length(text)

    def share(width: int) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (n / width).cast("int"))), lambda i: (F.substring(text, i * width, F.lit(1)) == " ").cast("double"))
        return F.when(n >= width, F.aggregate(ends, F.lit(0.0), lambda a, x: a + x) / F.size(ends)).otherwise(0.0)

    best = F.array_max(F.array(*(F.struct(share(w).alias("share"), F.lit(-w).alias("w")) for w in widths)))
    width = F.when(best["share"] >= least, -best["w"]).otherwise(F.greatest(n, F.lit(1)))
    return F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.rtrim(F.substring(text, i * width + 1, width)))


def catalog_columns(df: DataFrame, table: str) -> DataFrame:
    """table, ordinal, name, type, nullable of a frame's columns."""
    rows = [(table, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table string, ordinal int, name string, type string, nullable boolean")


def catalog_summary(units: DataFrame) -> DataFrame:
    """units(member, path) -> counts of files, distinct members and members with more than one file."""
    per = units.groupBy("member").agg(F.countDistinct("path").alias("n"))
    return per.agg(F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("n") > 1).alias("n_ambiguous"))
