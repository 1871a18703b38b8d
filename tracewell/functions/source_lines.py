"""Facts of program source lines (free and fixed RPG, CL, DDS, binder source) as rows, without per-row Python.

source_facts() turns files(path, content) into (path, line, fact, name, detail). Block state (owners, current export level,
multi-line statements) comes from ordered windows within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import spread

NAME = r"[A-Z0-9_#$@]+"

# Source types by extension, their families, native opcodes (access kind, keyed, interactive, changing), CL keywords.
SOURCE_TYPES = {"rpg": "RPG", "rpgle": "RPGLE", "sqlrpgle": "SQLRPGLE", "rpgile": "RPGILE", "clp": "CLP", "clle": "CLLE", "dds": "DDS", "dspf": "DSPF", "prtf": "PRTF", "pf": "PF", "lf": "LF", "bnd": "BND", "binder": "BINDER", "bndsrc": "BNDSRC"}
FAMILIES = {"RPG": ("RPG", "RPGLE", "SQLRPGLE", "RPGILE", "BND", "BINDER", "BNDSRC"), "CL": ("CLP", "CLLE"), "DDS": ("DDS", "DSPF", "PRTF", "PF", "LF")}
OPCODES = {
    "CHAIN": ("READ", True, False, False), "SETLL": ("POSITION", True, False, False), "SETGT": ("POSITION", True, False, False), "READ": ("READ", False, False, False),
    "READE": ("READ", True, False, False), "READP": ("READ", False, False, False), "READPE": ("READ", True, False, False), "WRITE": ("WRITE", False, False, True),
    "UPDATE": ("UPDATE", False, False, True), "DELETE": ("DELETE", False, False, True), "EXFMT": ("DISPLAY", False, True, False),
}
CL_KEYWORDS = ("PGM", "FILE", "TOFILE", "FROMFILE", "MSGF", "DTAARA", "OUTQ", "JOBQ")
DDS_KEYWORDS = ("PFILE", "REF", "JFILE")


def source_type(path: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in SOURCE_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(pairs, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("UNKNOWN"))


def source_family(kind: Column) -> Column:
    chain = F.when(kind.isin(*FAMILIES["RPG"]), "RPG")
    for family in ("CL", "DDS"):
        chain = chain.when(kind.isin(*FAMILIES[family]), family)
    return chain.otherwise("UNKNOWN")


def is_comment(raw: Column) -> Column:
    """Empty lines, those with a star in column 7, those that open with //, /* or a star. A star that opens an indicator (*IN and a
    digit, a letter or a bracket) or a switch (*ON, *OFF) opens code, and so does a copy directive."""
    text = F.trim(raw)
    upper = F.upper(text)
    after_in = F.substring(upper, 4, 1 << 20)
    indicator = upper.startswith("*IN") & (after_in.rlike("^[A-Z0-9]") | F.ltrim(after_in).startswith("("))
    switch = F.get(F.split(F.substring(upper, 2, 5), "[^A-Z0-9_]"), 0).isin("ON", "OFF")
    copy = F.get(F.split(upper, "[^A-Z0-9_/]"), 0).isin("/COPY", "/INCLUDE")
    opens = text.startswith("//") | text.startswith("/*") | (text.startswith("*") & ~indicator & ~switch)
    return ((raw == "") | (F.substring(raw, 7, 1) == "*") | opens) & ~copy


def _one(fact: str, raw: Column, pattern: str, group: int = 1, detail: Column | None = None) -> Column:
    name = F.upper(F.trim(F.regexp_extract(raw, pattern, group)))
    return F.when(name != "", F.array(_fact(F.lit(fact), name, detail))).otherwise(_none())


def _many(fact: str, raw: Column, pattern: str, detail: Column | None = None) -> Column:
    names = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda x: F.upper(F.trim(x))))
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: _fact(F.lit(fact), n, detail))


def _fact(fact: Column, name: Column, detail: Column | None) -> Column:
    return F.struct(fact.alias("fact"), name.alias("name"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _none() -> Column:
    return F.array().cast("array<struct<fact:string,name:string,detail:string>>")


def keyword_values(raw: Column, keyword: str) -> Column:
    """Values of KEYWORD(a : b) - quoted ones, or else parts between blanks, commas and colons without a leading star - distinct, sorted."""
    inner = F.regexp_extract(raw, rf"(?i)\b{keyword}\(([^)]*)\)", 1)
    quoted = F.regexp_extract_all(inner, F.lit("'([^']+)'"), F.lit(1))
    parts = F.split(inner, r"[:\s,]+")
    values = F.when(F.size(quoted) > 0, quoted).otherwise(parts)
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.upper(F.regexp_replace(F.trim(v), r"^\*", ""))), lambda v: v != "")))


def _listed(fact: str, values: Column) -> Column:
    return F.transform(values, lambda n: _fact(F.lit(fact), n, None))


def rpg_facts(raw: Column) -> Column:
    """Facts of one RPG line."""
    usage = F.upper(F.regexp_extract(raw, r"(?i)\busage\(([^)]*)\)", 1))
    codes = "|".join(sorted(OPCODES, key=len, reverse=True))
    free = rf"(?i)^\s*({codes})(?:\([A-Z]+\))?\s+(?:.*\s)?({NAME})\s*;"  # the last operand names the file
    fixed = rf"(?i)^\s{{0,5}}C.{{0,30}}\b({codes})\s+({NAME})"
    opcode = lambda p: F.upper(F.regexp_extract(raw, p, 1))
    groups = [
        _one("FILE", raw, rf"(?i)^\s*dcl-f\s+({NAME})", detail=usage), _one("FILE", raw, rf"(?i)^\s{{0,5}}F({NAME})\s+[IOUC]", detail=F.substring(F.trim(F.regexp_extract(raw, rf"(?i)^\s{{0,5}}F{NAME}\s+([IOUC])", 1)), 1, 1)),
        _one("COPY", raw, r"(?i)^\s*/(?:COPY|INCLUDE)\s+([A-Z0-9_#$@,./]+)"),
        _one("CALL", raw, rf"(?i)\bCALL\s+PGM\(\s*(?:{NAME}/)?'?({NAME})"), _one("CALL", raw, r"(?i)\bCALL\s+'([A-Z0-9_#$@]+)'"),
        _one("PROCEDURE_CALL", raw, rf"(?i)\bCALLP\s+(?:\([A-Z]+\)\s*)?({NAME})"), _one("PROCEDURE_CALL", raw, r"(?i)\bCALL(?:B|PRC)\s*\(?\s*'([A-Z0-9_#$@]+)'"),
        _one("DYNAMIC_CALL", raw, rf"(?i)\bCALL(?:B|P|PRC)?\s+%?(?!PGM\b)([A-Z][A-Z0-9_#$@]*)\s*;?\s*$"), _one("SUBROUTINE", raw, rf"(?i)\bEXSR\s+({NAME})\b"),
        _one("PROTOTYPE", raw, rf"(?i)^\s*dcl-pr\s+({NAME})"), _one("PROCEDURE", raw, rf"(?i)^\s*dcl-proc\s+({NAME})", detail=F.when(raw.rlike(r"(?i)\bexport\b"), "EXPORT")),
        _one("STRUCTURE", raw, rf"(?i)^\s*dcl-ds\s+({NAME})"), _one("VARIABLE", raw, rf"(?i)^\s*dcl-s\s+({NAME})", detail=F.regexp_extract(raw, rf"(?i)^\s*dcl-s\s+{NAME}\s+([a-z]+(?:\([^)]*\))?)", 1)),
        F.when(raw.rlike(r"(?i)\bnomain\b") & raw.rlike(r"(?i)^\s*(ctl-opt\b|H\s)"), F.array(_fact(F.lit("MODULE"), F.lit("*SELF"), None))).otherwise(_none()),
        _listed("BINDING_DIRECTORY", keyword_values(raw, "BNDDIR")), _listed("SERVICE_PROGRAM", keyword_values(raw, "BNDSRVPGM")),
        _many("INDICATOR", raw, r"(?i)\*IN\(?\s*(\d{1,2}|LR|[A-Z]{2})\b", F.when(raw.rlike(r"(?i)\*IN\(?\s*\w{1,2}\)?\s*="), "WRITE").otherwise("READ")), _many("BUILT_IN", raw, r"(?i)%([A-Z]+)\("),
        _one("NATIVE_IO", raw, free, 2, opcode(free)), _one("NATIVE_IO", raw, fixed, 2, opcode(fixed)),
    ]
    return F.flatten(F.array(*groups))


def cl_facts(raw: Column) -> Column:
    """First word and object keywords of a CL line; a library before a slash is dropped."""
    groups = [_one("COMMAND", raw, r"(?i)^\s*([A-Z][A-Z0-9_#$@]*)\b")]
    for k in CL_KEYWORDS:
        fact = "CALL" if k == "PGM" else "OBJECT"
        groups.append(_many(fact, raw, rf"(?i)\b{k}\((?:[^)/]+/)?([A-Z0-9_#$@*]+)", F.lit(k)))
    return F.flatten(F.array(*groups))


def dds_facts(raw: Column) -> Column:
    groups = [_one("RECORD", raw, rf"(?i)\bR\s+({NAME})\b")]
    groups += [_many("REFERENCE", raw, rf"(?i)\b{k}\((?:[^)/]+/)?([A-Z0-9_#$@]+)", F.lit(k)) for k in DDS_KEYWORDS]
    return F.flatten(F.array(*groups))


def binder_facts(raw: Column) -> Column:
    return F.flatten(F.array(_one("EXPORT", raw, r"(?i)\bEXPORT\s+SYMBOL\(\s*['\"]?([^'\")]+)"), _one("EXPORT_LEVEL", raw, r"(?i)\bSTRPGMEXP\s+PGMLVL\(\*?([A-Z]+)\)")))


def source_facts(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, line, type, fact, name, detail of all lines that are no comments."""
    kind = source_type(F.col("path"))
    lines = spread(files.select("path", "content"), "content").select("path", kind.alias("type"), F.posexplode(F.split("content", "\r\n|\r|\n", -1)).alias("pos", "raw"))
    raw = F.col("raw")
    family = F.when(F.col("type").isin("BND", "BINDER", "BNDSRC"), "BINDER").otherwise(source_family(F.col("type")))
    facts = F.when(family == "CL", cl_facts(raw)).when(family == "DDS", dds_facts(raw)).when(family == "BINDER", binder_facts(raw)).otherwise(rpg_facts(raw))
    live = lines.filter(~is_comment(raw))
    return live.select("path", (F.col("pos") + 1).cast("long").alias("line"), "type", F.explode(facts).alias("f")).select("path", "line", "type", "f.fact", "f.name", "f.detail")


def export_levels(facts: DataFrame) -> DataFrame:
    """Exports with the level that the last STRPGMEXP before them named."""
    w = Window.partitionBy("path").orderBy("line")
    level = F.last(F.when(F.col("fact") == "EXPORT_LEVEL", F.col("name")), ignorenulls=True).over(w)
    return facts.filter("fact in ('EXPORT', 'EXPORT_LEVEL')").withColumn("level", level).filter("fact = 'EXPORT'").select("path", "line", "name", "level")


def owners(facts: DataFrame) -> DataFrame:
    """Facts with the procedure that started last before them in their file."""
    w = Window.partitionBy("path").orderBy("line")
    return facts.withColumn("owner", F.last(F.when(F.col("fact") == "PROCEDURE", F.col("name")), ignorenulls=True).over(w))


def classified_calls(facts: DataFrame) -> DataFrame:
    """Procedure calls as INTERNAL (declared in the file), EXTERNAL (prototyped) or UNRESOLVED, and dynamic ones."""
    calls = facts.filter("fact in ('PROCEDURE_CALL', 'DYNAMIC_CALL')")
    known = facts.filter("fact in ('PROCEDURE', 'PROTOTYPE')").groupBy(F.col("path").alias("k_path"), F.col("name").alias("k_name")).agg(F.bool_or(F.col("fact") == "PROCEDURE").alias("local"))
    joined = calls.join(known, (F.col("path") == F.col("k_path")) & (F.col("name") == F.col("k_name")), "left")
    how = F.when(F.col("fact") == "DYNAMIC_CALL", "DYNAMIC").when(F.col("local"), "INTERNAL").when(~F.col("local"), "EXTERNAL").otherwise("UNRESOLVED")
    return joined.select("path", "line", "name", how.alias("resolution"))


def file_usage(facts: DataFrame) -> DataFrame:
    """Per file and native file: what its opcodes do to it, and the opcodes."""
    table = facts.sparkSession.createDataFrame([(k, *v) for k, v in OPCODES.items()], "opcode string, access string, keyed boolean, interactive boolean, changing boolean")
    io = facts.filter("fact = 'NATIVE_IO'").join(F.broadcast(table), F.col("detail") == F.col("opcode"))  # eleven rows
    return io.groupBy("path", "name").agg(
        *(F.bool_or(F.col("access") == a).alias(a.lower()) for a in ("READ", "WRITE", "UPDATE", "DELETE", "POSITION", "DISPLAY")),
        F.bool_or("keyed").alias("keyed"), F.bool_or("interactive").alias("interactive"), F.bool_or("changing").alias("changing"), F.array_sort(F.collect_set("opcode")).alias("opcodes"),
    )


def embedded_statements(files: DataFrame) -> DataFrame:
    """path, start, end, text of EXEC SQL statements: from their line to the one with a semicolon, the next start, or the end."""
    lines = spread(files.select("path", "content"), "content").select("path", F.posexplode(F.split("content", "\r\n|\r|\n", -1)).alias("pos", "raw")).withColumn("line", (F.col("pos") + 1).cast("long"))
    w = Window.partitionBy("path").orderBy("line")
    begins = F.col("raw").rlike(r"(?i)\bEXEC\s+SQL\b")
    numbered = lines.withColumn("number", F.sum(begins.cast("long")).over(w)).filter("number > 0")
    inside = Window.partitionBy("path", "number").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    open_ = numbered.withColumn("closed", F.coalesce(F.max(F.col("raw").contains(";").cast("int")).over(inside), F.lit(0))).filter("closed = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), " ")
    out = open_.groupBy("path", "number").agg(F.min("line").alias("start"), F.max("line").alias("end"), text.alias("text"))
    return out.select("path", "start", "end", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
