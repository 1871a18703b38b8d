"""Blocks of program source: prototypes, procedures with their parameters, and subroutines, from their opening to their closing line.

A line is cut into words once: quoted texts, words with their dashes, single marks. Which words open and close a block stands in one table; names and bracketed
arguments are read off their neighbours. One block is open at a time, what it holds opens no other. Only lines that open or close something take part in
the fold over a file, so a file's state is a handful of rows however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.source_lines import is_comment

#: A word of a line: a quoted text, letters, digits, signs of names and dashes, or one mark.
WORD = r"'[^']*'|\"[^\"]*\"|[A-Za-z0-9_#$@*%-]+|\S"
#: Kind of block -> the word that opens it (the name follows; BEGSR in fixed form comes after it) and the one that closes it.
BLOCKS = {"PROTOTYPE": ("DCL-PR", "END-PR"), "PROCEDURE": ("DCL-PROC", "END-PROC"), "SUBROUTINE": ("BEGSR", "ENDSR")}
# Types of parameters; those that only the line of the interface itself is searched for.
PARAMETER_TYPES = ("LIKE", "CHAR", "ZONED", "PACKED", "INT", "UNS", "DATE", "TIME", "TIMESTAMP", "VARCHAR", "IND")
INLINE_TYPES = (*PARAMETER_TYPES, "POINTER", "OBJECT")
_BLOCK = "struct<kind:string,name:string,start:bigint,end:bigint,head:array<string>>"


def line_words(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(WORD), F.lit(0))


def _at(words: Column, k: int | Column) -> Column:
    return F.coalesce(F.get(words, F.lit(k) if isinstance(k, int) else k), F.lit(""))


def _named(word: Column) -> Column:
    return F.when(word.rlike("^[A-Z0-9_#$@*]+$"), word)


def _opening(words: Column) -> Column:
    """struct<kind, name> of what a line opens, null for other lines."""
    first, out = _at(words, 0), F.lit(None).cast("struct<kind:string,name:string>")
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    # fixed form: C, name, BEGSR; the C may touch the name
    touched = F.when((F.length(first) > 1) & first.startswith("C"), F.substring(first, 2, 1 << 10)).otherwise(first)
    fixed = F.when((first == "C") & (_at(words, 2) == "BEGSR"), _named(_at(words, 1))).when(_at(words, 1) == "BEGSR", _named(touched))
    for kind, (opens, _) in reversed(BLOCKS.items()):
        name = _named(_at(words, 1))
        out = F.when((first == opens) & name.isNotNull(), pair(kind, name)).otherwise(out)
    return F.coalesce(out, F.when(fixed.isNotNull(), pair("SUBROUTINE", fixed)))


def _closes(kind: Column, words: Column) -> Column:
    test = F.lit(False)
    for k, (_, closing) in BLOCKS.items():
        test = test | ((kind == k) & F.array_contains(words, closing))
    return F.coalesce(test, F.lit(False))


def _marks(lines: Column) -> Column:
    """array<struct<line, words, open>> of the lines that open or close a block."""
    marked = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), _opening(x["words"]).alias("open")))
    ends = F.array(*(F.lit(closing) for _, closing in BLOCKS.values()))
    return F.filter(marked, lambda m: m["open"].isNotNull() | F.arrays_overlap(m["words"], ends))


def _folded(marks: Column, last: Column) -> Column:
    """array of blocks; one that nothing closes ends with the file."""
    none = F.lit(None).cast(_BLOCK)

    def block(kind: Column, name: Column, start: Column, end: Column, head: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"), start.alias("start"), end.alias("end"), head.alias("head")).cast(_BLOCK)

    def until(b: Column, end: Column) -> Column:
        return block(b["kind"], b["name"], b["start"], end, b["head"])

    def state(open_: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), out.alias("out"))

    def step(s: Column, m: Column) -> Column:
        held = s["open"]
        fresh = block(m["open"]["kind"], m["open"]["name"], m["line"], m["line"], m["words"])
        on_one_line = (m["open"]["kind"] != "SUBROUTINE") & _closes(m["open"]["kind"], m["words"])
        return (
            F.when(held.isNotNull() & _closes(held["kind"], m["words"]), state(none, F.concat(s["out"], F.array(until(held, m["line"])))))
            .when(held.isNotNull() | m["open"].isNull(), s)
            .when(on_one_line, state(none, F.concat(s["out"], F.array(fresh))))
            .otherwise(state(fresh, s["out"]))
        )

    start = state(none, F.array().cast(f"array<{_BLOCK}>"))
    return F.aggregate(marks, start, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(until(s["open"], last)))))


def _argument(words: Column, *keywords: str) -> Column:
    """The one name, quoted or not, in the brackets after the first of the keywords that has such."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda k: F.get(words, k).isin(*keywords) & (_at(words, k + 1) == "(") & (_at(words, k + 3) == ")"))
    inner = F.transform(places, lambda k: F.regexp_replace(_at(words, k + 2), "^['\"]\\s*|['\"]$", ""))
    return F.get(F.filter(inner, lambda w: w.rlike("^[A-Z0-9_#$@]+$")), 0)


def source_blocks(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, kind, name, start, end, exported, external, imported, n_parameters.

    external is the name in EXTPROC or EXTPGM; a prototype is imported where it has one or its file declares no procedure of that
    name. Parameters are counted from the first dcl-pi of a procedure on (dcl-parm lines, and names followed by a type, the name and
    return type of the dcl-pi line itself included). Comments are skipped; null contents give no block."""
    raw = F.split("content", "\r?\n", -1)
    numbered = F.transform(raw, lambda t, i: F.struct((i + 1).cast("long").alias("line"), t.alias("raw")))
    live = F.transform(F.filter(numbered, lambda x: ~is_comment(x["raw"])), lambda x: F.struct(x["line"].alias("line"), line_words(x["raw"]).alias("words")))
    lined = files.filter("content is not null").select("path", live.alias("lines"), F.size(raw).cast("long").alias("last"))
    found = lined.select("path", "lines", _folded(_marks(F.col("lines")), F.col("last")).alias("blocks"))
    each = found.select("path", "lines", F.col("blocks"), F.explode("blocks").alias("b"))
    within = F.filter("lines", lambda x: (x["line"] > F.col("b.start")) & (x["line"] < F.col("b.end")))
    pi = F.array_min(F.transform(F.filter(within, lambda x: _at(x["words"], 0) == "DCL-PI"), lambda x: x["line"]))
    own = F.flatten(F.transform(F.filter("lines", lambda x: x["line"] == F.col("pi")), lambda x: x["words"]))
    inline = F.filter(F.transform(own, lambda w, k: w.rlike("[A-Z0-9_#$@]$") & _at(own, k + 1).isin(*INLINE_TYPES)), lambda hit: hit)
    parameter = lambda w: (_at(w, 0) == "DCL-PARM") & (F.size(w) > 1) | (_at(w, 0).rlike("^[A-Z0-9_#$@]+$") & _at(w, 1).isin(*PARAMETER_TYPES))
    after = F.filter("lines", lambda x: (x["line"] > F.col("pi")) & (x["line"] < F.col("b.end")) & parameter(x["words"]) & ~F.array_contains(x["words"], "END-PI"))
    counted = F.when((F.col("b.kind") == "PROCEDURE") & F.col("pi").isNotNull(), F.size(inline) + F.size(after)).otherwise(0).cast("long")
    local = F.transform(F.filter("blocks", lambda x: x["kind"] == "PROCEDURE"), lambda x: x["name"])
    prototype = F.col("b.kind") == "PROTOTYPE"
    external = F.when(prototype, _argument(F.col("b.head"), "EXTPROC", "EXTPGM"))
    return each.withColumn("pi", pi).select(
        "path", "b.kind", "b.name", "b.start", "b.end", ((F.col("b.kind") != "SUBROUTINE") & F.array_contains("b.head", "EXPORT")).alias("exported"),
        external.alias("external"), (prototype & (external.isNotNull() | ~F.array_contains(local, F.col("b.name")))).alias("imported"), counted.alias("n_parameters"),
    )
