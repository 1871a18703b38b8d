"""Quality rules: decision lists learned by sequential covering and emitted as ordered Spark conditions.

Statistics and verdicts are DataFrame expressions only. The list is fitted on the driver from the
statistics of at most MAX_FIT_ROWS labelled documents (a documented bound of the fit; the verdict
covers every row): each rule is grown condition by condition for the largest information gain,
pruned on held-back rows, and kept only while it stays precise there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_FIT_ROWS = 8000
MIN_PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4

Condition = tuple[str, str, float]

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")
#: Name -> expression over STATISTICS; every one is defined for a document without words.
FEATURES = {
    "words": "cast(n_words as double)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Number of words within 3-word windows that occur twice or more, first occurrences included."""

    def covered(keys: Column) -> Column:
        entries = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def spread(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda e, j: F.coalesce((j > 0) & (F.get(s, j - 1)["k"] == e["k"]), F.lit(False))
                | F.coalesce(F.get(s, j + 1)["k"] == e["k"], F.lit(False)),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(entries, spread))

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(hashed, lambda h: _let(windows(h), covered))).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep plus STATISTICS of every whole text, in one narrow stage (no shuffle). A null text has no words and no lines."""
    text = F.coalesce(F.col("text_"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_removed(x, BLANKS)) > 0)
    counted = lambda c: c.cast("long")
    return (
        docs.select(*keep, F.col(text_col).alias("text_"))
        .withColumn("words_", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("lines_", lines)
        .select(
            *keep,
            counted(F.size("words_")).alias("n_words"),
            counted(F.length(_removed(text, BLANKS))).alias("word_chars"),
            counted(F.length(text) - F.length(_removed(text, SYMBOLS))).alias("n_symbols"),
            counted(F.size("lines_") - F.size(F.array_distinct("lines_"))).alias("n_dup_lines"),
            repeated_words(F.col("words_")).alias("n_repeat_words"),
            counted(F.size("lines_")).alias("n_lines"),
            counted(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
            counted(F.length(text) - F.length(_removed(text, "!"))).alias("n_bangs"),
        )
    )


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> list[tuple[tuple[float, ...], int]]:
    """(features, label) of at most about max_rows labelled documents, chosen by a hash of the id."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    there = known.count()
    if not there:
        return []
    million = 1_000_000
    part = min(million, max(1, max_rows * million // there))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < part).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # bounded by max_rows
    rows = statistics(sample, keep=("doc_id", "quality")).selectExpr("doc_id", "quality", *(f"{e} as {k}" for k, e in FEATURES.items())).collect()
    rows.sort(key=lambda r: tuple(r))
    return [(tuple(float(r[k]) for k in FEATURES), int(r["quality"])) for r in rows]


def _holds(rule: Sequence[Condition], values: Sequence[float], names: Sequence[str]) -> bool:
    return all(values[names.index(f)] > t if op == ">" else values[names.index(f)] <= t for f, op, t in rule)


def _best_condition(rows, names) -> tuple[float, Condition | None]:
    """The threshold test with the largest FOIL gain for class 0 among rows."""
    pos = sum(1 for _, y in rows if y == 0)
    neg = len(rows) - pos
    before = math.log2(pos / (pos + neg))
    best: tuple[float, Condition | None] = (1e-9, None)
    for k, name in enumerate(names):
        ordered = sorted((values[k], y) for values, y in rows)
        p = n = 0
        for (value, y), (following, _) in zip(ordered, ordered[1:], strict=False):
            p, n = p + (y == 0), n + (y != 0)
            if value == following:
                continue
            cut = (value + following) / 2
            for op, a, b in (("<=", p, n), (">", pos - p, neg - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > best[0]:
                    best = (gain, (name, op, cut))
    return best


def learn_decision_list(
    rows: Sequence[tuple[tuple[float, ...], int]],
    names: Sequence[str] = tuple(FEATURES),
    min_precision: float = MIN_PRECISION,
    min_cover: int = MIN_COVER,
    max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS,
) -> list[list[Condition]]:
    """Ordered rules for class 0 (reject) by sequential covering. No rows, or none of class 0: no rules."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and sum(y == 0 for _, y in grow) >= min_cover:
        rule: list[Condition] = []
        covered = grow
        while len(rule) < max_conditions and any(y for _, y in covered):
            _, condition = _best_condition(covered, names)
            if condition is None:
                break
            rule.append(condition)
            covered = [r for r in covered if _holds([condition], r[0], names)]
        if not rule:
            break

        def worth(candidate: list[Condition]) -> float:
            hit = [y for v, y in prune if _holds(candidate, v, names)]  # noqa: B023
            good = sum(y == 0 for y in hit)
            return (good - (len(hit) - good)) / len(hit) if hit else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [y for v, y in (*grow, *prune) if _holds(rule, v, names)]
        held = [y for v, y in prune if _holds(rule, v, names)]
        precise = lambda ys: not ys or sum(y == 0 for y in ys) >= min_precision * len(ys)
        if len(hit) < min_cover or not precise(hit) or not precise(held):
            break
        rules.append(rule)
        grow = [r for r in grow if not _holds(rule, r[0], names)]
        prune = [r for r in prune if not _holds(rule, r[0], names)]
    return rules


def base_failed() -> Column:
    """The fixed rules over n_words and n_repeat_words."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires, else null."""
    chain = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for feature, op, cut in rule:
            value = F.expr(FEATURES[feature])
            test = test & (value > cut if op == ">" else value <= cut)
        chain = F.when(test, F.lit(number)) if chain is None else chain.when(test, F.lit(number))
    return chain if chain is not None else F.lit(None).cast("int")


def apply_rules(docs: DataFrame, rules: Sequence[Sequence[Condition]]) -> DataFrame:
    """doc_id, STATISTICS, base_failed, rule (first learned rule that fires), kept for every row, repeated rows included."""
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_decision_list(labelled_statistics(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
