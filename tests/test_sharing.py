"""Replacement of many terms against replacing them one by one; numbering over partitions."""

import random

from pyspark.sql import functions as F

from tracewell.operators import sharing


def plain(text, terms, whole):
    """Longest first over what no earlier term has taken."""
    if text is None:
        return None
    marks = [None] * len(text)
    for term in sorted((t for t in terms if t), key=lambda t: (-len(t), t)):
        at = text.find(term)
        while at >= 0:
            end = at + len(term)
            touched = whole and (at and (text[at - 1].isalnum() or text[at - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"))
            if not touched and not any(marks[at:end]):
                marks[at:end] = [(at, term)] * len(term)
                at = text.find(term, end)
            else:
                at = text.find(term, at + 1)
    out, k = [], 0
    while k < len(text):
        if marks[k]:
            out.append(terms[marks[k][1]])
            k = marks[k][0] + len(marks[k][1])
        else:
            out.append(text[k])
            k += 1
    return "".join(out)


def test_replacement_of_overlapping_terms(spark):
    r = random.Random(11)
    terms = {t: f"<{k}>" for k, t in enumerate({"".join(r.choice("ab_é") for _ in range(r.randint(1, 4))) for _ in range(40)})}
    texts = [None, "", *("".join(r.choice("ab_é -") for _ in range(r.randint(0, 40))) for _ in range(200))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("put", F.lit("kept"))
    words = spark.createDataFrame([*terms.items(), (None, "x"), ("", "y"), (next(iter(terms)), "<~")], "term string, placeholder string")
    for whole in (False, True):
        for shard in (7, 1000):
            got = {x["id"]: (x["text"], x["put"]) for x in sharing.replace_dictionary(frame, "text", words, whole, shard).collect()}
            assert got == {k: (plain(t, terms, whole), "kept") for k, t in enumerate(texts)}
    assert sharing.replace_dictionary(frame, "text", words.limit(0)).exceptAll(frame).count() == 0


def test_a_hundred_thousand_terms(spark):
    words = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("term"), F.concat(F.lit("P"), "id").alias("placeholder"))
    texts = spark.range(2000).select("id", F.concat(F.lit("name"), F.col("id") * 49, F.lit(" and name"), F.col("id") + 5, F.lit("x")).alias("text"))
    wrong = sharing.replace_dictionary(texts, "text", words, whole_words=True, shard=60_000).filter(F.col("text") != F.concat(F.lit("P"), F.col("id") * 49, F.lit(" and name"), F.col("id") + 5, F.lit("x")))
    assert wrong.count() == 0


def test_numbers_run_over_partitions(spark):
    values = spark.range(3000).select(F.lit("one").alias("c"), F.concat(F.lit("v"), F.col("id") % 1200).alias("v"), (3000 - F.col("id")).alias("seen")).unionByName(spark.createDataFrame([(None, "n", 1), ("two", None, 1), ("two", "z", 5), ("two", "a", 5)], "c string, v string, seen long"))
    got = {(r["c"], r["v"]): r["placeholder"] for r in sharing.numbered_placeholders(values, "c", "v", "seen").collect()}
    firsts = {}
    for k in range(3000):
        firsts[f"v{k % 1200}"] = min(firsts.get(f"v{k % 1200}", 9999), 3000 - k)
    wanted = {("one", v): f"C_{n:03d}".replace("C_", "C_") for n, (v, _) in enumerate(sorted(firsts.items(), key=lambda x: (x[1], x[0])), 1)}
    assert {k: v.rpartition("_")[2] for k, v in got.items() if k[0] == "one"} == {k: v.rpartition("_")[2] for k, v in wanted.items()}
    assert got[("two", "a")].endswith("_001") and got[("two", "z")].endswith("_002") and ("two", None) not in got
