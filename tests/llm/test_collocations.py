"""Collocations against a brute-force count on small texts, also where units, buckets and shares are tiny."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import collocations


def brute(rows, least, top):
    counts, totals, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {x: n for x, n in counts.items() if n >= least and len(x[1]) > 1}
    for (lang, w), a in found.items():
        longer = [n for (o, v), n in found.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    ranked = []
    for lang in {x[0] for x in out}:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


def rows_of(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("piece", "unit", "m", "n", "id", "word")})
    return sorted(map(tuple, collocations.collocations(docs, **limits).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, monkeypatch, small):
    if small:
        for name, value in {"UNIT_CHARS": 300, "BUCKET_REQUESTS": 20, "LEFT_OCCURRENCES": 3, "RANK_PARTS": 3}.items():
            monkeypatch.setattr(collocations, name, value)
    r = random.Random(5)
    vocabulary = ["a", "B", "ß", "É", "x1", "İ", "日本"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", " \t", ". ", "\n", "\x0b", "!"]) for _ in range(r.randint(0, 25)))
    rows = [(r.choice([text(), "a B a B a B ß", "a a a a a a"]), r.choice(["en", "de", None])) for _ in range(150)]
    assert rows_of(spark, rows, least=3) == brute(rows, 3, 2000)
    assert rows_of(spark, rows, least=3, top=7) == brute(rows, 3, 7)


def test_odd_rows(spark):
    long = "one two three four. " * 4000 + "five " * 30000
    rows = [(None, "en"), ("", "en"), (" \t ", None), (".,;", "en"), (long, "en"), (long, "en"), ("solo", "fr"), ("a\x00b c", "de")] + [("a\x00b c", "de")] * 40
    assert rows_of(spark, rows) == brute(rows, 30, 2000)


def test_nothing_to_report(spark):
    assert rows_of(spark, [("few words here", "en")]) == [] and rows_of(spark, [(None, None)]) == []
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations.collocations(docs).count() == 0


def test_equal_pieces_become_one_row(spark):
    docs = spark.createDataFrame([("A b.a  b", "en"), ("a\tb", "en"), ("a b", None)], "text string, lang string")
    assert {tuple(r) for r in collocations.distinct_pieces(docs).collect()} == {("en", "a b", 3), ("und", "a b", 1)}


def test_buckets_of_little_memory(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_MEMORY", "20MB")
    docs = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id") % 3000, F.lit(" x"), F.col("id") % 7, F.lit(" y"), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    got = [r["a"] for r in collocations.collocations(docs, least=2, top=10**6).collect()]
    assert len(got) == 21_000 and sum(got) == 60_000


def test_cut_forms_pieces_by_bytes_and_counts_them_in_the_batch():
    import pyarrow as pa

    texts = ["A  b\tC, Éé  x. a b c", "a b c!!\x0b\x0c  \n\u00a0Z\u00a0;a    b", None, "", " \t "]
    batch = pa.record_batch({"lang": pa.array(["x", "x", "x", "y", "y"]), "text": pa.array([t or "" for t in texts])})
    for part in (batch, pa.concat_batches([batch, batch]).slice(5)):
        found = [row for out in collocations._cut([part]) for row in out.to_pylist()]
        assert {(r["lang"], r["piece"]): r["m"] for r in found} == {("x", "a b c"): 3, ("x", "Éé x"): 1, ("x", "\u00a0z\u00a0"): 1, ("x", "a b"): 1}
        assert len(found) == 4
