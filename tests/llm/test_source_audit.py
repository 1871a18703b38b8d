"""The source audit against brute force on small texts; the tokenizer, the hash and the exact arithmetic against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import source_audit
from tracewell.llm.words import text_bytes

import pyarrow as pa  # isort: skip

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least):
    docs, counts, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(low(text))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    vocabulary = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            vocabulary[lang].append(t)
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    p, q = {}, {}
    for lang, source in groups:
        v = vocabulary[lang]
        n = sum(counts[lang, source, t] for t in v)
        p[lang, source] = {t: share(counts[lang, source, t], n, len(v)) for t in v}
        sums = {t: sum(counts[lang, s, t] for o, s in groups if o == lang) for t in v}
        q[lang] = {t: share(sums[t], sum(sums.values()), len(v)) for t in v}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(-sum(gap(mine[t], p[lang, s][t]) for t in mine), s.encode()) for o, s in groups if o == lang and s != source]
        terms = [(-gap(mine[t], q[lang][t]), t.encode()) for t in mine if counts[lang, source, t] and mine[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "n", "docs", "kept", "bucket", "part", "total")})
    return sorted(map(tuple, source_audit.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(source_audit, "BUCKET_COUNTS", 7)
        monkeypatch.setattr(source_audit, "BLOCK_SOURCES", 2)
    r = random.Random(6)
    words = ["a", "B", "ß", "É", "x1y", "İ", "日本", "Don't", "_", "42", "longword" * 6] + [chr(97 + k) * 2 for k in range(20)]
    rows = [(r.choice([None, "", "".join(r.choice(words) + r.choice([" ", "-", "\n", ""]) for _ in range(r.randint(0, 30)))]), r.choice(["en", "de", None, "zz"]), r.choice(["s1", "s2", "S3", "é", None, "t" * 40])) for _ in range(300)]
    rows += [("only here", "fr", "s1"), ("and there", "fr", "s2"), (None, "xx", "s9")]
    assert audited(spark, rows) == brute(rows, 10)


def test_odd_tables(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(long, "en", "a")] * 6 + [("alpha beta", "en", "b")] * 6 + [("same row", "en", "b")] * 12
    assert audited(spark, rows) == brute(rows, 10)
    assert audited(spark, [("no term kept", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    empty = source_audit.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert empty.count() == 0 and set(empty.columns) == {"lang", "source", "part", "item", "value", "rank"}


def test_terms_and_hashes(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice("aB é1日_") for _ in range(r.randint(0, 50))) for _ in range(400)] + ["z" * n for n in range(70)]
    data, rows = text_bytes(pa.array(texts))
    begin, length = source_audit.find_terms(data, rows)
    slices = [data[a : a + n].tobytes() for a, n in zip(begin, length, strict=True)]
    assert slices == [t.encode() for x in texts for t in TERM.findall(x)]
    assert source_audit.hash_slices(data, begin, length).tolist() == [xxhash.xxh64_intdigest(x) for x in slices]
    for hashing in (source_audit.hash_slices, lambda d, b, n: n.astype(np.uint64) % 3, lambda d, b, n: np.zeros(len(b), np.uint64)):
        for most in (40, 4_000_000):
            monkeypatch.setattr(source_audit, "hash_slices", hashing)
            monkeypatch.setattr(source_audit, "COMPARED_BYTES", most)
            order, number = source_audit.group_slices(data, begin, length)
            ranked = [slices[k] for k in order]
            assert len({(x, n) for x, n in zip(ranked, number.tolist(), strict=True)}) == len(set(slices)) == len(set(number.tolist()))
            assert all(a < b for a, b, x, y in zip(order, order[1:], number, number[1:], strict=False) if x == y) and (np.diff(number) >= 0).all()


def test_exact_shares():
    r = random.Random(8)
    totals = [r.randrange(2, 9 * 10**15) for _ in range(2000)] + [2, 3, 9 * 10**15]
    counts = [r.randrange(max(1, n - 1)) for n in totals]
    got = [int(source_audit.scaled(np.array([c]), n)[0]) for c, n in zip(counts, totals, strict=True)]
    assert got == [1 + 10**9 * (c + 2) // n for c, n in zip(counts, totals, strict=True)]
