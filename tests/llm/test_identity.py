"""Texts that a hash by powers of one base takes for equal: the a/b sequence of the parities of one bits, and its complement."""

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontamination, jaccard_join, token_files
from tracewell.llm.words import WordSplitter, blank_words


def twins(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 128, 1024, 4096, 65536])
def test_words_are_told_apart(n):
    hashes, _ = WordSplitter(blank_words())(pa.array(list(twins(n))))
    assert hashes[0] != hashes[1]


def test_items_of_another_word_hit_nothing(spark):
    a, b = twins(1024)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x {b} y")], "doc_id long, text string")
    items = spark.createDataFrame([("7", b)], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_documents_of_another_word_are_not_joined(spark):
    a, b = twins(1024)
    rows = [(1, a), (2, b), (3, b), (4, f"{a} " * 5 + "end"), (5, f"{b} " * 5 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


@pytest.mark.parametrize("n", [64, 100, 128, 200, 1024, 4096])
def test_chunks_are_told_apart(n):
    a, b = twins(n)
    for texts in ([a, b], [b, a], [f"x {a} {b}", b, a, f"{b} {a}"], [b + " " + "w " * 50 + a, a]):
        for held in (True, False):
            encoder = token_files.TextEncoder(token_files.default_tokenizer_path())
            if held:
                list(encoder.encode(pa.array([a])))
            got = [ids.as_py() for _, _, part in encoder.encode(pa.array(texts)) for ids in part]
            wanted = [np.asarray([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID], encoder.kind).tobytes() for t in texts]
            assert got == wanted
