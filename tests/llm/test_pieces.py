"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tracewell.llm import pieces

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.default_model_path())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.default_model_path())


def agree(model, library, texts):
    for text, ids, wanted in zip(texts, model.encode(texts), library.encode(texts), strict=True):
        assert ids.tolist() == wanted, text[:100]
        assert model.decode(ids) == library.decode(wanted)


def test_odd_texts(model, library):
    agree(model, library, ["", " ", "\n", " \n", "a \n", "\x00a", "a\tb\nc\n\n d", "▁x", "ab\ncd ▁▁ e▁", "é̂ ﬁ Ａ 日本語 🙂 текст", " \n" * 7 + "a \nb\n c  \n\nd "])
    agree(model, library, [" " * k for k in range(120)] + [" " * k + "the" + " " * k for k in range(60)])
    agree(model, library, ["x" * 3000, "aé" * 3000 + "ab" * 20000, "ab " * 50000, "".join(chr(97 + k * k % 26) for k in range(50000))])


def test_random_texts(model, library):
    r = random.Random(1)
    make = [
        lambda: "".join(r.choice("ab e\n") for _ in range(r.randint(0, 40))),
        lambda: "".join(r.choice("thenigrao s,.é") for _ in range(r.randint(0, 60))),
        lambda: "".join(r.choice(model.symbols) for _ in range(r.randint(1, 12))),
    ]
    agree(model, library, [r.choice(make)() for _ in range(6000)])


def test_compatibility_is_that_of_merging_anew(model):
    """The walk along the ends of two pieces decides as merging all their characters does."""
    r = random.Random(2)
    for _ in range(20000):
        a, b = r.choice(model.symbols), r.choice(model.symbols)
        assert model._compatible(model.place[a], model.place[b]) == (model.merged(a + b) == [a, b]), (a, b)


def test_decoding_of_any_ids(model, library):
    r = random.Random(3)
    for _ in range(3000):
        ids = np.array([r.randrange(32000) if r.random() < 0.5 else r.randrange(260) for _ in range(r.randint(0, 20))], np.int32)
        assert model.decode(ids) == library.decode(ids.tolist())


def test_small_caches_change_nothing(library, monkeypatch):
    for name in ("REMEMBERED_CHUNKS", "REMEMBERED_PAIRS", "SEARCH_CHARS", "LONG_RUN"):
        monkeypatch.setattr(pieces, name, 10)
    model = pieces.PieceModel(pieces.default_model_path())
    r = random.Random(4)
    for _ in range(20):
        agree(model, library, [" ".join("".join(r.choice("etaoin,") for _ in range(r.randint(1, 80))) for _ in range(30)) for _ in range(5)])


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(pieces.default_model_path()).read_bytes())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="only BPE"):
        pieces.PieceModel(str(tmp_path / "m.model"))


def test_rows_of_any_kind(spark, library):
    """Null, empty and very long texts, null and repeated ids, clashing columns, an empty table."""
    long = "".join(f"word{k % 977} " for k in range(60000))
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "lang")})
    encoded = pieces.encode_texts(docs)
    got = pieces.decode_ids(encoded, digests=True).collect()
    wanted = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        wanted.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert {r["text"] for r in pieces.decode_ids(encoded).collect()} == {"", "a b", "same", long}
    assert pieces.decode_ids(pieces.encode_texts(docs.limit(0)), digests=True).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_query_agrees_with_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.query(spark, str(DATA)).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = library.encode(row["text"] or "")
        assert got[row["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
