"""The pipeline's stages on the smallest tables and on odd input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import decontamination, jaccard_join

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.stage(stages["language_id"](spark, docs, str(DATA)), "t")
    assert one.columns == columns and one.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    two = corpus_pipeline.stage(stages["near_duplicates"](spark, one, str(DATA)), "t")
    groups = jaccard_join.similarity_components(one)
    assert two.columns == columns and two.count() == groups.select("component_id").distinct().count()
    three = corpus_pipeline.stage(stages["decontamination"](spark, two, str(DATA)), "t")
    left = decontamination.decontaminate(three, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert 0 < three.count() < two.count() and left.filter("n_hit > 0").count() == 0
    four = corpus_pipeline.stage(stages["source_mixing"](spark, three, str(DATA)), "t")
    most = four.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert four.columns == columns and most <= 3
    five = stages["token_files"](spark, four, str(DATA))
    assert five.count() == four.count()


def test_empty_input_runs_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).withColumn("score", F.lit(1))
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, str(DATA)), f"e-{name}")
    assert docs.count() == 0


def test_rows_with_null_and_repeated_ids_are_decided(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(None, text), (5, text), (5, text), (3, text), (3, text), (None, None), (None, "lone words of a row"), (None, "lone words of a row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(DATA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(3, text), (None, None), (None, "lone words of a row")], key=repr)
    docs = spark.createDataFrame([(None, item), (1, item), (1, "clean"), (None, "clean too"), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.remove_contaminated(spark, docs, str(DATA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, "clean"), (None, "clean too"), (None, None)], key=repr)


def test_rows_of_files_are_numbered_in_place(spark, tmp_path):
    spark.range(1000).withColumn("text", F.lit("a b c")).repartition(7).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    rows = corpus_pipeline._numbered(docs)
    # the rows come from their own files; only the numbers of files are stored
    assert rows.columns == [*docs.columns, "__row"] and set(docs.inputFiles()) <= set(rows.inputFiles())
    got = {r["__row"]: r["id"] for r in rows.collect()}
    assert len(got) == 1000 and got == {r["__row"]: r["id"] for r in rows.select("__row", "id").repartition(3).collect()}
    stored = corpus_pipeline._numbered(docs.withColumn("more", F.lit(1)))
    assert stored.select("__row").distinct().count() == 1000


def test_odd_rows_run_through(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns with names that operators use themselves."""
    long = " ".join(f"w{k % 9973}" for k in range(50_000))
    words = " ".join(f"plain{k}" for k in range(30))
    rows = [(1, words, "s"), (1, words, "s"), (2, words, None), (None, words + " and more", "t"), (3, None, "s"), (4, "", "s"), (5, long, "s"), (6, "12 34", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("lang", "score", "n", "one", "key", "part", "tree", "id", "row", "size", "bits", "maybe", "lang_pred")})
    frame.write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    columns = docs.columns
    wanted = [{(1, 1), (2, 1), (None, 1), (5, 1)}, {(1, 1), (5, 1)}, {(1, 1), (5, 1)}]
    for (name, function), expected in zip(corpus_pipeline.STAGES, wanted, strict=False):
        docs = corpus_pipeline.stage(function(spark, docs, str(DATA)), f"odd-{name}")
        assert docs.columns == columns and {(r["doc_id"], 1) for r in docs.collect()} == expected, name
    mixed = corpus_pipeline.stage(corpus_pipeline.mix_sources(spark, docs, str(DATA)), "odd-mix")
    assert mixed.columns == columns
    assert corpus_pipeline.write_tokens(spark, mixed, str(DATA)).count() == mixed.count()
