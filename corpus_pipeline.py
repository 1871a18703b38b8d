"""Corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns documents'
columns (the last returns the token files' rows). run() applies them, each stage's rows written to the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontamination, jaccard_join, language_id, mixing, token_files
from tracewell.llm._shared import discard, stage
from tracewell.llm.id_filter import without

#: A text is rejected where no language can be told (no letter), or none of the learned ones is likelier than this.
MIN_LANGUAGE_SCORE = 0.5
#: Files whose names are broadcast to number rows (about 100 bytes each).
MAX_FILES = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a determinable language. The model learns from the documents that are not held out."""
    model = language_id.train_on(docs)
    judged = language_id.identify(docs.select(F.struct(*docs.columns).alias("row")), model, "row.text", keep=("row",))
    return judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a __row that is unique and the same whenever it is read, so that rows with null or repeated ids are told apart.

    Rows read from Parquet are numbered by their file and their place in it. Any other frame is stored with numbers."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith(("LogicalRelation", "Relation")):
        hidden = docs.metadataColumn("_metadata")
        placed = docs.select("*", hidden.getField("file_path").alias("__path"), hidden.getField("row_index").alias("__index"))
        files = stage(placed.select(F.col("__path").alias("__file")).distinct().repartition(1).withColumn("__number", F.monotonically_increasing_id()), "files")
        if files.count() <= MAX_FILES:  # the driver lists the files of a scan in any case
            numbered = placed.join(F.broadcast(files), F.col("__path") == F.col("__file"))
            return numbered.withColumn("__row", F.shiftleft("__number", 36) + F.col("__index")).drop("__path", "__index", "__file", "__number")
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that with the least id, and every one without words.

    Rows are decided one by one: of repeated rows one stays, and a null id comes after all others of its component."""
    rows = _numbered(docs)
    ids = rows.select("__row", "doc_id")
    classes = jaccard_join.similarity_components(rows.select(F.col("__row").alias("doc_id"), "text"))
    placed = ids.join(classes.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first"))
    kept = stage(first.select("first.__row"), "kept")
    copies = stage(ids.join(kept, "__row", "left_anti").select(F.col("__row").alias("id")), "copies")
    return without(rows, copies, "__row").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row that holds a window of a benchmark item, those with null or repeated ids too, each by its own text."""
    rows = _numbered(docs)
    index = decontamination.build_index(rows.select(F.col("__row").alias("doc_id"), "text"))
    found = decontamination.search_index(index, decontamination.store_windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    bad = stage(found.filter("n_hit > 0").select(F.col("doc_id").alias("id")), "contaminated")
    discard(index)
    return without(rows, bad, "__row").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix and what is read back from them."""
    return token_files.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Language ID and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
