"""A filter of bounded size over ids: rows that can't be among them are known without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import fresh_dir, open_filesystem
from tracewell.llm.words import mix64

#: Bits of the filter: 16 an id, between these; beyond, more rows pass it, none is lost.
FILTER_BITS = (16, 27)


def _id_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each id in a filter of 2**bits bits."""
    x = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    return np.stack([(mix64(x + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(3)])


def id_filter(ids: DataFrame) -> Callable[[str], Column]:
    """A condition on a column of longs without nulls: true for all among ids(id), which is read twice, and for a few others.

    The filter is built from ids in Spark and read by the tasks from the shared folder; only the column crosses to Python, so
    what the rows hold besides is neither converted nor shuffled."""
    spark = ids.sparkSession
    size = FILTER_BITS[0]
    wanted = 16 * ids.count()
    while (1 << size) < wanted and size < FILTER_BITS[1]:
        size += 1
    bits = size

    def places(batches):
        for batch in batches:
            where = np.unique(_id_bits(np.asarray(batch.column("id")), bits))
            yield pa.RecordBatch.from_arrays([pa.array(where >> 5), pa.array(np.int64(1) << (where & 31))], ["word", "bit"])

    path = fresh_dir(spark, "id-filter")
    ids.select("id").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).write.parquet(path)
    loaded: list[np.ndarray] = []

    def table() -> np.ndarray:
        if not loaded:
            import pyarrow.fs as pafs

            fs, local = open_filesystem(path)
            out = np.zeros(1 << (bits - 5), np.uint32)
            for info in fs.get_file_info(pafs.FileSelector(local)):
                if info.path.endswith(".parquet"):
                    with fs.open_input_file(info.path) as source:
                        rows = pq.read_table(source)
                    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).astype(np.uint32)
            loaded.append(out)
        return loaded[0]

    @F.pandas_udf("boolean")
    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filter_ = table()
        for ids_ in batches:
            at = _id_bits(ids_.to_numpy(), bits)
            yield pd.Series(((filter_[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=0))

    return among


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key (a long, not null) isn't among gone(id). Only rows that the filter takes for gone ones are shuffled."""
    maybe = id_filter(gone)(key)
    renamed = gone.select(F.col("id").alias("__gone"))
    return rows.filter(~maybe).unionByName(rows.filter(maybe).join(renamed, F.col(key) == F.col("__gone"), "left_anti"))
