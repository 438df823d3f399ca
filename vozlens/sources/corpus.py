"""Segment tables by split, read without their blob columns, and what that pruning saves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_split(spark: SparkSession, root: str, split: str, schema: T.StructType | None = None) -> DataFrame:
    """All shards ``<root>/<split>-*.parquet``; an error where there are none."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{split}-*.parquet").withColumn("split", F.lit(split))


def read_metadata(spark: SparkSession, root: str, splits: Sequence[str], exclude: Sequence[str] = ("audio",), schema: T.StructType | None = None) -> DataFrame:
    """Every split's shards in one frame, without the excluded columns, which then never leave the files."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_split(spark, root, s, schema).drop(*exclude) for s in splits])


def split_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("split").agg(F.count("*").alias("n_rows"))


def files_of(spark: SparkSession, paths: str) -> DataFrame:
    """(path, length) of the files, spread over tasks; their contents aren't read."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length")
    return found.repartition(spark.sparkContext.defaultParallelism, "path")


def opened(path: str):
    """A random-access file of any store that Arrow knows by its scheme."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def footprint(spark: SparkSession, paths: str, exclude: Sequence[str] = ("audio",)) -> DataFrame:
    """Per file, row group and column: compressed bytes and whether the projection reads them.

    Executors read footers only, by ranged reads.
    """
    excluded = set(exclude)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for frame in frames:
            out = []
            for path in frame["path"]:
                with opened(path) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        name = column.path_in_schema.split(".")[0]
                        low = column.dictionary_page_offset or column.data_page_offset
                        out.append((path, g, group.num_rows, name, low, low + column.total_compressed_size, name not in excluded))
            yield pd.DataFrame(out, columns=["path", "row_group", "n_rows", "column", "low", "high", "is_read"])

    return files_of(spark, paths).mapInPandas(run, "path string, row_group int, n_rows long, column string, low long, high long, is_read boolean")


def index_shards(spark: SparkSession, paths: str, key: str) -> DataFrame:
    """(path, row_group, key, n_bytes): which row group of which shard holds each key, with the group's bytes of all columns; only the key column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    shard = pq.ParquetFile(f)
                    for g in range(shard.num_row_groups):
                        keys = shard.read_row_group(g, columns=[key]).column(0).combine_chunks().cast(pa.string())
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([g] * n, pa.int32()), keys, pa.array([shard.metadata.row_group(g).total_byte_size] * n, pa.int64())], ["path", "row_group", key, "n_bytes"])

    return files_of(spark, paths).mapInArrow(run, f"path string, row_group int, {key} string, n_bytes long")


def fetch(planned: DataFrame, key: str, blob: str) -> DataFrame:
    """(key, blob) of the wanted keys, by reading only their row groups, and of those only the two columns.

    ``planned`` has path, row_group and wanted (array of keys), one row a row group; groups are
    dealt one by one, since each is a read of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in batches:
            for path, group, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(path) as f:
                    found = pq.ParquetFile(f, pre_buffer=False).read_row_group(group, columns=[key, blob])
                keys = found.column(key).cast(pa.string())
                mask = pc.is_in(keys, value_set=pa.array(wanted, pa.string()))
                some = pa.table({key: keys.filter(mask), blob: found.column(blob).filter(mask).cast(pa.binary())})
                yield from some.to_batches()

    dealt = planned.select("path", "row_group", "wanted").repartition("path", "row_group")
    return dealt.mapInArrow(run, f"{key} string, {blob} binary")
