"""What the operators of this subpackage share: tables, written intermediates, worker caches.

Nothing here collects rows.  Intermediates are Parquet tables in the shared
folder that the session names in ``spark.checkpoint.dir``, so a lost executor
costs a re-run of its tasks and never a lost table.
"""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers unpickle our functions by value: executors need pyspark and numpy, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vozlens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows that a Python worker gets at once; whole texts and sets of shingles are large rows.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``, unless they are smaller: JVM and worker hold a few batches of every running task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose plans are no longer referenced; else they stay until the JVM happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written intermediates that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(key: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; the folds of the contracts. Null ids are in no fold."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % modulus


def worker_cache(owner: str) -> dict:
    """A dictionary of ``owner``'s that outlives a task; Python workers are reused, so what another operator kept goes."""
    kept = sys.__dict__.setdefault("_vozlens_worker_cache", {})
    if owner not in kept:
        kept.clear()
    return kept.setdefault(owner, {})


def cut(batch: pa.RecordBatch, text: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes of text each; a longer text comes alone.

    Only bounds the size of the arrays made at once: every row is in exactly one slice.
    """
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(np.asarray(sizes.to_numpy(zero_copy_only=False), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
