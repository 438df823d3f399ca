"""JSON lines, CSV and window tables with a provenance sidecar."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
WINDOW_SCHEMA = T.StructType(
    [
        *[T.StructField(n, _TEXT) for n in ("window_id", "speaker_code", "audio_name", "split", "region")],
        T.StructField("age", _LONG),
        T.StructField("segment_file_paths", T.ArrayType(_TEXT)),
        *[T.StructField(n, _DOUBLE) for n in ("start_time", "end_time", "duration_s")],
        T.StructField("n_segments", _LONG),
        T.StructField("reference_text", _TEXT),
        *[T.StructField(n, _LONG) for n in ("position_index", "n_candidates_for_speaker")],
        T.StructField("content_sha", _TEXT),
    ]
)


#: Fields without which a window is none.
REQUIRED = ("window_id", "speaker_code", "segment_file_paths", "reference_text")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of the schema; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def typed(df: DataFrame, raw: str, schema: T.StructType, defaults: Mapping[str, object]) -> DataFrame:
    """The JSON objects of column ``raw`` as columns of the schema, those of ``defaults`` filled where a value is absent; a broken object is an error."""
    fields = F.from_json(raw, schema, {"mode": "FAILFAST"})
    out = df.withColumn("_fields", fields)
    filled = [F.coalesce(f"_fields.{f.name}", F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else F.col(f"_fields.{f.name}") for f in schema.fields]
    return out.select(*[c for c in df.columns if c != raw], *[c.alias(f.name) for c, f in zip(filled, schema.fields, strict=True)])


def write_jsonl(df: DataFrame, path: str, order: list[str], append: bool = False) -> None:
    """Sorted records with keys in alphabetical order."""
    out = df.select(*sorted(df.columns)).orderBy(*order)
    out.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One file with a header, for tables of report size."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_windows(df: DataFrame, path: str, provenance: dict) -> None:
    """The fixed schema in its order, and beside it the provenance as one JSON line."""
    missing = [f.name for f in WINDOW_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"the windows lack {missing}")
    df.select(*[F.col(f.name).cast(f.dataType) for f in WINDOW_SCHEMA]).sortWithinPartitions("speaker_code", "window_id").write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_provenance")


def read_windows(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Windows from Parquet or JSON lines, by the path's ending; a row without a required field is an error where it is read."""
    jsonl = path.rstrip("/").endswith((".jsonl", ".json"))
    df = spark.read.schema(WINDOW_SCHEMA).option("mode", "FAILFAST").json(path) if jsonl else spark.read.parquet(path)
    lacking = [f.name for f in WINDOW_SCHEMA if f.name not in df.columns]
    if lacking:
        raise ValueError(f"the windows lack {lacking}")
    for name in REQUIRED:
        lost = F.raise_error(F.lit(f"a window lacks {name}")).cast(WINDOW_SCHEMA[name].dataType)
        df = df.withColumn(name, F.when(F.col(name).isNull(), lost).otherwise(F.col(name)))
    try:
        found = spark.read.text(f"{path.rstrip('/')}_provenance").first()
    except Exception as e:  # a table without a sidecar has no provenance
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    return df, json.loads(found[0]) if found else {}


def first_windows(windows: DataFrame, n: int | None) -> DataFrame:
    """The first n in canonical order (by id), for a limited run; all where n is None."""
    return windows if n is None else windows.orderBy("window_id").limit(n)


def revision(spark: SparkSession, path: str) -> str:
    """A pin of a table's state for provenance: SHA-256 over names, sizes and times of its files, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    entry = F.concat_ws("|", F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.select(F.sha2(entry, 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("pin")).first()["pin"]


def save_summaries(path: str, stage: str, payload: dict) -> None:
    """A stage's summary in a small JSON file on the driver, keys sorted, other stages' kept."""
    found = load_summaries(path) | {stage: payload}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, sort_keys=True, ensure_ascii=False, indent=2)


def load_summaries(path: str) -> dict:
    """All stages' summaries; none where there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}
