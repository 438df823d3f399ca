"""Planning of selective reads of blob columns, byte apportionment, manifests, and WAV decoding."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and the target rate.
OK, MISSING, UNDECODABLE = "ok", "segmento_ausente_no_dataset", "falha_na_decodificacao"
RATE = 16_000


#: Bytes of input, as its plan estimates them from packed files, for each task; in memory a range takes some thirty times as much.
TASK_BYTES = 4 << 20


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as their estimated size asks for, the session's number at least; small and unknown sizes are left to Spark."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = -(-size // TASK_BYTES)
    known = size < 1 << 50  # for what Spark can't know it says about 2**63
    return rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if known and n > 1 else rows


def coalesce_ranges(ranges: DataFrame, keys: Sequence[str], low: str, high: str, gap: int) -> DataFrame:
    """Ranges of a group that overlap or lie less than ``gap`` apart become one (gaps and islands).

    Tasks grow in number with the ranges, not in size; a group is in one task.
    """
    ranges = spread(ranges, keys)
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", (F.col(low) - reach >= gap).cast("int")).withColumn("_new", F.coalesce("_new", F.lit(1)))
    island = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return island.groupBy(*keys, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n"))


def group_bounds(groups: DataFrame, shard: str, group: str, rows: str) -> DataFrame:
    """First row and the row after the last of each row group, by prefix sums."""
    order = Window.partitionBy(shard).orderBy(group)
    upto = F.sum(rows).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumns({"row_from": upto - F.col(rows), "row_to": upto})


def rows_to_groups(rows: DataFrame, bounds: DataFrame, shard: str, row: str, group: str) -> DataFrame:
    """Each row's row group: the one whose range holds it (a range join within the shard)."""
    b = bounds.select(shard, group, "row_from", "row_to")
    return rows.join(b, shard).where((F.col(row) >= F.col("row_from")) & (F.col(row) < F.col("row_to"))).drop("row_from", "row_to")


def plan(index: DataFrame, wanted: DataFrame, key: str, shard: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(shard, row group, keys to read there), and the wanted keys that no shard has."""
    found = index.join(wanted.select(key).distinct(), key, "left_semi").groupBy(shard, group).agg(F.count_distinct(key).alias("n_wanted"))
    return found, wanted.select(key).distinct().join(index, key, "left_anti")


def fetch_plan(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(path, row_group, wanted, n_wanted, n_bytes) of the row groups of ``index`` that hold a wanted key; a group is bounded by its file's layout."""
    own = index.join(wanted.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
    return own.groupBy("path", "row_group").agg(F.collect_set(key).alias("wanted"), F.count_distinct(key).alias("n_wanted"), F.first("n_bytes").alias("n_bytes"))


def plan_bytes(index: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: bytes of the planned row groups, of all of them, and what the plan avoids."""
    all_ = index.select("path", "row_group", "n_bytes").distinct().agg(F.sum("n_bytes").alias("bytes_all"), F.count("*").alias("groups_all"))
    own = planned.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes_planned"), F.count("*").alias("groups_planned"))
    return own.crossJoin(all_).withColumn("bytes_avoided", F.col("bytes_all") - F.col("bytes_planned"))


def apportion(rows: DataFrame, keys: Sequence[str], weight: str, total: Column, order: str) -> DataFrame:
    """Adds ``share``: whole numbers in proportion to the weights that add up to ``total`` by largest remainder; ties by ``order``."""
    group = Window.partitionBy(*keys)
    all_ = F.sum(weight).over(group)
    exact = F.when(all_ > 0, total * F.col(weight) / all_).otherwise(0.0)
    out = rows.withColumns({"_exact": exact, "_total": F.when(all_ > 0, total).otherwise(0)})
    out = out.withColumn("_floor", F.floor("_exact"))
    out = out.withColumn("_left", F.col("_total") - F.sum("_floor").over(group))
    rank = F.row_number().over(group.orderBy((F.col("_exact") - F.col("_floor")).desc(), order))
    return out.withColumn("share", (F.col("_floor") + (rank <= F.col("_left")).cast("long")).cast("long")).drop("_exact", "_total", "_floor", "_left")


def samples_of(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1) of PCM16 WAV bytes (channels averaged) and their rate."""
    with wave.open(io.BytesIO(raw)) as f:
        data = np.frombuffer(f.readframes(f.getnframes()), dtype="<i2").reshape(-1, f.getnchannels())
        return data.mean(1) / 32768, f.getframerate()


def resample(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Polyphase resampling by the reduced ratio of the rates, with a Kaiser-windowed low-pass (beta 5, ten zero crossings a side)."""
    if rate == target or not len(samples):
        return samples
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    half = 10 * max(up, down)
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(samples) * up // down)
    centre = np.arange(n) * down + half  # in the sequence of rate * up, where the filter is centred
    phase, newest = centre % up, centre // up
    out = np.zeros(n)
    for k in range(-(-len(taps) // up)):  # taps that meet a sample, for all outputs at once
        tap, sample = phase + k * up, newest - k
        ok = (tap < len(taps)) & (sample >= 0) & (sample < len(samples))
        out[ok] += taps[tap[ok]] * samples[sample[ok]]
    return out


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def required_keys(windows: DataFrame, segments: str = "segments", key: str = "file_path") -> DataFrame:
    """Each key that some window needs, once."""
    return windows.select(F.explode(segments).alias(key)).distinct()


def materialize_windows(windows: DataFrame, segments: DataFrame, key: str = "file_path", blob: str = "audio") -> DataFrame:
    """window_id, status, wav (PCM16 at ``RATE``), n_samples and sha256 of each window: its segments decoded, resampled, joined in order.

    ``windows`` has window_id and segments (array of keys); a window is bounded by its duration.
    """
    import pandas as pd

    wanted = windows.select("window_id", F.posexplode("segments").alias("at", key))
    rows = wanted.join(segments.select(key, blob), key, "left").select("window_id", "at", blob)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        status, wav, n = OK, None, 0
        if group[blob].isna().any():
            status = MISSING
        else:
            try:
                parts = [resample(*samples_of(bytes(b))) for b in group[blob]]
                joined = np.concatenate(parts)
                wav, n = wav_bytes(joined), len(joined)
            except (wave.Error, EOFError, ValueError):
                status = UNDECODABLE
        return pd.DataFrame([(group["window_id"].iloc[0], status, wav, n)], columns=["window_id", "status", "wav", "n_samples"])

    made = rows.groupBy("window_id").applyInPandas(one, "window_id string, status string, wav binary, n_samples long")
    return made.withColumn("sha256", F.when(F.col("wav").isNotNull(), F.sha2("wav", 256)))


def manifest(results: DataFrame, windows: DataFrame) -> DataFrame:
    """A row a window for the CSV sink: identity, status, samples, seconds, hash, and its segments joined by ``;``."""
    out = windows.join(results.drop("wav"), "window_id", "left")
    return out.select("window_id", F.array_join("segments", ";").alias("segment_file_paths"), F.coalesce("status", F.lit(MISSING)).alias("status"), "n_samples", (F.col("n_samples") / RATE).alias("decoded_s"), "sha256").orderBy("window_id")
