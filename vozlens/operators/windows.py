"""Turn- and gap-aware sessions of segments, greedy packing into windows, stratified choice.

Two exchanges: by recording (turns) and by speaker (runs, packing, choice).  A run's
candidate positions are folded in one array; runs are short, and only positions from
which a window is possible are in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import speaker_generator
from .ledger import tagged

# Reasons of breaks and of exclusions.
BREAK_RECORDING, BREAK_TURN, BREAK_GAP = "troca_de_gravacao", "turno_de_entrevistador", "lacuna_temporal"
OUT_REGION, OUT_AGE = "regiao_fora_do_escopo", "idade_fora_da_faixa"
NO_CANDIDATE, NOT_DRAWN, BELOW_TARGET = "sem_janela_candidata", "candidata_nao_sorteada", "abaixo_da_meta_com_allow_fewer_windows_false"


@dataclass(frozen=True)
class Columns:
    """Names of the segment columns."""

    speaker: str = "speaker_code"
    recording: str = "audio_name"
    key: str = "file_path"
    start: str = "start_time"
    end: str = "end_time"
    duration: str = "duration"
    text: str = "normalized_text"


def mark_turns(segments: DataFrame, is_informant: Column, c: Columns = Columns()) -> DataFrame:
    """Informant rows with the turns and seconds of others since the recording's informant row before.

    Turns before the first informant row are its own.  Must see the full frame.
    """
    order = Window.partitionBy(c.recording).orderBy(c.start, c.key)
    inf = F.coalesce(is_informant, F.lit(False))
    ranked = segments.withColumn("_inf", inf).withColumn("_slot", F.sum(F.col("_inf").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inf").cast("long"))
    # the rows of one slot are the others' rows and then the one informant row that ends it
    slot = Window.partitionBy(c.recording, "_slot")
    other = ~F.col("_inf")
    seconds = F.sum(F.when(other, F.col(c.duration).cast("double"))).over(slot)
    marked = ranked.withColumns({"seconds_before": F.coalesce(seconds, F.lit(0.0)), "turns_before": F.sum(other.cast("long")).over(slot)})
    return marked.where("_inf").drop("_inf", "_slot")


def scope(rows: DataFrame, region: str, age: str, regions: Sequence[str], low: int, high: int) -> DataFrame:
    """Adds drop_reason: region first, then the closed age range."""
    return tagged(rows, [(~F.coalesce(F.col(region).isin(list(regions)), F.lit(False)), OUT_REGION), (~F.coalesce(F.col(age).between(low, high), F.lit(False)), OUT_AGE)])


def assign_runs(informants: DataFrame, gap_s: float = 2.0, close_on_turn: bool = True, c: Columns = Columns()) -> DataFrame:
    """Adds break_reason (null inside a run, ``first`` at a speaker's first row), observed_turn and run (from 0 by speaker)."""
    order = Window.partitionBy(c.speaker).orderBy(c.recording, c.start, c.key)
    out = informants.withColumns({"_end": F.lag(F.col(c.end).cast("double")).over(order), "_rec": F.lag(c.recording).over(order), "_n": F.row_number().over(order)})
    first, moved = F.col("_n") == 1, F.col("_rec") != F.col(c.recording)
    between = (F.col("turns_before") > 0) & ~first & ~moved
    gap = F.col(c.start).cast("double") - F.col("_end") - F.col("seconds_before")
    reason = F.when(first, "first").when(moved, BREAK_RECORDING)
    if close_on_turn:
        reason = reason.when(between, BREAK_TURN)
    out = out.withColumns({"break_reason": reason.when(gap > gap_s, BREAK_GAP), "observed_turn": between})
    run = F.sum(F.col("break_reason").isNotNull().cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.withColumn("run", run).drop("_end", "_rec", "_n")


def break_tally(runs: DataFrame) -> DataFrame:
    """Breaks by reason, runs, speakers and observed turns; runs = speakers + breaks."""
    return runs.agg(
        *[F.count_if(F.col("break_reason") == r).alias(n) for r, n in ((BREAK_RECORDING, "n_recording"), (BREAK_TURN, "n_turn"), (BREAK_GAP, "n_gap"), ("first", "n_speakers"))],
        F.count("break_reason").alias("n_runs"),
        F.count_if("observed_turn").alias("n_observed_turns"),
    )


def pack_runs(runs: DataFrame, least: int = 8, most: int = 15, low: float = 30.0, high: float = 60.0, c: Columns = Columns()) -> DataFrame:
    """(speaker, run, pos, length): disjoint windows, greedily from the left.

    From a position the smallest length whose sum reaches ``low``, if it is at most
    ``high``; a window ends where it ends, a position without one is passed over.
    """
    order = Window.partitionBy(c.speaker, "run").orderBy(c.recording, c.start, c.key)
    rows = runs.select(c.speaker, "run", c.recording, c.start, c.key, (F.row_number().over(order) - 1).alias("pos"), F.col(c.duration).cast("double").alias("d"))
    rows = rows.withColumns({f"d{k}": F.lead("d", k).over(order) for k in range(1, most)})
    # each window's own durations are added, from the left: differences of running sums miss the bounds by their rounding
    sums = list(accumulate([F.col("d"), *[F.col(f"d{k}") for k in range(1, most)]], add))
    totals = F.array(*sums[least - 1 :])
    # the sums ascend: the first that reaches low decides
    first = F.array_position(F.transform(totals, lambda t: F.coalesce(t >= low, F.lit(False))), True)
    length = F.when((first > 0) & (F.element_at(totals, F.greatest(first, F.lit(1)).cast("int")) <= high), first + (least - 1))
    cells = rows.select(c.speaker, "run", "pos", length.cast("int").alias("length")).where("length is not null")
    packed = cells.groupBy(c.speaker, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("cells"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<pos: int, length: int>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.struct((x["pos"] + x["length"]).alias("next"), F.array_append(acc["taken"], x).alias("taken"))
        return F.when(x["pos"] >= acc["next"], grown).otherwise(acc)

    return packed.select(c.speaker, "run", F.explode(F.aggregate("cells", start, step)["taken"]).alias("w")).select(c.speaker, "run", "w.pos", "w.length")


def choose(candidates: DataFrame, target: int, seed: int, c: Columns = Columns(), numpy_draws: bool = False) -> DataFrame:
    """Adds n_candidates, block and drawn: one candidate of each of ``target`` blocks of a speaker's, in temporal order.

    A speaker with at most ``target`` keeps all.  Within a block the smallest SHA-256
    of (seed, speaker, ordinal) is drawn; with ``numpy_draws`` a PCG64 generator a speaker draws.
    """
    order = Window.partitionBy(c.speaker).orderBy("run", "pos")
    out = candidates.withColumns({"ordinal": F.row_number().over(order) - 1, "n_candidates": F.count("*").over(Window.partitionBy(c.speaker)), "_block": F.ntile(target).over(order) - 1})
    out = out.withColumn("block", F.when(F.col("n_candidates") <= target, F.col("ordinal")).otherwise(F.col("_block")))
    if numpy_draws:

        @F.pandas_udf("array<int>")
        def positions(speaker: pd.Series, n: pd.Series) -> pd.Series:
            def one(who: str, size: int) -> list[int]:
                if size <= target:
                    return list(range(size))
                generator = speaker_generator(seed, who)
                return [int(b[int(generator.integers(0, len(b)))]) for b in np.array_split(np.arange(size), target)]

            return pd.Series([one(w, s) for w, s in zip(speaker, n, strict=True)])

        drawn = F.array_contains(positions(F.col(c.speaker).cast("string"), F.col("n_candidates")), F.col("ordinal"))
    else:
        key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(c.speaker).cast("string"), F.col("ordinal").cast("string")), 256)
        drawn = F.row_number().over(Window.partitionBy(c.speaker, "block").orderBy(key)) == 1
    return out.withColumn("drawn", drawn).drop("_block")


def build(runs: DataFrame, chosen: DataFrame, target: int, allow_fewer: bool = True, c: Columns = Columns()) -> DataFrame:
    """The windows: id, segments in order, times, duration and joined text; numbered from 1 by speaker."""
    picked = chosen.where("drawn")
    if not allow_fewer:
        picked = picked.where(F.col("n_candidates") >= target)
    order = Window.partitionBy(c.speaker).orderBy("ordinal")
    picked = picked.withColumn("number", F.row_number().over(order))
    place = Window.partitionBy(c.speaker, "run").orderBy(c.recording, c.start, c.key)
    rows = runs.withColumn("at", F.row_number().over(place) - 1).alias("r")
    w = picked.alias("w")
    inside = rows.join(w, (F.col(f"r.{c.speaker}") == F.col(f"w.{c.speaker}")) & (F.col("r.run") == F.col("w.run")) & (F.col("r.at") >= F.col("w.pos")) & (F.col("r.at") < F.col("w.pos") + F.col("w.length")))
    trimmed = F.trim(F.coalesce(F.col(f"r.{c.text}"), F.lit("")))
    part = F.struct(F.col("r.at").alias("at"), F.col(f"r.{c.key}").alias("key"), F.col(f"r.{c.start}").cast("double").alias("start"), F.col(f"r.{c.end}").cast("double").alias("end"), F.col(f"r.{c.duration}").cast("double").alias("d"), trimmed.alias("text"))
    made = inside.groupBy(F.col(f"r.{c.speaker}").alias(c.speaker), "w.number", "w.block", "w.n_candidates").agg(F.array_sort(F.collect_list(part)).alias("s"), F.min_by(f"r.{c.recording}", "r.at").alias(c.recording))
    texts = F.array_join(F.filter(F.transform("s", lambda x: x["text"]), lambda t: t != ""), " ")
    out = made.select(
        F.format_string("%s__w%02d", F.col(c.speaker).cast("string"), F.col("number")).alias("window_id"),
        c.speaker,
        c.recording,
        F.transform("s", lambda x: x["key"]).alias("segments"),
        F.col("s")[0]["start"].alias("start_time"),
        F.element_at("s", -1)["end"].alias("end_time"),
        F.round(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["d"]), 6).alias("duration_s"),
        F.size("s").cast("long").alias("n_segments"),
        texts.alias("reference_text"),
        F.col("block").cast("long").alias("position_index"),
        F.col("n_candidates").cast("long").alias("n_candidates"),
    )
    sha = F.sha2(F.to_json(F.struct("reference_text", F.transform("segments", lambda x: x.cast("string")).alias("segments"))), 256)
    return out.withColumn("content_sha", F.substring(sha, 1, 12))


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """How many rows have each value."""
    return counts.groupBy(column).agg(F.count("*").alias("n"))
