"""Speech recognition before answering, the providers of models, and the order in which answers are emitted.

Every window is transcribed once and cached under a key of its id and the recogniser's
fingerprint; the hash of the transcript goes into the key of each answer that is given
over it, so another recogniser never meets answers to this one's transcripts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from .runner import ASR_FAILED, NO_INPUT, answered, fingerprint

# The stand-in's provider, and the roles that providers are made for.
FAKE = "fake"
MODEL_ROLES = ("asr", "text_qa", "audio_qa")


@dataclass(frozen=True)
class Spec:
    """A model by configuration."""

    key: str
    role: str
    provider: str
    model_id: str
    version: str = ""
    params: str = "{}"

    def mark(self) -> Column:
        """The fingerprint of what may change its answers."""
        return fingerprint(*[F.lit(x) for x in (self.provider, self.model_id, self.version, self.role, self.params)])


def forced(spec: Spec, fake: bool = True) -> Spec:
    """The spec under the stand-in's provider, so that its answers never share a key with a real model's."""
    return replace(spec, provider=FAKE) if fake else spec


def clients(specs: list[Spec], factories: dict[tuple[str, str], Callable[[Spec], Callable[[str], str]]], fake: bool = False) -> dict[str, Callable[[], Callable[[str], str]]]:
    """For each model key what makes its client, by (provider, role); an unknown provider or role is an error before anything runs."""
    out = {}
    for spec in (forced(s, fake) for s in specs):
        if spec.role not in MODEL_ROLES:
            raise ValueError(f"{spec.key}: unknown role {spec.role!r}")
        make = factories.get((spec.provider, spec.role))
        if make is None:
            raise ValueError(f"{spec.key}: no factory for {spec.provider!r} as {spec.role}")
        if spec.key in out:
            raise ValueError(f"{spec.key}: named twice")
        out[spec.key] = lambda make=make, spec=spec: make(spec)
    return out


def fake_transcript(audio: Column, seed: int = 0) -> Column:
    """A deterministic stand-in for a recogniser."""
    return F.concat(F.lit("transcrição "), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), audio), 256), 1, 12))


def asr_tasks(windows: DataFrame, spec: Spec) -> DataFrame:
    """(window_id, audio, key, asr_model_key, asr_fingerprint, error), each window once."""
    own = windows.select("window_id", "audio").dropDuplicates(["window_id"])
    key = stable_hash(asr=spec.mark(), window_id=F.col("window_id").cast("string"))
    missing = F.when(F.col("audio").isNull(), F.concat(F.lit(f"{NO_INPUT}: window_id="), F.col("window_id").cast("string")))
    return own.select("window_id", "audio", key.alias("key"), F.lit(spec.key).alias("asr_model_key"), spec.mark().alias("asr_fingerprint"), missing.alias("error"))


def resolve(windows: DataFrame, spec: Spec, cache: DataFrame, transcribe: Column | Callable[[], Callable[[str], str]], retries: int = 6) -> DataFrame:
    """(window_id, key, text, error, cached) of every window: from the cache (key, text), else transcribed.

    ``transcribe`` is an expression over ``audio`` or makes a client a partition.
    """
    tasks = asr_tasks(windows, spec)
    known = cache.groupBy("key").agg(F.first("text").alias("text"))
    hits = tasks.join(known, "key").select("window_id", "key", "text", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    pending = tasks.join(known, "key", "left_anti")
    if isinstance(transcribe, Column):
        made = pending.withColumn("raw_text", F.when(F.col("error").isNull(), transcribe))
    else:
        made = answered(pending.withColumnRenamed("audio", "prompt"), transcribe, retries)
    failed = F.when(F.col("error").startswith(NO_INPUT), F.col("error")).when(F.col("error").isNotNull(), F.concat(F.lit(f"{ASR_FAILED}: "), "error"))
    return hits.unionByName(made.select("window_id", "key", F.col("raw_text").alias("text"), failed.alias("error"), F.lit(False).alias("cached")))


def to_asr_cache(hypotheses: DataFrame, spec: Spec) -> DataFrame:
    """New transcripts for the cache; failures are asked again."""
    return hypotheses.where("error is null and not cached").select("key", "window_id", F.lit(spec.key).alias("asr_model_key"), spec.mark().alias("asr_fingerprint"), "text")


def as_inputs(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses as inputs of the ``asr`` condition: content, its hash for the answers' keys, and why there is none."""
    return hypotheses.select("window_id", F.lit("asr").alias("condition"), F.col("text").alias("content"), F.sha2("text", 256).alias("asr_hash"), F.col("error").alias("input_error"))


def in_order(records: DataFrame) -> DataFrame:
    """Records as they are to be emitted, whatever the order they were answered in: by item, condition and model.

    ``ordinal`` is a task's place among its item's; the sort is by ranges, so a sink's files follow each other.
    """
    order = Window.partitionBy("item_id").orderBy("condition_order", "model_key")
    return records.withColumn("ordinal", F.row_number().over(order) - 1).orderBy("item_id", "ordinal")
