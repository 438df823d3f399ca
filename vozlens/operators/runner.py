"""Evaluation tasks: item x condition x model, cached by content hash, answered, parsed and tallied."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import LABELS, parse_label
from ..functions.hashing import deterministic_choice, permutation, stable_hash
from ..functions.statistics import ratio
from .items import ACCEPTED, KEPT, answer_prompt
from .ledger import tagged

# Roles by condition, prefixes of errors, the prompt version.
ROLES = {"asr": "text_qa", "reference": "text_qa", "audio": "audio_qa"}
NO_INPUT, ASR_FAILED, PROMPT_VERSION = "insumo_ausente", "asr_falhou", "runner-default-v1"


def eligible(items: DataFrame) -> DataFrame:
    """Adds drop_reason: the filter's before the review's."""
    return tagged(items, [(~F.col("filter_status").eqNullSafe(F.lit(KEPT)), F.concat(F.lit("filtro:"), F.coalesce("filter_status", F.lit("null")))), (~F.col("review_status").eqNullSafe(F.lit(ACCEPTED)), F.concat(F.lit("revisao:"), F.coalesce("review_status", F.lit("null"))))])


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return cache.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def fingerprint(provider: Column, model_id: Column, version: Column, role: Column, params: Column) -> Column:
    return stable_hash(provider=provider, model_id=model_id, version=version, role=role, params=params)


def shown(alternatives: Column, order: Column) -> Column:
    """The alternatives in the order shown, lettered anew."""
    letters = F.array(*[F.lit(x) for x in LABELS])
    return F.transform(order, lambda source, i: F.struct(F.get(letters, i).alias("label"), F.get(alternatives, source)["text"].alias("text"), F.get(alternatives, source)["is_correct"].alias("is_correct")))


def tasks(items: DataFrame, conditions: Sequence[str], models: DataFrame, inputs: DataFrame, seed: int, n: int = 4, shuffle: bool = True, prompt_builder: Callable[..., Column] = answer_prompt) -> DataFrame:
    """A row for each item, condition and model of the condition's role, with prompt, order shown and cache key.

    ``models`` has model_key and role; ``inputs`` has window_id, condition, content and, for
    ``asr``, asr_hash, and may have input_error, why there is no content. A missing input makes
    an error row, never a call. The conditions and models are lists from configuration, so the
    product is bounded by the items. ``prompt_builder`` gets question, alternatives as shown,
    transcript and whether there is audio.
    """
    spark = items.sparkSession
    kinds = spark.createDataFrame([(i, c, ROLES[c]) for i, c in enumerate(conditions)], "condition_order int, condition string, role string")
    cells = F.broadcast(kinds.join(models, "role"))
    why = F.col("input_error") if "input_error" in inputs.columns else F.lit(None).cast("string").alias("input_error")
    rows = items.crossJoin(cells).join(inputs.select("window_id", "condition", "content", "asr_hash", why), ["window_id", "condition"], "left")
    rows = rows.withColumn("permutation", permutation(F.col("item_id"), F.col("model_key"), seed, n, shuffle))
    rows = rows.withColumn("shown", shown(F.col("alternatives"), F.col("permutation")))
    right = F.filter("shown", lambda a: a["is_correct"])
    audio = F.col("condition") == "audio"
    prompt = prompt_builder(F.col("question"), F.col("shown"), F.when(~audio, F.col("content")), audio & F.col("content").isNotNull())
    key = stable_hash(item_id=F.col("item_id"), model=F.col("model_key"), condition=F.col("condition"), prompt_version=F.lit(PROMPT_VERSION), permutation=F.col("permutation"), extra=F.struct(F.col("asr_hash").alias("hypothesis")))
    return rows.withColumns({"correct_label": F.get(right, F.lit(0))["label"], "prompt": F.when(F.col("content").isNotNull(), prompt), "cache_key": key, "error": F.when(F.col("content").isNull(), F.coalesce("input_error", F.concat(F.lit(NO_INPUT + ": "), "condition")))}).drop("role", "shown", "input_error")


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is cached, with the cached record; rows still to be answered)."""
    return rows.join(cache, key), rows.join(cache, key, "left_anti")


def fake_answer(prompt: Column, seed: int = 0, n: int = 4) -> Column:
    """A deterministic stand-in for a model: a letter by hash."""
    return F.get(F.array(*[F.lit(x) for x in LABELS]), deterministic_choice(prompt, seed, n))


def with_retry(call: Callable[[str], str], retries: int, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again after 0.5, 1, 2, … seconds, or as long as the error's ``retry_after`` says, 60 at most; the last error is raised."""

    def run(x: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(x)
            except Exception as e:
                if attempt == retries:
                    raise
                asked = getattr(e, "retry_after", None)
                sleep(min(0.5 * 2**attempt if asked is None else max(float(asked), 0.0), 60.0))
        raise AssertionError

    return run


def answered(pending: DataFrame, client: Callable[[], Callable[[str], str]], retries: int = 6) -> DataFrame:
    """Adds raw_text and error: one client a partition answers its prompts; a failed call is an error row, never a guess."""
    fields = [f for f in pending.schema.fields if f.name not in ("raw_text", "error")]
    names = [f.name for f in fields]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client(), retries)
        for frame in frames:
            texts, errors = [], []
            for prompt, error in zip(frame["prompt"], frame["error"], strict=True):
                text = None
                if error is None:
                    try:
                        text = call(prompt)
                    except Exception as e:  # what a provider raises isn't known here; it becomes data
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield frame[names].assign(raw_text=texts, error=errors)

    return pending.mapInPandas(run, schema)


def scored(records: DataFrame, labels: Sequence[str] = LABELS[:4]) -> DataFrame:
    """Adds parsed and is_correct: null where the answer can't be read or the call failed, never false."""
    p = parse_label(F.when(F.col("error").isNull(), F.coalesce("raw_text", F.lit(""))), labels)
    out = records.withColumn("parse", F.when(F.col("error").isNull(), p))
    return out.withColumns({"parsed_label": F.col("parse.label"), "is_correct": F.col("parse.label") == F.col("correct_label")})


def cell_stats(records: DataFrame) -> DataFrame:
    """Per model and condition: answers, errors, unread, correct, and rates; errors aren't in the unread rate's base."""
    unread = F.col("error").isNull() & F.col("parsed_label").isNull()
    out = records.groupBy("model_key", "condition").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.count_if(unread).alias("n_unparsed"), F.count_if("is_correct").alias("n_correct"))
    base = F.col("n") - F.col("n_errors")
    return out.withColumns({"unparsed_rate": ratio(F.col("n_unparsed"), base), "accuracy": ratio(F.col("n_correct"), base - F.col("n_unparsed"))})


def errors_by_prefix(records: DataFrame) -> DataFrame:
    return records.where("error is not null").groupBy(F.split("error", ":")[0].alias("kind")).agg(F.count("*").alias("n"))


def to_cache(records: DataFrame) -> DataFrame:
    """What may be cached: answers; errors are asked again."""
    return records.where("error is null").select("cache_key", "item_id", "model_key", "condition", "raw_text")
