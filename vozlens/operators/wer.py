"""Word errors: edits, pooled and macro rates, by group; raw counts are kept, so partial results merge."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import ratio
from ..functions.text import VERSION, check_version, normalize_py
from .ledger import tagged

# Reasons, and the region of speakers that the table lacks.
NO_REFERENCE, EMPTY_REFERENCE, UNKNOWN_REGION = "janela sem transcrição de referência", "referência vazia após normalização", "desconhecida"


def edits_py(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions) of one cheapest alignment; ties prefer a deletion, then an insertion, to a substitution."""
    n, m = len(reference), len(hypothesis)
    codes = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    r, h = np.array([codes[w] for w in reference], int), np.array([codes[w] for w in hypothesis], int)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[0] = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.concatenate([[i], np.minimum(cost[i - 1, :-1] + (h != r[i - 1]), cost[i - 1, 1:] + 1)])
        cost[i] = np.minimum.accumulate(row - steps) + steps  # insertions run along the row
    i, j, s, ins, d = n, m, 0, 0, 0
    while i or j:
        if i and j and r[i - 1] == h[j - 1]:
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            d, i = d + 1, i - 1
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            s, i, j = s + 1, i - 1, j - 1
    return s, ins, d


def count_edits(reference: Column, hypothesis: Column, version: str = VERSION, normalise: bool = True) -> Column:
    """struct<substitutions, insertions, deletions, n_reference_words> after normalising both sides; null for an empty reference."""
    check_version(version)

    @F.pandas_udf("struct<substitutions: long, insertions: long, deletions: long, n_reference_words: long>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = ((normalize_py(t or "") if normalise else t or "").split() for t in (x, y))
            out.append((*edits_py(x, y), len(x)) if x else (None,) * 4)
        return pd.DataFrame(out, columns=["substitutions", "insertions", "deletions", "n_reference_words"]).astype("Int64")

    return run(reference, hypothesis)


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """All edits of two texts whose words are parted by single spaces, without Python: words become letters for ``levenshtein``."""
    a, b = (F.filter(F.split(t, " "), lambda w: w != "") for t in (reference, hypothesis))
    words = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("all"))

    def coded(side: Column, vocabulary: Column) -> Column:
        return F.array_join(F.transform(side, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 19967), 4, "0")), "UTF-16BE")), "")

    # through an array of one struct, so that the words and the vocabulary are made once a row
    return F.transform(F.array(words), lambda s: F.levenshtein(coded(s["a"], s["all"]), coded(s["b"], s["all"])).cast("long"))[0]


def records(hypotheses: DataFrame, references: DataFrame, key: str = "window_id", text: str = "reference_text", speaker: str = "speaker_code", version: str = VERSION) -> DataFrame:
    """A row a hypothesis with its counts, and drop_reason where its reference is missing or empty."""
    ref = references.select(key, F.col(text).alias("_ref"), speaker)
    both = hypotheses.join(ref, key, "left").withColumn("e", count_edits(F.col("_ref"), F.col("text"), version))
    both = tagged(both, [(F.col("_ref").isNull(), NO_REFERENCE), (F.col("e.n_reference_words").isNull(), EMPTY_REFERENCE)])
    return both.select(key, speaker, *[c for c in hypotheses.columns if c not in (key, speaker, "text")], "e.*", F.lit(version).alias("normalizer_version"), "drop_reason")


def rates(counts: DataFrame, keys: Sequence[str], speaker: str = "speaker_code") -> DataFrame:
    """Pooled and macro word-error rates by group; null keys are a group."""
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    out = counts.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        F.count_distinct(speaker).alias("n_speakers"),
        *[F.sum(c).alias(c) for c in ("substitutions", "insertions", "deletions")],
        F.sum(errors).alias("errors"),
        F.sum("n_reference_words").alias("n_reference_words"),
        F.avg(ratio(errors, F.col("n_reference_words"))).alias("wer_macro"),
    )
    return out.withColumn("wer_pooled", ratio(F.col("errors"), F.col("n_reference_words"))).select(*keys, "n_windows", "n_speakers", "substitutions", "insertions", "deletions", "errors", "n_reference_words", "wer_pooled", "wer_macro")


def with_region(rows: DataFrame, speakers: DataFrame, speaker: str = "speaker_code", region: str = "region") -> DataFrame:
    """Adds the speaker's region; never drops a row."""
    return rows.join(speakers.select(speaker, region).dropDuplicates([speaker]), speaker, "left").withColumn(region, F.coalesce(region, F.lit(UNKNOWN_REGION)))
