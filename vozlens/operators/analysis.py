"""Adjusted accuracy gaps: trials, speaker bootstrap, logit with g-computation, decomposition, sensitivity.

Trials are summed by speaker within each cell before anything is resampled, so the
bootstrap works on (cell, speaker) rows, whatever the number of trials.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash_py
from ..functions.statistics import expit
from .ledger import tagged

# Reasons, exposed and baseline region, modes of a ceiling.
UNREADABLE, NO_SPEAKER = "resposta não interpretável (parsed_label ausente)", "falante ausente da tabela de falantes"
EXPOSED, BASELINE = "NE", "SE"
CEILING_MODES = ("constructed", "human_sample")
CELL = ("model_key", "condition")


def trials(records: DataFrame, speakers: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Records with region, age and gender of their speaker, and drop_reason: unread, no speaker, region out of scope."""
    who = speakers.select("speaker_code", "region", "age", "speaker_gender", *extra).dropDuplicates(["speaker_code"]).withColumn("_there", F.lit(True))
    # merged: a plan reads the trials several times, and the driver can't hold a broadcast of all speakers for each
    both = records.join(who.hint("merge"), "speaker_code", "left")
    reasons = [(F.col("is_correct").isNull(), UNREADABLE), (F.col("_there").isNull(), NO_SPEAKER), (~F.coalesce(F.col("region").isin(EXPOSED, BASELINE), F.lit(False)), F.concat(F.lit("região fora de escopo ("), F.coalesce("region", F.lit("null")), F.lit(")")))]
    return tagged(both, reasons).drop("_there")


def restrict_age(rows: DataFrame, low: int, high: int, age: str = "age") -> DataFrame:
    return tagged(rows, [(F.col(age) < low, f"idade < {low}"), (F.col(age) > high, f"idade > {high}")])


def resamples(speakers: DataFrame, n: int, seed: int, stratum: str = "region") -> DataFrame:
    """(b, speaker_code, weight): n draws with replacement within each stratum, by one PCG64 generator in order of strata.

    Drawn on the driver over the speakers (n x speakers small integers; people, not rows).
    """
    table = speakers.select("speaker_code", stratum).distinct().toPandas().sort_values("speaker_code")
    if table["speaker_code"].duplicated().any():
        raise ValueError("a speaker has more than one stratum")
    codes = table["speaker_code"].to_numpy()
    generator, parts = np.random.default_rng(seed), []
    for name in sorted(table[stratum].unique()):
        pool = np.flatnonzero((table[stratum] == name).to_numpy())
        picks = pool[generator.integers(0, len(pool), size=(n, len(pool)))]
        key, weight = np.unique(picks + np.arange(n)[:, None] * len(codes), return_counts=True)
        parts.append(pd.DataFrame({"b": key // len(codes), "speaker_code": codes[key % len(codes)], "weight": weight}))
    return speakers.sparkSession.createDataFrame(pd.concat(parts))


def stratum_conflicts(speakers: DataFrame, stratum: str = "region") -> DataFrame:
    """(speaker_code, n_strata) of speakers with more than one stratum; a bootstrap by strata needs none."""
    found = speakers.groupBy("speaker_code").agg(F.count_distinct(stratum).alias("n_strata"))
    return found.where("n_strata > 1")


def hashed_resamples(speakers: DataFrame, n: int, seed: int, stratum: str = "region") -> DataFrame:
    """The same by hashes, without the driver: draw s of stratum of size m is SHA-256 of (seed, b, stratum, s) modulo m.

    A speaker of more than one stratum raises where the draws are computed.
    """
    order = Window.partitionBy(stratum).orderBy("speaker_code")
    own = speakers.groupBy("speaker_code").agg(F.min(stratum).alias(stratum), (F.count_distinct(stratum) + F.max(F.col(stratum).isNull().cast("int"))).alias("n"))
    twice = F.raise_error(F.concat(F.lit("more than one stratum: "), F.col("speaker_code").cast("string"))).cast(speakers.schema[stratum].dataType)
    one = own.select("speaker_code", F.when(F.col("n") > 1, twice).otherwise(F.col(stratum)).alias(stratum))
    ranked = one.withColumns({"r": F.row_number().over(order) - 1, "m": F.count("*").over(Window.partitionBy(stratum))})
    draws = ranked.select(stratum, F.col("r").alias("s"), "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), stratum, F.col("s").cast("string")), 256), 1, 8), 16, 10).cast("long"), F.col("m"))
    counted = draws.groupBy("b", stratum, pick.alias("r")).agg(F.count("*").alias("weight"))
    return counted.join(ranked.select(stratum, F.col("r").cast("long").alias("r"), "speaker_code"), [stratum, "r"]).select("b", "speaker_code", stratum, "weight")


def by_speaker(rows: DataFrame, keys: Sequence[str] = CELL, attributes: Sequence[str] = ("region", "age", "speaker_gender")) -> DataFrame:
    """Correct answers and trials of each speaker in each cell."""
    return rows.groupBy(*keys, "speaker_code", *attributes).agg(F.sum(F.col("is_correct").cast("long")).alias("n_correct"), F.count("*").alias("n_trials"))


def bootstrap_means(sums: DataFrame, draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy of each cell in each draw: weighted sums over the draw's speakers."""
    both = sums.join(draws.select("b", "speaker_code", "weight"), "speaker_code")
    out = both.groupBy(*keys, "b").agg(F.sum(F.col("n_correct") * F.col("weight")).alias("k"), F.sum(F.col("n_trials") * F.col("weight")).alias("n"))
    return out.select(*keys, "b", (F.col("k") / F.col("n")).alias("accuracy"))


def interval(values: Column, level: float = 0.95) -> list[Column]:
    """Percentile bounds, linearly interpolated."""
    a = (1 - level) / 2
    return [F.percentile(values, F.lit(a)).alias("ci_low"), F.percentile(values, F.lit(1 - a)).alias("ci_high")]


def fit_logit(x: np.ndarray, k: np.ndarray, n: np.ndarray, steps: int = 100) -> np.ndarray | None:
    """Binomial logit over rows of k successes in n, by Newton steps, else by a quasi-Newton search; None without rows, variance, rank or convergence."""
    there = n > 0
    x, k, n = x[there], k[there], n[there]
    if not len(x) or k.sum() == 0 or k.sum() == n.sum() or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    beta = _newton(x, k[:, None], n[:, None], steps)[0]
    if np.isfinite(beta).all():
        return beta
    return _quasi_newton(x, k, n)


def _newton(x: np.ndarray, k: np.ndarray, n: np.ndarray, steps: int = 100) -> np.ndarray:
    """Logits of many samples at once: k and n have a column a sample; a row of NaN where the steps don't converge."""
    p, m = x.shape[1], k.shape[1]
    beta, done, lost = np.zeros((m, p)), np.zeros(m, bool), np.zeros(m, bool)
    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)
    for _ in range(steps):
        some = np.flatnonzero(~done & ~lost)
        if not len(some):
            break
        mean = expit(x @ beta[some].T)
        weight = n[:, some] * mean * (1 - mean)
        hessian = (outer.T @ weight).T.reshape(-1, p, p)
        bad = ~(np.linalg.cond(hessian) < 1e14)
        hessian[bad] = np.eye(p)
        move = np.linalg.solve(hessian, (x.T @ (k[:, some] - n[:, some] * mean)).T[:, :, None])[:, :, 0]
        beta[some] += move
        bad |= ~np.isfinite(beta[some]).all(1) | (np.abs(beta[some]).max(1) > 50)
        lost[some[bad]] = True
        done[some[~bad & (np.abs(move).max(1) < 1e-9)]] = True
    beta[~done] = np.nan
    return beta


def _quasi_newton(x: np.ndarray, k: np.ndarray, n: np.ndarray, steps: int = 500) -> np.ndarray | None:
    """The same fit by BFGS with halved steps, over centred and scaled columns; None if the gradient doesn't vanish."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = x / scale
    beta, inverse = np.zeros(z.shape[1]), np.eye(z.shape[1]) / max(n.sum(), 1)

    def loss(b: np.ndarray) -> float:
        eta = z @ b
        return float((n * np.logaddexp(0, eta) - k * eta).sum())

    slope = z.T @ (n * expit(z @ beta) - k)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-7 * max(n.sum(), 1):
            mean = expit(z @ beta)
            sound = np.abs(beta / scale).max() <= 50 and (n * mean * (1 - mean)).max() > 1e-3  # else the classes are parted
            return beta / scale if sound else None
        way, t, at = -inverse @ slope, 1.0, loss(beta)
        while loss(beta + t * way) > at + 1e-4 * t * (slope @ way) and t > 1e-12:
            t /= 2
        after = z.T @ (n * expit(z @ (beta + t * way)) - k)
        s, y = t * way, after - slope
        beta, slope = beta + s, after
        if (sy := s @ y) > 1e-14:
            left = np.eye(len(s)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    return None


def design(frame: pd.DataFrame, covariates: Sequence[str]) -> np.ndarray:
    """Constant, exposed region, numbers as they are, categories as indicators against the least level."""
    columns = [np.ones(len(frame)), (frame["region"] == EXPOSED).to_numpy(float)]
    for c in covariates:
        if c == "region":
            continue
        if pd.api.types.is_numeric_dtype(frame[c]):
            columns.append(frame[c].to_numpy(float))
        else:
            columns += [(frame[c] == level).to_numpy(float) for level in sorted(frame[c].unique())[1:]]
    return np.column_stack(columns)


def marginal_effect(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> float | None:
    """Mean prediction with everyone exposed less that with no one, over the rows fitted."""
    beta = fit_logit(x, k, n)
    return None if beta is None else float(_effects(x, n[:, None], beta[None, :])[0])


def _effects(x: np.ndarray, n: np.ndarray, beta: np.ndarray) -> np.ndarray:
    one, zero = x.copy(), x.copy()
    one[:, 1], zero[:, 1] = 1, 0
    return ((expit(one @ beta.T) - expit(zero @ beta.T)) * n).sum(0) / n.sum(0)


def accuracy_gap(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> float | None:
    """A statistic without covariates: accuracy of the exposed less that of the others; None where a side has no trials."""
    side = x[:, 1] == 1
    top, low = n[side].sum(), n[~side].sum()
    return float(k[side].sum() / top - k[~side].sum() / low) if top and low else None


def marginal_effects(x: np.ndarray, k: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The effect under each column of weights, NaN where it can't be estimated; the fits run together."""
    kw, nw = k[:, None] * weights, n[:, None] * weights
    out = np.full(weights.shape[1], np.nan)
    there = (nw > 0).astype(float)
    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    ranks = np.linalg.matrix_rank((outer.T @ there).T.reshape(-1, x.shape[1], x.shape[1]), hermitian=True)
    sound = np.flatnonzero((kw.sum(0) > 0) & (kw.sum(0) < nw.sum(0)) & (ranks == x.shape[1]))
    if len(sound):
        beta = _newton(x, kw[:, sound], nw[:, sound])
        fitted = np.isfinite(beta).all(1)
        out[sound[fitted]] = _effects(x, nw[:, sound[fitted]], beta[fitted])
        for i in sound[~fitted]:
            effect = marginal_effect(x, kw[:, i], nw[:, i])
            out[i] = np.nan if effect is None else effect
    return out


def gap_table(rows: DataFrame, draws: DataFrame, keys: Sequence[str] = CELL, covariates: Sequence[str] = ("region", "age", "speaker_gender"), level: float = 0.95, max_failures: float = 0.05, blocks: int = 16, statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], float | None] | None = None) -> DataFrame:
    """Adjusted gap with interval, raw accuracies and counts of each cell; a cell that can't be estimated has a null gap.

    Each (cell, block of draws) is one task: a row a speaker of the cell, with an array of its
    weights in the block's draws. The point estimate is draw -1, with weight 1 for everyone.
    ``statistic`` takes the place of the marginal effect: of a design, successes and trials.
    """
    sums = by_speaker(rows, keys, [c for c in dict.fromkeys(["region", *covariates])])
    point = sums.select("speaker_code").distinct().select(F.lit(-1).cast("long").alias("b"), "speaker_code", F.lit(1).cast("long").alias("weight"))
    weights = draws.select(F.col("b").cast("long"), "speaker_code", F.col("weight").cast("long")).unionByName(point)
    blocked = weights.groupBy("speaker_code", F.pmod("b", F.lit(blocks)).alias("block")).agg(F.collect_list("b").alias("bs"), F.collect_list("weight").alias("ws"))  # a number a draw of the block
    # every speaker of the cell meets every block, so that all see the same draws
    numbers = draws.select(F.col("b").cast("long").alias("b")).unionByName(rows.sparkSession.createDataFrame([(-1,)], "b long")).distinct().groupBy(F.pmod("b", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("b")).alias("all"))
    both = sums.join(F.broadcast(numbers)).join(blocked, ["speaker_code", "block"], "left")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(people: pd.DataFrame) -> pd.DataFrame:
        people = people.sort_values("speaker_code").reset_index(drop=True)
        x = design(people, covariates)
        k, n = people["n_correct"].to_numpy(float), people["n_trials"].to_numpy(float)
        bs = np.array(people["all"].iloc[0])
        w = np.zeros((len(people), len(bs)))
        for i, (b, v) in enumerate(zip(people["bs"], people["ws"], strict=True)):
            if b is not None:
                w[i, np.searchsorted(bs, b)] = v
        if statistic is None:
            gaps = marginal_effects(x, k, n, w)
        else:
            gaps = np.array([np.nan if (g := statistic(x, k * w[:, i], n * w[:, i])) is None else g for i in range(len(bs))])
        found = [None if np.isnan(g) else float(g) for g in gaps]
        return pd.DataFrame([(*[people[c].iloc[0] for c in keys], int(b), g) for b, g in zip(bs, found, strict=True)], columns=[*keys, "b", "gap"])

    fits = both.groupBy(*keys, "block").applyInPandas(run, f"{kinds}, b long, gap double").withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))
    replicate = F.when(F.col("b") >= 0, F.col("gap"))
    found = fits.groupBy(*keys).agg(F.max(F.when(F.col("b") == -1, F.col("gap"))).alias("gap"), *interval(replicate, level), F.count_if((F.col("b") >= 0) & F.col("gap").isNull()).alias("n_failed"), F.count_if(F.col("b") >= 0).alias("n_resamples"))
    sound = F.col("gap").isNotNull() & (F.col("n_failed") <= max_failures * F.col("n_resamples"))
    warning = F.when(F.col("gap").isNull(), "the point estimate failed").when(~sound, F.concat(F.col("n_failed").cast("string"), F.lit(" of "), F.col("n_resamples").cast("string"), F.lit(" resamples failed")))
    found = found.select(*keys, *[F.when(sound, F.col(c)).alias(c) for c in ("gap", "ci_low", "ci_high")], "n_failed", "n_resamples", warning.alias("warning"))
    return raw_gaps(rows, keys).join(found, list(keys), "left")


def raw_gaps(rows: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Accuracy of either region, their difference, trials and speakers of each cell."""
    sums = by_speaker(rows, keys, ["region"])
    side = lambda r: F.col("region") == r
    raw = sums.groupBy(*keys).agg(*[(F.sum(F.when(side(r), F.col("n_correct"))) / F.sum(F.when(side(r), F.col("n_trials")))).alias(f"accuracy_{r}") for r in (EXPOSED, BASELINE)], F.sum("n_trials").alias("n_trials"), F.count_distinct("speaker_code").alias("n_speakers"))
    return raw.withColumn("raw_gap", F.col(f"accuracy_{EXPOSED}") - F.col(f"accuracy_{BASELINE}"))


@dataclass(frozen=True)
class Ceiling:
    """The best accuracy that a task allows, and how it is known."""

    mode: str = "constructed"
    value: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in CEILING_MODES:
            raise ValueError(f"unknown ceiling mode {self.mode!r}")
        if not 0 <= self.value <= 1:
            raise ValueError(f"a ceiling of {self.value} is outside [0, 1]")


def paired(rows: DataFrame, conditions: Sequence[str] = ("asr", "reference")) -> DataFrame:
    """Rows of items that a model answered under every one of the conditions."""
    own = rows.where(F.col("condition").isin(list(conditions)))
    both = own.groupBy("model_key", "item_id").agg(F.count_distinct("condition").alias("n")).where(F.col("n") == len(conditions))
    return own.join(both, ["model_key", "item_id"], "left_semi")


def decomposition(rows: DataFrame, draws: DataFrame, ceiling: Ceiling = Ceiling(), level: float = 0.95) -> DataFrame:
    """Loss to recognition and to reasoning, by model and scope (``geral`` and each region), with intervals over the same draws."""
    own = paired(rows)
    scopes = own.withColumn("scope", F.explode(F.array(F.lit("geral"), F.col("region"))))
    is_asr = F.col("condition") == "asr"
    correct = F.col("is_correct").cast("long")
    sums = scopes.groupBy("model_key", "scope", "speaker_code").agg(F.sum(F.when(is_asr, correct)).alias("k_asr"), F.count_if(is_asr).alias("n_asr"), F.sum(F.when(~is_asr, correct)).alias("k_ref"), F.count_if(~is_asr).alias("n_ref"))
    point = sums.select("speaker_code").distinct().select(F.lit(-1).cast("long").alias("b"), "speaker_code", F.lit(1).cast("long").alias("weight"))
    weights = draws.select(F.col("b").cast("long"), "speaker_code", F.col("weight").cast("long")).unionByName(point)
    each = sums.join(weights, "speaker_code").groupBy("model_key", "scope", "b").agg(*[F.sum(F.coalesce(c, F.lit(0)) * F.col("weight")).alias(c) for c in ("k_asr", "n_asr", "k_ref", "n_ref")])
    each = each.withColumns({"asr": F.try_divide("k_asr", "n_asr"), "ref": F.try_divide("k_ref", "n_ref")}).withColumns({"d_asr": F.col("ref") - F.col("asr"), "d_reasoning": ceiling.value - F.col("ref")})
    point_of = lambda c: F.max(F.when(F.col("b") == -1, F.col(c)))
    drawn = lambda c: F.when(F.col("b") >= 0, F.col(c))
    (a0, a1), (r0, r1) = interval(drawn("d_asr"), level), interval(drawn("d_reasoning"), level)
    return each.groupBy("model_key", "scope").agg(point_of("asr").alias("accuracy_asr"), point_of("ref").alias("accuracy_reference"), point_of("d_asr").alias("delta_asr"), point_of("d_reasoning").alias("delta_reasoning"), a0.alias("asr_low"), a1.alias("asr_high"), r0.alias("reasoning_low"), r1.alias("reasoning_high"), (F.count_if((F.col("b") >= 0) & F.col("d_asr").isNull()) + F.count_if((F.col("b") >= 0) & F.col("d_reasoning").isNull())).alias("n_failed"))


def breaks_identity(ceiling: Ceiling = Ceiling(), tolerance: float = 1e-9) -> Column:
    """Whether a row of a decomposition doesn't add up to the ceiling; null where a part is."""
    return F.abs(F.col("accuracy_asr") + F.col("delta_asr") + F.col("delta_reasoning") - ceiling.value) > tolerance


def check_identity(table: DataFrame, ceiling: Ceiling = Ceiling(), tolerance: float = 1e-9) -> DataFrame:
    """Rows of a decomposition that don't add up to the ceiling; none for a sound one."""
    return table.where(breaks_identity(ceiling, tolerance))


def subsample_items(rows: DataFrame, n: int, seed: int, numpy_draws: bool = False) -> DataFrame:
    """At most n items a speaker; all rows of a chosen item stay."""
    pool = rows.select("speaker_code", "item_id").distinct()
    if numpy_draws:

        def draw(group: pd.DataFrame) -> pd.DataFrame:
            ids, who = sorted(group["item_id"]), group["speaker_code"].iloc[0]
            if len(ids) > n:
                generator = np.random.default_rng(int(stable_hash_py([seed, str(who)])[:16], 16))
                ids = [ids[i] for i in generator.permutation(len(ids))[:n]]
            return pd.DataFrame({"speaker_code": who, "item_id": ids})

        chosen = pool.groupBy("speaker_code").applyInPandas(draw, pool.schema)
    else:
        key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("speaker_code").cast("string"), F.col("item_id").cast("string")), 256)
        chosen = pool.withColumn("r", F.row_number().over(Window.partitionBy("speaker_code").orderBy(key))).where(F.col("r") <= n).drop("r")
    return rows.join(chosen, ["speaker_code", "item_id"], "left_semi")


def short_speakers(rows: DataFrame, n: int) -> DataFrame:
    """One row: speakers with fewer than n items, who keep all of theirs, and speakers in all."""
    items = rows.select("speaker_code", "item_id").distinct().groupBy("speaker_code").agg(F.count("*").alias("n"))
    return items.agg(F.count_if(F.col("n") < n).alias("n_short"), F.count("*").alias("n_speakers"))


def uncovered(rows: DataFrame, edges: Sequence[float], duration: str = "window_duration_s") -> DataFrame:
    """One row: trials whose duration is in no bin, and trials in all."""
    return rows.agg(F.count_if(duration_bin(F.col(duration), edges).isNull()).alias("n_uncovered"), F.count("*").alias("n_trials"))


def duration_bin(duration: Column, edges: Sequence[float]) -> Column:
    """``[a, b)``, the last closed; null outside."""
    if len(edges) < 2 or list(edges) != sorted(set(edges)):
        raise ValueError("at least two ascending edges")
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        last = i == len(edges) - 2
        out = F.when((duration >= a) & ((duration <= b) if last else (duration < b)), F.lit(f"[{a:g}, {b:g}{']' if last else ')'}")).otherwise(out)
    return out


def sensitivity(rows: DataFrame, draws: DataFrame, seed: int, item_grid: Sequence[int] = (3, 5, 8, 10), duration_edges: Sequence[float] = (30, 40, 50, 60), by_alternatives: bool = False, **fit) -> DataFrame:
    """Gap tables over subsets along axes: items a speaker, window duration, number of alternatives (off by default)."""
    parts = [subsample_items(rows, k, seed).withColumns({"axis": F.lit("n_items"), "variant": F.lit(str(k))}) for k in item_grid]
    if "window_duration_s" in rows.columns:
        parts.append(rows.withColumns({"axis": F.lit("window_duration"), "variant": duration_bin(F.col("window_duration_s"), duration_edges)}).where("variant is not null"))
    if by_alternatives:
        parts.append(rows.withColumns({"axis": F.lit("n_alternatives"), "variant": F.col("n_alternatives").cast("string")}))
    stacked = reduce(DataFrame.unionByName, parts)
    return gap_table(stacked, draws, ("axis", "variant", *CELL), **fit).orderBy("axis", "variant", *CELL)


def stratum_sizes(draws: DataFrame, stratum: str = "region") -> DataFrame:
    """Speakers (with repeats) of each stratum in each draw."""
    return draws.groupBy("b", stratum).agg(F.sum("weight").alias("n"))

