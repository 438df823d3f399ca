"""Small closed forms: binomial tails, the logistic, Brazilian number formats."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def chance_pass_probability(n_runs: int, at_least: int, n_alternatives: int) -> float:
    """Chance that blind guessing is right in at least so many of n runs."""
    if n_runs < 1 or n_alternatives < 1 or not 0 <= at_least <= n_runs:
        raise ValueError("runs and alternatives must be positive, the bound within 0 and the runs")
    p = 1 / n_alternatives
    return sum(math.comb(n_runs, k) * p**k * (1 - p) ** (n_runs - k) for k in range(at_least, n_runs + 1))


def expit(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def expit_of(z: Column) -> Column:
    """The logistic of a column; large values of either sign neither overflow nor cancel."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(bottom != 0, top.cast("double") / bottom)


def br_int(n: int) -> str:
    return f"{n:,}".replace(",", ".")


def br_number(x: float | None, decimals: int = 2) -> str:
    if x is None or x != x:
        return "-"
    return f"{x:,.{decimals}f}".replace(",", "_").replace(".", ",").replace("_", ".")


def br_percent(x: float | None) -> str:
    return "-" if x is None else f"{br_number(100 * x, 1)} %"


def br_int_of(n: Column) -> Column:
    """``br_int`` of a column; null stays null."""
    return F.translate(F.format_number(n, 0), ",", ".")


def br_number_of(x: Column, decimals: int = 2) -> Column:
    """``br_number`` of a column."""
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.translate(F.format_number(x, decimals), ",.", ".,"))
