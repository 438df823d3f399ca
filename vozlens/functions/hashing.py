"""Stable hashes, derived seeds and permutations, as expressions and as Python twins."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the compact JSON of the fields in sorted-key order; null fields are kept as null."""
    ordered = F.struct(*[c.alias(k) for k, c in sorted(fields.items())])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def stable_hash_py(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def derived_generator(*parts: object) -> np.random.Generator:
    """A generator seeded by the first 16 hex digits of the hash of the parts as strings."""
    return np.random.default_rng(int(stable_hash_py([str(p) for p in parts])[:16], 16))


def speaker_generator(seed: int, speaker: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{speaker}".encode()).digest()[:16], "big"))


def uint_of(hex_digits: Column) -> Column:
    """Unsigned value of up to 15 hex digits, as long."""
    return F.conv(hex_digits, 16, 10).cast("long")


def permutation(item: Column, model: Column, seed: int, n: int, shuffle: bool = True) -> Column:
    """The order in which n alternatives are shown: Fisher-Yates over a SHA-256 stream of (item, model, seed)."""
    start = F.array(*[F.lit(i) for i in range(n)])
    if not shuffle or n <= 1:
        return start
    digest = stable_hash(item_id=item, model_key=model, seed=F.lit(seed))
    blocks = [F.sha2(F.concat(digest, F.lit(f":{b}")), 256) for b in range(-(-4 * n // 32))]
    stream = F.concat(*blocks)
    out = start
    for i in range(n - 1, 0, -1):
        j = F.pmod(uint_of(F.substring(stream, 8 * i + 1, 8)), F.lit(i + 1)).cast("int")
        # through an array of one struct, so that each order is evaluated once
        out = F.transform(F.array(F.struct(out.alias("o"), j.alias("j"))), _swap(i))[0]
    return out


def _swap(i: int) -> Callable[[Column], Column]:
    """The order of (o, j) with places i and j swapped."""
    return lambda s: F.transform(s["o"], lambda v, k: F.when(k == i, s["o"][s["j"]]).when(k == s["j"], s["o"][i]).otherwise(v))


def filter_permutation(item: Column, model: Column, run: Column, seed: int, n: int) -> Column:
    """The order of n alternatives in one run of the text-only filter: a PCG64 permutation seeded by (seed, item, model, run)."""

    @F.pandas_udf("array<int>")
    def orders(items: pd.Series, models: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([derived_generator(seed, i, m, int(r)).permutation(n).tolist() for i, m, r in zip(items, models, runs, strict=True)])

    return orders(item.cast("string"), model.cast("string"), run.cast("long"))


def permutation_py(item: str, model: str, seed: int, n: int, shuffle: bool = True) -> list[int]:
    order = list(range(n))
    if not shuffle or n <= 1:
        return order
    digest = stable_hash_py({"item_id": item, "model_key": model, "seed": seed})
    stream = b"".join(hashlib.sha256(f"{digest}:{b}".encode()).digest() for b in range(-(-4 * n // 32)))
    for i in reversed(range(1, n)):
        j = int.from_bytes(stream[4 * i : 4 * i + 4], "big") % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def deterministic_choice(payload: Column, seed: int, n: int) -> Column:
    """Index below n from the first 8 bytes of SHA-256 of ``seed:payload`` (unsigned)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), payload), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")
