"""Versioned normalisation of Brazilian-Portuguese transcripts, in seven rules, and their trace."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of numbers, hesitations and marks that results depend on.
UNITS = "zero um dois três quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis dezessete dezoito dezenove".split()
TENS = "- - vinte trinta quarenta cinquenta sessenta setenta oitenta noventa".split()
HUNDREDS = "- cento duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos".split()
SCALES = (("", ""), ("mil", "mil"), ("milhão", "milhões"), ("bilhão", "bilhões"))
HESITATIONS = "ah aham ahm ahn ahã eh ehm ehn hm hmm hmmm hum humm mhm mm mmm uh uhm uhum ã ãh ãhn ãn".split()
SPACE_MARKS = "-–—/\\_"
DROPPED_MARKS = "'’`´"
ORDINALS = "ºª"
RULES = ("nfc", "caixa_baixa", "marcacoes_de_anotacao", "numeros_por_extenso", "pontuacao", "marcas_de_hesitacao", "espacos")
VERSION = "v1"

_TAGS = re.compile(r"\[[^\]]*\]|\([^)]*\)|<[^>]*>")


def _group(n: int) -> str:
    """Words of 1 to 999."""
    if n == 100:
        return "cem"
    parts = []
    if n >= 100:
        parts.append(HUNDREDS[n // 100])
        n %= 100
    if n >= 20:
        parts.append(TENS[n // 10])
        n %= 10
    if n:
        parts.append(UNITS[n])
    return " e ".join(parts)


def spelled(n: int) -> str:
    """Words of an integer below 10**12, by groups of three digits from the last."""
    if n == 0:
        return UNITS[0]
    groups = []
    while n:
        groups.append(n % 1000)
        n //= 1000
    out, below = "", 0
    for power, g in enumerate(groups):
        if g:
            one, many = SCALES[power]
            words = "mil" if power == 1 and g == 1 else f"{_group(g)} {one if g == 1 else many}".strip()
            rest_is_round = below < 100 or below % 100 == 0
            out = words if not out else f"{words}{' e ' if rest_is_round else ' '}{out}"
        below += g * 1000**power
    return out


def _digits(text: str) -> str:
    return " ".join(UNITS[int(d)] for d in text)


def _run(text: str, at: int) -> int:
    """Where the digits that begin at ``at`` end."""
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def with_numbers(text: str) -> str:
    """Every number in words: points before three digits part thousands, a comma starts digits that are read one by one.

    So are whole parts that begin with 0 or have more than twelve digits.
    """
    out, at = [], 0
    while at < len(text):
        stop = _run(text, at)
        if stop == at:
            out.append(text[at])
            at += 1
            continue
        digits = text[at:stop]
        if len(digits) <= 3:
            while text[stop : stop + 1] == "." and _run(text, stop + 1) >= stop + 4:
                digits += text[stop + 1 : stop + 4]
                stop += 4
        code = digits[0] == "0" and len(digits) > 1 or len(digits) > 12
        words = [_digits(digits) if code else spelled(int(digits))]
        end = _run(text, stop + 1) if text[stop : stop + 1] == "," else stop
        if end > stop + 1:
            words += ["vírgula", _digits(text[stop + 1 : end])]
            stop = end
        out.append(f" {' '.join(words)} ")
        at = stop
    return "".join(out)


def _mark(c: str) -> str:
    if c in SPACE_MARKS:
        return " "
    if c in DROPPED_MARKS:
        return ""
    if c.isspace() or c.isalnum() and c not in ORDINALS and unicodedata.category(c) != "No":
        return c
    return " "


_STEPS: dict[str, Callable[[str], str]] = {
    "nfc": lambda t: unicodedata.normalize("NFC", t),
    "caixa_baixa": str.lower,
    "marcacoes_de_anotacao": lambda t: _TAGS.sub(" ", t),
    "numeros_por_extenso": with_numbers,
    "pontuacao": lambda t: "".join(map(_mark, t)),
    "marcas_de_hesitacao": lambda t: " ".join(w for w in t.split() if w not in HESITATIONS),
    "espacos": lambda t: " ".join(t.split()),
}


def check_version(version: str) -> None:
    if version != VERSION:
        raise ValueError(f"unknown normaliser version {version!r}")


def normalize_py(text: str, version: str = VERSION) -> str:
    check_version(version)
    for name in RULES:
        text = _STEPS[name](text)
    return text


def trace_py(text: str, version: str = VERSION) -> list[tuple[str, str]]:
    check_version(version)
    out = []
    for name in RULES:
        text = _STEPS[name](text)
        out.append((name, text))
    return out


def _by_slices(values: pa.Array, make: Callable[[list], pa.Array], none: pa.Array, most: int = 500_000) -> pa.Array:
    """What ``make`` makes of slices of ``values`` of about ``most`` bytes, joined: Python strings exist for one slice at a time."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(values)]
    made = [make(values.slice(i, j - i).to_pylist()) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    return pa.concat_arrays(made) if made else none


def normalize(text: Column, version: str = VERSION) -> Column:
    """The normalised text; null stays null. Arrow batches: no expression of Spark's does NFC or spells numbers."""
    check_version(version)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return _by_slices(values, lambda texts: pa.array([None if t is None else normalize_py(t) for t in texts], pa.string()), pa.array([], pa.string()))

    return run(text)


def trace(text: Column, version: str = VERSION) -> Column:
    """What each rule made of the text, in order, as array<struct<rule, text>>."""
    check_version(version)
    kind = pa.list_(pa.struct([("rule", pa.string()), ("text", pa.string())]))

    def make(texts: list) -> pa.Array:
        return pa.array([None if t is None else [{"rule": r, "text": x} for r, x in trace_py(t)] for t in texts], kind)

    @F.arrow_udf("array<struct<rule: string, text: string>>")
    def run(values: pa.Array) -> pa.Array:
        return _by_slices(values, make, pa.array([], kind))

    return run(text)


def without_tags(text: Column) -> Column:
    """Annotations in square, round or angle brackets become one space."""
    return F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", " ")


def without_hesitations(text: Column) -> Column:
    """Whole tokens that are filled pauses go."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: ~w.isin(HESITATIONS))
    return F.array_join(tokens, " ")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
