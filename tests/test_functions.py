import numpy as np
import pytest
from pyspark.sql import functions as F

from vozlens.functions import answers, hashing, text
from vozlens.functions.statistics import br_int, br_number, chance_pass_probability, expit

NUMBERS = [("100", "cem"), ("101", "cento e um"), ("1985", "mil novecentos e oitenta e cinco"), ("1500", "mil e quinhentos"), ("1.500", "mil e quinhentos"), ("1000", "mil"), ("1000000", "um milhão"), ("3,14", "três vírgula um quatro"), ("007", "zero zero sete"), ("0", "zero"), ("2000100", "dois milhões e cem"), ("1001001", "um milhão mil e um"), ("a gente (risos) foi", "a gente foi"), ("guarda-chuva d'água", "guarda chuva dágua"), ("2ª hum vez", "dois vez")]


@pytest.mark.parametrize("raw,want", NUMBERS)
def test_normalised(raw, want):
    assert text.normalize_py(raw) == want
    assert text.normalize_py(want) == want


def test_normalise_column(spark):
    df = spark.createDataFrame([(r,) for r, _ in NUMBERS] + [(None,)], "t string")
    got = [r.n for r in df.select(text.normalize(F.col("t")).alias("n")).collect()]
    assert got == [w for _, w in NUMBERS] + [None]
    assert [r for r, _ in text.trace_py("Olá, 2")] == list(text.RULES)
    with pytest.raises(ValueError):
        text.normalize(F.col("t"), "v0")


ANSWERS = [("C", "C", "resposta_e_so_a_letra", None), ("c", "C", "resposta_e_so_a_letra", None), ("Alternativa C.", "C", "marcador_explicito", None), ("A resposta correta é a letra B", "B", "marcador_explicito", None), ("C) porque o falante diz que mora no interior", "C", "letra_enumerada", None), ("", None, None, "vazio"), ("C ou D", None, "unica_letra_isolada", "ambiguo"), ("Z", None, None, "letra_fora_do_vocabulario"), ("Acho que o falante fala de futebol e de comida", None, None, "sem_letra"), ("O falante menciona futebol e times.", None, None, "sem_letra"), ("fico com (B) mesmo", "B", "letra_entre_delimitadores", None)]


@pytest.mark.parametrize("raw,label,strategy,reason", ANSWERS)
def test_cascade(raw, label, strategy, reason):
    got = answers.parse_py(raw, "ABCD")
    assert got[0] == label and got[2] == reason and got[1] == strategy


def test_cascade_column(spark):
    df = spark.createDataFrame([(i, r) for i, (r, *_) in enumerate(ANSWERS)] + [(99, None)], "i int, t string")
    got = {r.i: (r.p.label, r.p.reason) for r in df.select("i", answers.parse_label(F.col("t"), "ABCD").alias("p")).collect()}
    assert got == {i: (a[1], a[3]) for i, a in enumerate(ANSWERS)} | {99: (None, "vazio")}


def test_permutation(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("i"))
    for n in (1, 2, 4, 5, 8, 10):
        got = {r.i: list(r.p) for r in df.select("i", hashing.permutation(F.col("i"), F.lit("mé"), 7, n).alias("p")).collect()}
        assert got == {str(i): hashing.permutation_py(str(i), "mé", 7, n) for i in range(60)}
    assert hashing.permutation_py("x", "m", 1, 4, shuffle=False) == [0, 1, 2, 3]


def test_hashes(spark):
    row = spark.range(1).select(hashing.stable_hash(b=F.lit("é"), a=F.lit(1), c=F.lit(None).cast("string")).alias("h")).first()
    assert row.h == hashing.stable_hash_py({"a": 1, "b": "é", "c": None})


def test_small_statistics():
    assert chance_pass_probability(3, 2, 4) == 0.15625
    assert np.allclose(expit(np.array([-800.0, 0, 800])), [0, 0.5, 1])
    assert br_int(1234567) == "1.234.567" and br_number(1234.5) == "1.234,50" and br_number(None) == "-"
