"""Checked strata, typed payloads, number formats and the logistic of columns, a statistic of the caller's."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlens.functions import statistics
from vozlens.operators import analysis as S
from vozlens.operators.audio import required_keys
from vozlens.sources.files import typed


def test_draws_refuse_a_speaker_of_two_strata(spark):
    sound = spark.createDataFrame([("a", "NE"), ("b", "NE"), ("c", "SE"), ("c", "SE")], "speaker_code string, region string")
    assert S.stratum_conflicts(sound).count() == 0
    draws = S.hashed_resamples(sound, 3, 1).groupBy("b", "region").agg(F.sum("weight").alias("n")).collect()
    assert sorted((r.b, r.region, r.n) for r in draws) == [(b, r, n) for b in range(3) for r, n in (("NE", 2), ("SE", 1))]
    for other in ("SE", None):
        broken = sound.union(spark.createDataFrame([("a", other)], sound.schema))
        with pytest.raises(Exception, match="more than one stratum: a"):
            S.hashed_resamples(broken, 3, 1).collect()


def test_typed_fills_defaults_and_refuses_broken_objects(spark):
    schema = T.StructType.fromDDL("label string, n long, tags array<string>")
    rows = spark.createDataFrame([(1, '{"label":"A","n":2,"tags":["x"]}'), (2, "{}"), (3, '{"n":null}'), (4, None)], "k int, raw string")
    got = {r.k: (r.label, r.n, r.tags) for r in typed(rows, "raw", schema, {"label": "?", "n": 0}).collect()}
    assert got == {1: ("A", 2, ["x"]), 2: ("?", 0, None), 3: ("?", 0, None), 4: ("?", 0, None)}
    with pytest.raises(Exception, match="(?i)malformed"):
        typed(spark.createDataFrame([(1, "{")], "k int, raw string"), "raw", schema, {}).collect()


def test_formats_of_columns_equal_those_of_values(spark):
    values = [0.0, 1234567.891, -9876.5, 0.1, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", statistics.br_number_of(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [statistics.br_number(v) for v in values]
    whole = [0, 999, 1000, -1234567]
    assert [r.s for r in spark.createDataFrame([(v,) for v in whole], "x long").select(statistics.br_int_of(F.col("x")).alias("s")).collect()] == [statistics.br_int(v) for v in whole]


def test_logistic_of_columns_is_stable(spark):
    values = [-800.0, -1.5, 0.0, 1.5, 800.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "z double").select(statistics.expit_of(F.col("z")).alias("p")).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-15) for a, b in zip(got, statistics.expit(np.array(values)), strict=True))


def test_required_keys_are_distinct(spark):
    windows = spark.createDataFrame([(["a", "b"],), (["b"],), ([],), (None,)], "segments array<string>")
    assert sorted(r.file_path for r in required_keys(windows).collect()) == ["a", "b"]
