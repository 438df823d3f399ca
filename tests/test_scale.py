"""What lets a plan grow with its input: no broadcast of a table that grows, windows summed alone, bounded tasks and batches."""

import datetime as dt
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vozlens import plans
from vozlens.functions import text as text_functions
from vozlens.operators import analysis, audio, items
from vozlens.plans import bindings

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_speakers_are_not_broadcast(spark):
    assert "Broadcast" not in plan(analysis.trials(bindings.records(spark, D), bindings.speakers(spark, D)))


def test_identity_plans_the_decomposition_once(spark):
    text = plan(plans.QUERIES["analysis_identity"](spark, D))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.fixture(scope="module")
def long_runs(spark, tmp_path_factory):
    """Events of long runs, in which many windows last just 60 or 300 seconds."""
    rng, d = np.random.default_rng(6), str(tmp_path_factory.mktemp("runs"))
    values = rng.choice([0.1, 19.9, 29.7, 30.3, 40.1, 239.9, 240.3, 269.7], 2000)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i // 20), i % 20, "view", float(v), "") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["windows_pack", "windows_choose", "windows_build", "windows_candidate_ledger", "audio_required_keys"])
def test_windows_on_a_bound(spark, long_runs, name):
    got = plans.QUERIES[name](spark, long_runs)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{long_runs}/events.parquet/*.parquet'")
    want = db.sql(plans.ORACLE_SQL[name])
    at = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in at) for r in got.collect()) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def few_windows(spark, tmp_path_factory):
    """Events of speakers of at most four windows, all drawn: each of three events that last just 60 or 300 seconds, between events too long for one."""
    d = str(tmp_path_factory.mktemp("few"))
    parts = [(28.7, 27.6, 3.7), (23.8, 25.3, 10.9), (17.2, 26.4, 256.4), (23.2, 11.1, 265.7)]
    values = [(user, v) for user in range(20) for k in range(1 + user % 4) for v in (1000.0 * (1 + user), *parts[(user + k) % 4], 500.0)]
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), user, "view", v, "") for i, (user, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["windows_choose", "windows_build", "audio_required_keys", "windows_candidate_ledger"])
def test_drawn_windows_on_a_bound(spark, few_windows, name):
    test_windows_on_a_bound(spark, few_windows, name)


def test_context_pairs_are_not_shuffled(spark):
    text = plan(plans.QUERIES["items_context"](spark, D))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    w = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", None), (None, "c"), (None, "d")], "speaker_code string, window_id string")
    for numpy_draws in (False, True):
        got = {r.window_id: list(r.context) for r in items.context_windows(w, 3, 5, numpy_draws).collect()}
        assert got == {"a": ["b"], "b": ["a"], None: [], "c": [], "d": []}


def test_ranges_are_spread_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(audio, "TASK_BYTES", 1000)
    df = plans.QUERIES["ranges_coalesced"](spark, D)
    many = [int(x) for x in re.findall(r"hashpartitioning\(shard#\d+L, (\d+)\), REPARTITION_BY_NUM", plan(df))]
    assert many and many[0] > 20 and plan(df).count("Exchange hashpartitioning") == 1
    got = sorted(tuple(r) for r in df.collect())
    monkeypatch.undo()
    assert got == sorted(tuple(r) for r in plans.QUERIES["ranges_coalesced"](spark, D).collect())


def test_texts_are_made_by_slices():
    texts, seen = ["a" * 400, None, "b" * 700, "", "c" * 400] * 3, []
    make = lambda part: seen.append(len(part)) or pa.array(part, pa.string())
    got = text_functions._by_slices(pa.array(texts), make, pa.array([], pa.string()), 1000)
    assert got.to_pylist() == texts and len(seen) > 3 and sum(seen) == len(texts)
