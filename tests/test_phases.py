"""Recognition before answering, order of emission, selective fetch, planted windows, fits at once, checked joins, sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vozlens.functions.hashing import derived_generator, filter_permutation
from vozlens.operators import analysis, audio, audit, ledger, recognition, runner, windows
from vozlens.sources import corpus, files, planted

ASR = recognition.Spec("a", "asr", "p", "m", "1")


def test_recognition_resolves_each_window_once(spark):
    w = spark.createDataFrame([("w1", "x"), ("w1", "x"), ("w2", "y"), ("w3", None), ("w4", "bad")], "window_id string, audio string")
    keys = {r.window_id: r.key for r in recognition.asr_tasks(w, ASR).collect()}
    other = {r.key for r in recognition.asr_tasks(w, recognition.forced(ASR)).collect()}
    assert len(keys) == 4 and not other & set(keys.values())
    cache = spark.createDataFrame([(keys["w2"], "known")], "key string, text string")

    def client():
        def call(audio_):
            if audio_ == "bad":
                raise ValueError("no sound")
            return "heard " + audio_

        return call

    found = recognition.resolve(w, ASR, cache, client, retries=0).persist()
    got = {r.window_id: (r.text, r.error, r.cached) for r in found.collect()}
    assert got["w1"] == ("heard x", None, False) and got["w2"] == ("known", None, True)
    assert got["w3"] == (None, "insumo_ausente: window_id=w3", False) and got["w4"] == (None, "asr_falhou: ValueError: no sound", False)
    assert [r.window_id for r in recognition.to_asr_cache(found, ASR).collect()] == ["w1"]
    again = spark.createDataFrame([(keys["w2"], "another")], "key string, text string")
    hashes = [{r.window_id: r.asr_hash for r in recognition.as_inputs(recognition.resolve(w, ASR, c, client, retries=0)).collect()} for c in (cache, again)]
    assert hashes[0]["w1"] == hashes[1]["w1"] and hashes[0]["w2"] != hashes[1]["w2"]


def test_hypotheses_reach_the_answers_keys_in_order(spark):
    option = [{"label": x, "text": x * 2, "is_correct": x == "A", "source_window_id": None} for x in "ABCD"]
    items = spark.createDataFrame([(f"i{k}", f"w{k}", "Q?", option) for k in (2, 1)], "item_id string, window_id string, question string, alternatives array<struct<label: string, text: string, is_correct: boolean, source_window_id: string>>")
    models = spark.createDataFrame([("m1", "text_qa"), ("m0", "text_qa")], "model_key string, role string")
    inputs = lambda h: spark.createDataFrame([("w1", "asr", "t", h, None), ("w2", "asr", None, None, "asr_falhou: x")], "window_id string, condition string, content string, asr_hash string, input_error string")
    shown = lambda q, a, t, has: F.concat(F.lit("own "), q)
    rows = recognition.in_order(runner.tasks(items, ["asr", "reference"], models, inputs("h"), 1, prompt_builder=shown)).collect()
    assert [(r.item_id, r.condition, r.model_key, r.ordinal) for r in rows] == [(i, c, m, n) for i in ("i1", "i2") for n, (c, m) in enumerate((c, m) for c in ("asr", "reference") for m in ("m0", "m1"))]
    assert {r.prompt for r in rows if r.error is None} == {"own Q?"} and {r.error for r in rows if r.item_id == "i2"} == {"asr_falhou: x", "insumo_ausente: reference"}
    keys = {r.cache_key for r in rows if r.error is None} & {r.cache_key for r in runner.tasks(items, ["asr"], models, inputs("other"), 1).collect()}
    assert not keys


def test_clients_by_provider():
    made = recognition.clients([ASR], {("p", "asr"): lambda s: lambda x: s.key + x})
    assert made["a"]()("!") == "a!"
    with pytest.raises(ValueError):
        recognition.clients([ASR], {})
    with pytest.raises(ValueError):
        recognition.clients([ASR, ASR], {("fake", "asr"): lambda s: str}, fake=True)


def test_retry_waits_as_asked():
    waits, errors = [], [ConnectionError("a"), ConnectionError("b")]
    errors[1].retry_after = 7

    def call(x):
        if errors:
            raise errors.pop(0)
        return x

    assert runner.with_retry(call, 3, waits.append)("x") == "x" and waits == [0.5, 7.0]


def test_filter_permutations_by_run(spark):
    df = spark.createDataFrame([("i", "m", r) for r in range(5)], "i string, m string, r int")
    got = {x.r: list(x.p) for x in df.select("r", filter_permutation(F.col("i"), F.col("m"), F.col("r"), 9, 4).alias("p")).collect()}
    assert got == {r: derived_generator(9, "i", "m", r).permutation(4).tolist() for r in range(5)} and len({tuple(p) for p in got.values()}) > 1


def test_selective_fetch_reads_the_groups_it_needs(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for shard in range(2):
        t = pa.table({"k": [f"s{shard}k{i}" for i in range(100)], "audio": [bytes([shard, i]) * 2000 for i in range(100)]})
        pq.write_table(t, tmp_path / f"{shard}.parquet", row_group_size=10)
    index = corpus.index_shards(spark, str(tmp_path), "k")
    wanted = spark.createDataFrame([("s0k3",), ("s0k4",), ("s1k99",), ("s1k99",), ("none",)], "k string")
    planned = audio.fetch_plan(index, wanted, "k")
    assert sorted((r.row_group, r.n_wanted) for r in planned.collect()) == [(0, 2), (9, 1)]
    got = {r.k: bytes(r.audio) for r in corpus.fetch(planned, "k", "audio").collect()}
    assert got == {"s0k3": b"\0\3" * 2000, "s0k4": b"\0\4" * 2000, "s1k99": b"\1\x63" * 2000}
    saved = audio.plan_bytes(index, planned).first()
    assert (saved.groups_planned, saved.groups_all) == (2, 20) and saved.bytes_planned < saved.bytes_all / 5 and saved.bytes_avoided == saved.bytes_all - saved.bytes_planned


def test_windows_of_the_planted_corpus(spark):
    rows = planted.planted(spark).withColumn("region", audit.region_of(F.col("birth_state"), planted.REGIONS))
    informants = windows.scope(windows.mark_turns(rows, F.col("speaker_type") == "R"), "region", "age", ["NE", "SE"], 20, 69).persist()
    assert {r.reason: r.n for r in ledger.ledger(informants).collect()} == {"kept": 1030, windows.OUT_REGION: 96, windows.OUT_AGE: 96}
    for close, of_interrupted in ((True, 13), (False, 15)):
        runs = windows.assign_runs(ledger.kept(informants), close_on_turn=close).persist()
        packed = windows.pack_runs(runs)
        assert packed.where("speaker_code = 'NE_INTERRUPTED'").count() == of_interrupted
        made = windows.build(runs, windows.choose(packed, 10, 1), 10)
        assert {r[0]: r[1] for r in made.groupBy(F.substring("speaker_code", 1, 2)).count().collect()} == {"NE": 33, "SE": 50}
    tally = windows.break_tally(windows.assign_runs(ledger.kept(informants))).first()
    assert (tally.n_recording, tally.n_turn, tally.n_gap, tally.n_speakers, tally.n_runs) == (1, 4, 1, 9, 15)


def test_polyphase_resampling():
    for rate in (8000, 44_100, 48_000, 22_050):
        t = np.arange(rate) / rate
        got = audio.resample(np.sin(2 * np.pi * 440 * t), rate)
        want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
        assert len(got) == 16_000 and np.abs(got - want)[400:-400].max() < 2e-3
    high = audio.resample(np.sin(2 * np.pi * 15_000 * np.arange(48_000) / 48_000), 48_000)
    assert np.abs(high)[400:-400].max() < 0.01  # above the target's half rate: gone
    assert len(audio.resample(np.zeros(0), 8000)) == 0


def test_fits_at_once_equal_single_ones():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(40), np.arange(40) % 2, rng.normal(size=40), rng.integers(0, 2, 40)])
    n = rng.integers(1, 12, 40).astype(float)
    k = rng.binomial(n.astype(int), 0.6).astype(float)
    w = rng.poisson(1.0, (40, 60)).astype(float)
    w[:, 0], w[x[:, 1] == 1, 1] = 0, 0  # nothing drawn; one region only
    got = analysis.marginal_effects(x, k, n, w)
    want = [analysis.marginal_effect(x, k * w[:, b], n * w[:, b]) for b in range(60)]
    assert np.isnan(got[:2]).all() and want[:2] == [None, None]
    assert np.allclose(got[2:], want[2:], atol=1e-9)
    assert np.allclose(analysis._quasi_newton(x, k, n), analysis.fit_logit(x, k, n), atol=1e-4)


def test_injected_statistic_and_ceilings(spark):
    rows = spark.createDataFrame([(f"i{i}", f"s{i % 6}", "m", "asr", ("NE", "SE")[i % 2], 30.0 + i % 6, "F", i % 3 == 0) for i in range(60)], "item_id string, speaker_code string, model_key string, condition string, region string, age double, speaker_gender string, is_correct boolean")
    draws = analysis.hashed_resamples(rows, 20, 1)
    got = analysis.gap_table(rows, draws, statistic=lambda x, k, n: float(k.sum() / n.sum())).first()
    assert got.gap == pytest.approx(1 / 3) and got.n_failed == 0 and got.warning is None
    for bad in (("x", 1.0), ("constructed", 1.5)):
        with pytest.raises(ValueError):
            analysis.Ceiling(*bad)


def test_checked_joins_and_manifests(spark):
    left = spark.createDataFrame([("a", "NE"), ("b", "SE")], "k string, region string")
    right = spark.createDataFrame([("a", "NE", "F"), ("b", "SE", "M")], "k string, region string, gender string")
    assert {r.k: r.gender for r in ledger.joined_whole(left, right, "k", ["region"]).collect()} == {"a": "F", "b": "M"}
    with pytest.raises(Exception, match="no partner for k=b"):
        ledger.joined_whole(left, right.where("k = 'a'"), "k").collect()
    with pytest.raises(Exception, match="region differs for k=b"):
        ledger.joined_whole(left, right.withColumn("region", F.lit("NE")), "k", ["region"]).collect()
    shares = ledger.manifest_ledger(spark.createDataFrame([("ok",), ("ok",), ("x",), ("ok",)], "status string"))
    assert {r.status: (r.n, r.share) for r in shares.collect()} == {"ok": (3, 0.75), "x": (1, 0.25)}


def test_window_files_revisions_and_summaries(spark, tmp_path):
    one = {f.name: None for f in files.WINDOW_SCHEMA} | {"window_id": "w", "speaker_code": "s", "segment_file_paths": ["f"], "reference_text": "t"}
    for name, row in (("ok.jsonl", one), ("bad.jsonl", one | {"reference_text": None})):
        pd.DataFrame([row]).to_json(tmp_path / name, orient="records", lines=True)
    assert files.read_windows(spark, str(tmp_path / "ok.jsonl"))[0].first().window_id == "w"
    with pytest.raises(Exception, match="a window lacks reference_text"):
        files.read_windows(spark, str(tmp_path / "bad.jsonl"))[0].collect()
    rows = spark.createDataFrame([(f"w{i}",) for i in range(9)], "window_id string")
    assert [r.window_id for r in files.first_windows(rows, 2).collect()] == ["w0", "w1"] and files.first_windows(rows, None).count() == 9
    before = files.revision(spark, str(tmp_path / "ok.jsonl"))
    assert before == files.revision(spark, str(tmp_path / "ok.jsonl")) != files.revision(spark, str(tmp_path / "bad.jsonl"))
    at = str(tmp_path / "s.json")
    assert files.load_summaries(at) == {}
    files.save_summaries(at, "b", {"n": 1})
    files.save_summaries(at, "a", {"n": 2})
    assert list(files.load_summaries(at).items()) == [("a", {"n": 2}), ("b", {"n": 1})]
