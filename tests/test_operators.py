import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vozlens import config, reports
from vozlens.functions.hashing import derived_generator, speaker_generator
from vozlens.operators import analysis, audio, audit, items, ledger, runner, wer, windows
from vozlens.sources import corpus, files
from vozlens.streaming import cache


# ---- windows

def segments(spark, rows):
    """rows: (speaker, recording, type, start); four seconds each."""
    data = [(s, r, f"{r}_{i:04d}", t, float(a), float(a) + 4, 4.0, f" t{i} ") for i, (s, r, t, a) in enumerate(rows)]
    return spark.createDataFrame(data, "speaker_code string, audio_name string, file_path string, speaker_type string, start_time double, end_time double, duration double, normalized_text string")


def run(rows, **k):
    return windows.assign_runs(windows.mark_turns(rows, F.col("speaker_type") == "R"), **k)


def test_one_long_speaker(spark):
    r = run(segments(spark, [("a", "ra", "R", 4 * i) for i in range(160)]))
    packed = windows.pack_runs(r)
    assert packed.count() == 20 and {x.length for x in packed.collect()} == {8}
    chosen = windows.choose(packed, 10, 1)
    made = windows.build(r, chosen, 10).orderBy("window_id").collect()
    assert [m.window_id for m in made] == [f"a__w{i:02d}" for i in range(1, 11)]
    assert all(m.n_segments == 8 and m.duration_s == 32.0 for m in made)
    assert [m.start_time for m in made] == sorted(m.start_time for m in made)
    assert made[0].reference_text.split() == [f"t{k}" for k in range(int(made[0].start_time / 4), int(made[0].start_time / 4) + 8)]
    assert windows.build(r, windows.choose(packed, 30, 1), 30, allow_fewer=False).count() == 0


def test_turns_gaps_and_recordings(spark):
    rows = [("a", "r1", "P/1", 0), ("a", "r1", "R", 4), ("b", "r1", "P/1", 8), ("a", "r1", "R", 12), ("a", "r1", "R", 40), ("a", "r2", "R", 0), ("a", "r2", "R", 4)]
    closed, open_ = ([x.break_reason for x in run(segments(spark, rows), close_on_turn=c).orderBy("audio_name", "start_time").collect()] for c in (True, False))
    assert closed == ["first", windows.BREAK_TURN, windows.BREAK_GAP, windows.BREAK_RECORDING, None]
    assert open_ == ["first", None, windows.BREAK_GAP, windows.BREAK_RECORDING, None]
    marked = windows.mark_turns(segments(spark, rows), F.col("speaker_type") == "R").orderBy("audio_name", "start_time").collect()
    assert [m.turns_before for m in marked] == [1, 1, 0, 0, 0] and marked[0].seconds_before == 4.0
    tally = windows.break_tally(run(segments(spark, rows))).first()
    assert tally.n_runs == tally.n_speakers + tally.n_recording + tally.n_turn + tally.n_gap and tally.n_observed_turns == 1


def test_packing_against_the_loop(spark):
    rng = random.Random(5)
    d = [round(rng.uniform(0.5, 9), 2) for _ in range(300)]
    rows = [("a", "r", f"{i:04d}", float(sum(d[:i])), float(sum(d[: i + 1])), x, 0) for i, x in enumerate(d)]
    df = spark.createDataFrame(rows, "speaker_code string, audio_name string, file_path string, start_time double, end_time double, duration double, run int")
    want, at, cum = [], 0, np.concatenate([[0.0], np.cumsum(d)])
    while at + 8 <= len(d):
        took = 0
        for n in range(8, min(15, len(d) - at) + 1):
            total = cum[at + n] - cum[at]
            if total > 60:
                break
            if total >= 30:
                took = n
                break
        if took:
            want.append((at, took))
        at += took or 1
    got = sorted((r.pos, r.length) for r in windows.pack_runs(df).collect())
    assert got == want and want


def test_numpy_draws(spark):
    c = spark.createDataFrame([("s", 0, i) for i in range(23)], "speaker_code string, run int, pos int")
    got = sorted(r.pos for r in windows.choose(c, 7, 9, numpy_draws=True).where("drawn").collect())
    g = speaker_generator(9, "s")
    assert got == [int(b[int(g.integers(0, len(b)))]) for b in np.array_split(np.arange(23), 7)]


def test_scope_ledger(spark):
    rows = spark.createDataFrame([("NE", 30), ("SE", 80), ("x", 80), (None, 30)], "region string, age int")
    got = {r.reason: r.n for r in ledger.ledger(windows.scope(rows, "region", "age", ["NE", "SE"], 20, 69)).collect()}
    assert got == {"kept": 1, windows.OUT_AGE: 1, windows.OUT_REGION: 2}
    ledger.assert_balanced(got, 4)
    with pytest.raises(ValueError):
        ledger.assert_balanced(got, 5)


# ---- audit

def test_audit_small(spark):
    df = spark.createDataFrame([("R", "a", "Bahia", 20, 1800.0), ("R", "a", "Bahia", 20, 3600.0), ("R", "b", "São Paulo", 35, 60.0), ("P/1", "x", "", 0, 9.0)], "speaker_type string, speaker_code string, birth_state string, age int, duration double")
    inf, dropped = audit.informants(df)
    assert [tuple(r) for r in dropped.collect()] == [("P/1", 1)]
    by = {r.region: r for r in audit.counts(inf.withColumn("region", audit.region_of(F.col("birth_state"))), ["birth_state", "region"]).collect()}
    assert (by["NE"].n_speakers, by["NE"].n_segments, by["NE"].hours) == (1, 2, 1.5) and by["SE"].n_segments == 1
    ages = spark.createDataFrame([(a,) for a in (15, 16, 24, 25, 59, 60, 119, 120)], "age int")
    assert [r[0] for r in ages.select(audit.age_bucket(F.col("age"))).collect()] == ["fora_das_bordas", "16-24", "16-24", "25-34", "45-59", "60-119", "60-119", "fora_das_bordas"]
    d = audit.describe(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double"), "v").first()
    assert (d["min"], d.q1, d.median, d.q3, d["max"], d["mean"]) == (1, 1.75, 2.5, 4.75, 10, 4)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("bins", [2, 7, 256])
def test_quantiles(spark, keys, bins):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 0.0, -1.5, 3.0, draw.gauss(0, 9)])) for _ in range(900)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"low": 0.0, "third": 1 / 3, "half": 0.5, "high": 0.975, "top": 1.0}
    got = {r[: len(keys)]: r[len(keys) :] for r in audit.quantiles(df, "v", at, keys, bins).collect()}
    want = df.where("v is not null").groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in at.items()])
    assert got == {r[: len(keys)]: r[len(keys) :] for r in want.collect()}
    assert audit.quantiles(df.where("v is null"), "v", at, keys, bins).count() == 0
    full = audit.with_quantiles(df, "v", at, keys, {"n": F.count("*")})
    assert full.agg(F.sum("n")).first()[0] == len(rows) and full.columns == [*keys, "n", *at]


# ---- words

def brute(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    t[:, 0], t[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return t[-1, -1]


def test_edits(spark):
    pairs = [("a gente morava na roça", "a gente morava na rosa", 1, 0, 0, 5), ("meu pai trabalhava", "meu pai muito trabalhava", 0, 1, 0, 3), ("meu pai trabalhava na roça", "meu pai na roça", 0, 0, 1, 5), ("o meu pai trabalhava na roça todo dia", "o meu pai trabalhava muito na rosa dia", 1, 1, 1, 8), ("em mil novecentos e oitenta e cinco", "Em 1985.", 0, 0, 0, 7), ("a b", "", 0, 0, 2, 2), ("", "a", None, None, None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: tuple(r.e) for r in df.select("i", wer.count_edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: tuple(p[2:]) for i, p in enumerate(pairs)}
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("ab cé d".split()) for _ in range(rng.randint(0, 9))), " ".join(rng.choice("ab cé d".split()) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    df = spark.createDataFrame(texts, "i int, a string, b string")
    native = {r.i: r.e for r in df.select("i", wer.word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    assert native == {i: brute(a.split(), b.split()) for i, a, b in texts}
    assert all(sum(wer.edits_py(a.split(), b.split())) == native[i] for i, a, b in texts)


def test_rates(spark):
    df = spark.createDataFrame([("m", "s1", 1, 0, 0, 3), ("m", "s2", 2, 0, 0, 100)], "model_key string, speaker_code string, substitutions long, insertions long, deletions long, n_reference_words long")
    r = wer.rates(df, ["model_key"]).first()
    assert r.wer_pooled == pytest.approx(3 / 103) and r.wer_macro == pytest.approx((1 / 3 + 2 / 100) / 2)
    hyp = spark.createDataFrame([("w1", "m", "x"), ("w2", "m", "x"), ("w3", "m", "x")], "window_id string, model_key string, text string")
    ref = spark.createDataFrame([("w1", "x", "s"), ("w2", "hum", "s")], "window_id string, reference_text string, speaker_code string")
    assert {r.window_id: r.drop_reason for r in wer.records(hyp, ref).collect()} == {"w1": None, "w2": wer.EMPTY_REFERENCE, "w3": wer.NO_REFERENCE}


# ---- items

def test_validation_reasons():
    ok = {"question": "q", "alternatives": [{"text": str(i), "is_correct": i == 0, "source_window_id": "t" if i == 0 else "c"} for i in range(4)]}
    why = lambda **k: items.item_reason_py(ok | k, 4, "t", {"c"}, True)
    alt = lambda i, **k: [a | (k if j == i else {}) for j, a in enumerate(ok["alternatives"])]
    assert why() is None and why(question=" ") == "pergunta_vazia" and why(alternatives=[]) == "n_alternativas_incorreto"
    assert why(alternatives=alt(1, is_correct=1)) == "corretas_diferente_de_uma" and why(alternatives=alt(1, text=" ")) == "alternativa_vazia"
    assert why(alternatives=alt(2, text=" 1 ")) == "alternativas_duplicadas" and why(alternatives=alt(2, source_window_id=None)) == "distrator_sem_proveniencia"
    assert why(alternatives=alt(0, source_window_id="c")) == "proveniencia_desconhecida" and items.item_reason_py([], 4, "t", {"c"}, True) == "envelope_json_invalido"
    assert items.envelope_py("```json\n{\"items\": []}\n```") == ([], None) and items.envelope_py("[1]")[1] == "envelope_json_invalido"


def test_context_and_pilot_draws(spark):
    w = spark.createDataFrame([("s", f"w{i}", "NE", 30) for i in range(9)] + [("z", "w", "NE", 30)], "speaker_code string, window_id string, region string, age int")
    for numpy_draws in (False, True):
        got = {r.window_id: list(r.context) for r in items.context_windows(w, 3, 5, numpy_draws).collect()}
        assert got["w"] == [] and all(len(set(c)) == 3 and k not in c and c == sorted(c) for k, c in got.items() if k != "w")
    pool = [f"w{i}" for i in range(1, 9)]
    assert got["w0"] == sorted(pool[int(i)] for i in derived_generator(5, "context", "w0").choice(8, size=3, replace=False))
    for numpy_draws in (False, True):
        assert items.pilot_speakers(w, 1, ["NE"], 20, 69, 5, numpy_draws).count() == 1


def test_filter_and_review(spark):
    runs = spark.createDataFrame([("i1", "m", "A", "A"), ("i1", "m", "(a)", "A"), ("i1", "n", "B", "A"), ("i2", "m", "A", "A"), ("i2", "m", "?", "A")], "item_id string, model_key string, raw_text string, correct_label string")
    got = {r.item_id: (r.filter_status, r.filter_reason) for r in items.filter_decisions(items.filter_runs(runs)).collect()}
    assert got == {"i1": ("discarded", items.ANSWERABLE + ": m=2/2"), "i2": ("kept", None)}
    assert len(items.sheet_columns(4)) == 24
    listed = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "item_id string")
    bad = spark.createDataFrame([("i1", "accepted", "", "1"), ("i1", "accepted", "", "1"), ("i2", "rejected", "", "-1"), ("i9", "x", "", "a")], "item_id string, decision string, reason string, minutes string")
    found = {(r.item_id, r.problem) for r in items.review_problems(bad, listed).collect()}
    assert {("i1", "item_duplicado"), ("i2", "rejeicao_sem_motivo"), ("i2", "minutos_invalidos"), ("i3", "item_nao_revisado"), ("i9", "item_desconhecido"), ("i9", "decisao_fora_do_vocabulario")} <= found
    with pytest.raises(Exception, match="problems"):
        items.reviewed(listed, bad).collect()


# ---- evaluation

def test_answers_retry_and_cache(spark, tmp_path):
    slept = []
    calls = iter([RuntimeError("x"), RuntimeError("y"), "ok"])

    def call(_):
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert runner.with_retry(call, 3, slept.append)("p") == "ok" and slept == [0.5, 1.0]
    rows = spark.createDataFrame([("k1", "i", "m", "asr", "p", None), ("k2", "i", "m", "asr", "boom", None), ("k3", "i", "m", "asr", None, "insumo_ausente: asr")], "cache_key string, item_id string, model_key string, condition string, prompt string, error string")

    def client():
        def answer(prompt):
            if prompt == "boom":
                raise OSError("no")
            return "A"

        return answer

    done = {r.cache_key: (r.raw_text, r.error) for r in runner.answered(rows, client, 0).collect()}
    assert done == {"k1": ("A", None), "k2": (None, "OSError: no"), "k3": (None, "insumo_ausente: asr")}
    path = str(tmp_path / "cache")
    full = runner.answered(rows, client, 0)
    for _ in range(2):
        cache.append_new(full, path)
    assert [r.cache_key for r in spark.read.parquet(path).collect()] == ["k1"]


def test_streamed_cache(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    schema = "cache_key string, item_id string, model_key string, condition string, raw_text string, error string"
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({"cache_key": f"k{i % 2}", "item_id": "i", "model_key": "m", "condition": "asr", "raw_text": "A"}) + "\n")
        cache.stream_to_cache(cache.read_answers(spark, str(source), schema), path, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.cache_key for r in spark.read.parquet(path).collect()) == ["k0", "k1"]


def test_scores_are_three_valued(spark):
    r = spark.createDataFrame([("m", "asr", "A", None, "A"), ("m", "asr", "??", None, "A"), ("m", "asr", None, "asr_falhou: x", "A"), ("m", "asr", "B", None, "A")], "model_key string, condition string, raw_text string, error string, correct_label string")
    s = runner.cell_stats(runner.scored(r)).first()
    assert (s.n, s.n_errors, s.n_unparsed, s.n_correct) == (4, 1, 1, 1) and s.accuracy == 0.5 and s.unparsed_rate == pytest.approx(1 / 3)


# ---- analysis

def homogeneous(spark, ne=14, se=16):
    rows = [(f"{r}{i:02d}_{k}", f"{r}{i:02d}", "m", c, r, 30 + i % 5, "F" if i % 2 else "M", k < (ne if r == "NE" else se)) for r, n in (("NE", 12), ("SE", 24)) for i in range(n) for k in range(20) for c in ("asr", "reference")]
    return spark.createDataFrame(rows, "item_id string, speaker_code string, model_key string, condition string, region string, age int, speaker_gender string, is_correct boolean")


def test_gap_of_equal_speakers(spark):
    rows = homogeneous(spark)
    got = analysis.gap_table(rows, analysis.resamples(rows, 30, 1)).where("condition = 'asr'").first()
    assert got.gap == pytest.approx(-0.10, abs=1e-9) and got.ci_low == pytest.approx(-0.10, abs=1e-9) and got.ci_high == pytest.approx(-0.10, abs=1e-9)
    x = np.array([[1, 1.0], [1, 0]])
    assert analysis.fit_logit(x, np.array([14.0, 16]), np.array([20.0, 20]))[1] == pytest.approx(-0.5389965, abs=1e-6)
    assert analysis.fit_logit(x, np.array([20.0, 20]), np.array([20.0, 20])) is None
    assert analysis.fit_logit(np.ones((2, 2)), np.array([1.0, 2]), np.array([4.0, 4])) is None
    sep = np.array([[1, 1.0], [1, 0]])
    assert analysis.fit_logit(sep, np.array([20.0, 0]), np.array([20.0, 20])) is None


def test_draws_keep_strata(spark):
    rows = homogeneous(spark)
    people = rows.select("speaker_code", "region").distinct()
    for draws in (analysis.resamples(rows, 20, 3).join(people, "speaker_code"), analysis.hashed_resamples(rows, 20, 3)):
        assert {(r.region, r.n) for r in analysis.stratum_sizes(draws).collect()} == {("NE", 12), ("SE", 24)}
    with pytest.raises(ValueError):
        analysis.resamples(spark.createDataFrame([("a", "NE"), ("a", "SE")], "speaker_code string, region string"), 2, 1)


def test_decomposition_adds_up(spark):
    rows = homogeneous(spark)
    table = analysis.decomposition(rows, analysis.resamples(rows, 10, 1))
    assert table.count() == 3 and analysis.check_identity(table).count() == 0
    assert all(r.delta_asr == pytest.approx(0) for r in table.collect())
    half = rows.where("not (condition = 'reference' and item_id rlike '_1$')")
    assert analysis.paired(half).count() == rows.count() - 2 * 36


def test_trial_reasons_and_subsample(spark):
    r = spark.createDataFrame([("i", "a", "m", "asr", None), ("j", "zz", "m", "asr", True), ("k", "b", "m", "asr", True), ("l", "a", "m", "asr", True)], "item_id string, speaker_code string, model_key string, condition string, is_correct boolean")
    s = spark.createDataFrame([("a", "NE", 30, "F"), ("b", "XX", 30, "F")], "speaker_code string, region string, age int, speaker_gender string")
    got = {x.item_id: x.drop_reason for x in analysis.trials(r, s).collect()}
    assert got == {"i": analysis.UNREADABLE, "j": analysis.NO_SPEAKER, "k": "região fora de escopo (XX)", "l": None}
    rows = homogeneous(spark)
    for numpy_draws in (False, True):
        per = analysis.subsample_items(rows, 3, 1, numpy_draws).groupBy("speaker_code").agg(F.count_distinct("item_id").alias("n"), F.count("*").alias("rows")).collect()
        assert all(p.n == 3 and p.rows == 6 for p in per)


# ---- audio, sources, reports

def test_audio(spark):
    tone = np.sin(np.arange(8000) / 20)
    wav = audio.wav_bytes(tone, 8000)
    assert len(audio.resample(*audio.samples_of(wav))) == 16000
    segs = spark.createDataFrame([("a", bytearray(wav)), ("b", bytearray(wav)), ("c", bytearray(b"no"))], "file_path string, audio binary")
    win = spark.createDataFrame([("w1", ["a", "b"]), ("w2", ["a", "zz"]), ("w3", ["c"])], "window_id string, segments array<string>")
    made = audio.materialize_windows(win, segs)
    got = {r.window_id: r for r in made.collect()}
    assert (got["w1"].status, got["w1"].n_samples) == ("ok", 32000) and got["w2"].status == audio.MISSING and got["w3"].status == audio.UNDECODABLE
    assert got["w1"].sha256 == hashlib.sha256(bytes(got["w1"].wav)).hexdigest()
    assert [r.segment_file_paths for r in audio.manifest(made, win).collect()] == ["a;b", "a;zz", "c"]


def test_apportionment(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 9) if g else 0) for g in range(4) for i in range(7)]
    df = spark.createDataFrame(rows, "g int, i int, w long")
    for r in audio.apportion(df, ["g"], "w", F.lit(1000.0), "i").groupBy("g").agg(F.sum("share").alias("s")).collect():
        assert r.s == (1000 if r.g else 0)


def test_files(spark, tmp_path):
    root = tmp_path / "c"
    root.mkdir()
    for split, n in (("train", 3), ("test", 2)):
        pd.DataFrame({"k": range(n), "audio": [b"x" * 5000] * n}).to_parquet(root / f"{split}-00000.parquet")
    meta = corpus.read_metadata(spark, str(root), ["train", "test"])
    assert {(r.split, r.n_rows) for r in corpus.split_counts(meta).collect()} == {("train", 3), ("test", 2)} and "audio" not in meta.columns
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_metadata(spark, str(root), ["none"])
    foot = corpus.footprint(spark, str(root))
    assert {r["column"]: r.is_read for r in foot.collect()} == {"k": True, "audio": False}
    rows = spark.createDataFrame([(2, "é"), (1, None)], "b int, a string")
    files.write_jsonl(rows, str(tmp_path / "j"), ["b"])
    files.write_jsonl(rows, str(tmp_path / "j"), ["b"], append=True)
    assert sorted((r.b, r.a or "") for r in files.read_jsonl(spark, str(tmp_path / "j"), "b int, a string").collect()) == [(1, ""), (1, ""), (2, "é"), (2, "é")]
    files.write_csv(rows, str(tmp_path / "v"), ["b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).count() == 2
    one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in files.WINDOW_SCHEMA])
    files.write_windows(one, str(tmp_path / "w"), {"sha": "x"})
    back, provenance = files.read_windows(spark, str(tmp_path / "w"))
    assert back.schema == files.WINDOW_SCHEMA and provenance == {"sha": "x"} and back.count() == 1
    assert "| 1 | - |" in reports.table(rows, ["b"]) and reports.report("T", [("S", "x")]).startswith("# T")


def test_config():
    assert config.from_mapping(config.AnalysisConfig, {"age_range": [18, 30]}).age_range == (18, 30)
    for kind, bad in ((config.AnalysisConfig, {"covariates": ["age"]}), (config.WindowsConfig, {"interviewer_turn": "x"}), (config.ItemsConfig, {"discard_if_correct_at_least": 9}), (config.EvalConfig, {"nope": 1})):
        with pytest.raises(ValueError):
            config.from_mapping(kind, bad)
    with pytest.raises(ValueError):
        config.assert_contamination_checked(False, config.EvalConfig())
    spec = config.ModelSpec("k", "p", "id", "text_qa")
    config.assert_no_placeholders([spec])
    with pytest.raises(ValueError):
        config.assert_generator_not_evaluated(config.ItemsConfig(generator="id"), [spec])
