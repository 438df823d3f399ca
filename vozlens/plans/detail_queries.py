"""Smaller operators over the driver's tables: checked joins, typed payloads, prompts, formats, sessions, other statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import statistics
from ..operators import analysis as S
from ..operators.audio import required_keys
from ..operators.audit import region_order
from ..operators.items import answer_prompt
from ..operators.ledger import joined_whole, manifest_ledger
from ..sources.files import first_windows, typed
from ..streaming.cache import stream_sessions
from .bindings import SEED, SPEAKERS, TRIALS, records, speakers, table
from .evaluation_queries import _DRAWS, DRAWS, _draws
from .registry import registry
from .window_queries import _BUILT, windows_build

QUERIES, ORACLE_SQL, query = registry()


# ---- sources and joins

@query(f"WITH {SPEAKERS} SELECT o_orderkey, speaker_code, region FROM orders JOIN speakers ON speaker_code = o_custkey")
def audit_joined_whole(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("speaker_code"))
    return joined_whole(orders, speakers(spark, d).select("speaker_code", "region"), "speaker_code").select("o_orderkey", "speaker_code", "region")


@query(f"WITH {SPEAKERS} SELECT DISTINCT region, CASE region WHEN 'SE' THEN 0 WHEN 'NE' THEN 1 ELSE 2 END AS rank FROM speakers")
def audit_region_order(spark, d):
    return speakers(spark, d).select("region", region_order(F.col("region"), ("SE", "NE"))[0].alias("rank")).distinct()


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '?') AS label, o_custkey AS n FROM orders")
def source_typed_payload(spark, d):
    """Rows made again from JSON, with defaults for what it lacks."""
    o = table(spark, d, "orders")
    raw = o.select("o_orderkey", F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"), F.col("o_custkey").alias("n"))).alias("raw"))
    return typed(raw, "raw", T.StructType.fromDDL("label string, n long"), {"label": "?"})


@query("SELECT event_id AS window_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 40)")
def source_first_windows(spark, d):
    """A limited run: the first windows in canonical order."""
    return first_windows(table(spark, d, "events").select(F.col("event_id").alias("window_id"), "event_type"), 40)


@query(f"WITH {_BUILT} SELECT DISTINCT r.file_path FROM picked p JOIN atrun r ON r.speaker_code = p.speaker_code AND r.run = p.run AND r.at >= p.pos AND r.at < p.pos + p.length")
def audio_required_keys(spark, d):
    windows = windows_build(spark, d).select(F.split("segments", ";").cast("array<long>").alias("segments"))
    return required_keys(windows)


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
def audio_manifest_ledger(spark, d):
    return manifest_ledger(table(spark, d, "orders"), "o_orderstatus")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN t - p <= 43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS low, max(t) + 43200000000 AS high, count(*) AS n_segments FROM s GROUP BY user_id, k""")
def windows_sessions(spark, d):
    """Sessions by a gap of 12 hours; the same operator runs over a stream."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = stream_sessions(e, "user_id", "ts", "12 hours", "1 day")
    return out.select("user_id", F.unix_micros("start").alias("low"), F.unix_micros("end").alias("high"), "n_segments")


# ---- prompts, closed forms, formats

_PROMPT = """SELECT o_orderkey, 'Responda à questão de múltipla escolha.' || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN 'TRANSCRIÇÃO DA FALA' || chr(10) || o_orderpriority WHEN 1 THEN 'ÁUDIO' || chr(10) || 'Ouça o áudio anexo.' ELSE 'CONTEXTO' || chr(10) || 'Não há áudio nem transcrição.' END
|| chr(10) || 'PERGUNTA' || chr(10) || 'Qual ' || o_custkey || '?' || chr(10) || 'ALTERNATIVAS' || chr(10) || 'A) ' || o_orderstatus || chr(10) || 'B) ' || o_orderpriority || chr(10) || 'C) nada' || chr(10) || 'Responda apenas com a letra: A, B ou C.' AS prompt FROM orders"""


@query(_PROMPT)
def run_prompts(spark, d):
    o = table(spark, d, "orders")
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    options = F.array(option("A", F.col("o_orderstatus")), option("B", F.col("o_orderpriority")), option("C", F.lit("nada")))
    k = F.col("o_orderkey") % 3
    asked = F.concat(F.lit("Qual "), F.col("o_custkey").cast("string"), F.lit("?"))
    return o.select("o_orderkey", answer_prompt(asked, options, F.when(k == 0, F.col("o_orderpriority")), k == 1).alias("prompt"))


@query("""WITH g AS (SELECT n, k, a FROM (SELECT unnest(range(1, 7)) AS n), (SELECT unnest(range(0, 7)) AS k), (SELECT unnest([2, 4, 5]) AS a) WHERE k <= n),
t AS (SELECT n, k, a, unnest(range(k, n + 1)) AS i FROM g)
SELECT n, k, a, round(sum(factorial(n::INTEGER) / (factorial(i::INTEGER) * factorial((n - i)::INTEGER)) * pow(1.0 / a, i) * pow(1 - 1.0 / a, n - i)), 9) AS p FROM t GROUP BY n, k, a""")
def items_chance(spark, d):
    """Chance of passing the filter by blind guessing, over a grid of runs, bounds and alternatives."""
    rows = [(n, k, a, statistics.chance_pass_probability(n, k, a)) for n in range(1, 7) for k in range(n + 1) for a in (2, 4, 5)]
    return spark.createDataFrame(rows, "n long, k long, a long, p double").withColumn("p", F.round("p", 9))


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25.0))), 12) AS chance FROM part")
def statistics_expit(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(statistics.expit_of(F.col("p_size") - 25.0), 12).alias("chance"))


@query("SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1000), ',', '.') AS whole, translate(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), ',.', '.,') AS number FROM orders")
def report_numbers(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", statistics.br_int_of(F.col("o_orderkey") * 1000).alias("whole"), statistics.br_number_of(F.col("o_totalprice").cast("double")).alias("number"))


# ---- estimation with another statistic

def _gaps(source: str, keys: str) -> str:
    """SQL of a gap table whose statistic is the difference of accuracies, over rows of ``source`` and the draws."""
    side = lambda r, w: f"sum(k{w}) FILTER (s.region = '{r}') / sum(n{w}) FILTER (s.region = '{r}')"
    shown = lambda c: f"round(CASE WHEN gap IS NOT NULL AND n_failed <= 0.05 * {DRAWS} THEN {c} END, 9) AS {c}"
    return f"""s AS (SELECT {keys}, speaker_code, region, sum(CAST(is_correct AS BIGINT)) AS k, count(*) AS n FROM {source} GROUP BY ALL),
q AS (SELECT {keys}, {side('NE', '')} AS "accuracy_NE", {side('SE', '')} AS "accuracy_SE", CAST(sum(n) AS BIGINT) AS n_trials, count(DISTINCT speaker_code) AS n_speakers FROM s GROUP BY ALL),
e AS (SELECT {keys}, b, {side('NE', ' * weight')} - {side('SE', ' * weight')} AS drawn FROM s JOIN draws USING (speaker_code) GROUP BY ALL),
i AS (SELECT {keys}, quantile_cont(drawn, 0.025) AS ci_low, quantile_cont(drawn, 0.975) AS ci_high, {DRAWS} - count(drawn) AS n_failed FROM e GROUP BY ALL),
j AS (SELECT *, "accuracy_NE" - "accuracy_SE" AS gap FROM q JOIN i USING ({keys}))
SELECT {keys}, round("accuracy_NE", 9) AS "accuracy_NE", round("accuracy_SE", 9) AS "accuracy_SE", n_trials, n_speakers, {shown('gap')}, {shown('ci_low')}, {shown('ci_high')}, n_failed, CAST({DRAWS} AS BIGINT) AS n_resamples FROM j"""


def _rounded(out):
    return out.drop("raw_gap", "warning").withColumns({c: F.round(c, 9) for c in ("accuracy_NE", "accuracy_SE", "gap", "ci_low", "ci_high")})


@query(f"WITH {TRIALS}, {_DRAWS}, {_gaps('trials', 'model_key, condition')}")
def analysis_gap_statistic(spark, d):
    """Intervals over speakers for a statistic given by the caller."""
    rows = S.trials(records(spark, d), speakers(spark, d)).where("drop_reason is null")
    return _rounded(S.gap_table(rows, _draws(spark, d), statistic=S.accuracy_gap))


@query(f"""WITH {TRIALS}, {_DRAWS}, p AS (SELECT speaker_code, item_id, row_number() OVER (PARTITION BY speaker_code ORDER BY sha256('{SEED}:' || speaker_code || ':' || item_id)) AS r FROM (SELECT DISTINCT speaker_code, item_id FROM trials)),
v AS (SELECT trials.*, 'n_items' AS axis, CAST(g AS VARCHAR) AS variant FROM trials JOIN p USING (speaker_code, item_id) JOIN (SELECT unnest([3, 8]) AS g) ON r <= g
UNION ALL SELECT *, 'window_duration', CASE WHEN window_duration_s < 30 THEN '[0, 30)' ELSE '[30, 60]' END FROM trials WHERE window_duration_s BETWEEN 0 AND 60
UNION ALL SELECT *, 'n_alternatives', CAST(4 + item_id % 2 AS VARCHAR) FROM trials), {_gaps('v', 'axis, variant, model_key, condition')}""")
def analysis_sensitivity_statistic(spark, d):
    """All three axes of sensitivity."""
    rows = S.trials(records(spark, d), speakers(spark, d)).where("drop_reason is null").withColumn("n_alternatives", 4 + F.col("item_id") % 2)
    return _rounded(S.sensitivity(rows, _draws(spark, d), SEED, (3, 8), (0, 30, 60), by_alternatives=True, statistic=S.accuracy_gap))


@query(f"WITH {TRIALS}, m AS (SELECT model_key, item_id FROM trials GROUP BY ALL HAVING count(DISTINCT condition) = 2), c AS (SELECT DISTINCT model_key, region FROM trials SEMI JOIN m USING (model_key, item_id)), n AS (SELECT count(*) + count(DISTINCT model_key) AS n FROM c) SELECT n AS n_rows, CAST(0 AS BIGINT) AS n_broken, n AS n_broken_elsewhere FROM n")
def analysis_identity(spark, d):
    """Losses add up to the ceiling they were made with, and to no other."""
    rows = S.trials(records(spark, d), speakers(spark, d)).where("drop_reason is null")
    own, other = S.Ceiling("human_sample", 0.9), S.Ceiling()
    made = S.decomposition(rows, _draws(spark, d), own)
    broken = lambda ceiling, name: F.count_if(S.breaks_identity(ceiling)).alias(name)
    return made.agg(F.count("*").alias("n_rows"), broken(own, "n_broken"), broken(other, "n_broken_elsewhere"))  # one pass: the decomposition is planned once


@query("SELECT l_suppkey AS speaker_code, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_strata FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def analysis_stratum_conflicts(spark, d):
    return S.stratum_conflicts(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("speaker_code"), F.col("l_returnflag").alias("region")))
