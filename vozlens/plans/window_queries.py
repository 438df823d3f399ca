"""Turns, runs, packing and choice of windows over ``events``: a gap of 12 hours, 2 to 5 events and 60 to 300 seconds a window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.audio import apportion, coalesce_ranges, group_bounds, plan, rows_to_groups
from ..operators.runner import latest
from .bindings import SEED, SEGMENTS, segments, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
GAP, PACK, TARGET = 43_200.0, {"least": 2, "most": 5, "low": 60.0, "high": 300.0}, 4

_TURNS = SEGMENTS + """, ranked AS (
  SELECT *, speaker_type <> 'error' AS inf, sum(CASE WHEN speaker_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY audio_name ORDER BY start_time, file_path) AS r FROM segments
), slots AS (SELECT audio_name, r, sum(duration) AS s, count(*) AS t FROM ranked WHERE NOT inf GROUP BY ALL),
turns AS (SELECT i.*, coalesce(s, 0.0) AS seconds_before, coalesce(t, 0) AS turns_before FROM ranked i LEFT JOIN slots o ON o.audio_name = i.audio_name AND o.r = i.r - 1 WHERE inf)"""
_RUNS = _TURNS + """, lagged AS (
  SELECT *, lag(end_time) OVER w AS pe, lag(audio_name) OVER w AS pa, row_number() OVER w AS n FROM turns WINDOW w AS (PARTITION BY speaker_code ORDER BY audio_name, start_time, file_path)
), broken AS (
  SELECT *, turns_before > 0 AND n > 1 AND pa = audio_name AS observed, CASE WHEN n = 1 THEN 'first' WHEN pa <> audio_name THEN 'troca_de_gravacao' WHEN {turn} start_time - pe - seconds_before > 43200 THEN 'lacuna_temporal' END AS break_reason FROM lagged
), runs AS (SELECT *, CAST(sum(CASE WHEN break_reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY speaker_code ORDER BY audio_name, start_time, file_path) - 1 AS BIGINT) AS run FROM broken)"""
_CLOSED = _RUNS.replace("{turn}", "turns_before > 0 THEN 'turno_de_entrevistador' WHEN")
_OPEN = _RUNS.replace("{turn}", "")
_PACK = "RECURSIVE " + _OPEN + """, placed AS (
  SELECT speaker_code, run, row_number() OVER w - 1 AS pos, duration, """ + ", ".join(f"CASE WHEN lead(duration, {n - 1}) OVER w IS NOT NULL THEN " + " + ".join(["duration", *[f"lead(duration, {k}) OVER w" for k in range(1, n)]]) + f" END AS s{n}" for n in range(2, 6)) + """
  FROM runs WINDOW w AS (PARTITION BY speaker_code, run ORDER BY audio_name, start_time, file_path)
), cells AS (
  SELECT speaker_code, run, pos, CASE """ + " ".join(f"WHEN s{n} >= 60 THEN CASE WHEN s{n} <= 300 THEN {n} END" for n in range(2, 6)) + """ END AS length FROM placed
), ok AS (SELECT * FROM cells WHERE length IS NOT NULL),
nexts AS (SELECT a.speaker_code, a.run, a.pos, a.length, min(b.pos) AS nxt FROM ok a LEFT JOIN ok b ON a.speaker_code = b.speaker_code AND a.run = b.run AND b.pos >= a.pos + a.length GROUP BY ALL),
greedy AS (
  SELECT * FROM nexts n WHERE pos = (SELECT min(pos) FROM ok WHERE ok.speaker_code = n.speaker_code AND ok.run = n.run)
  UNION ALL SELECT n.* FROM greedy g JOIN nexts n ON n.speaker_code = g.speaker_code AND n.run = g.run AND n.pos = g.nxt
), packed AS (SELECT speaker_code, run, CAST(pos AS INTEGER) AS pos, CAST(length AS INTEGER) AS length FROM greedy)"""
_CHOSEN = _PACK + f""", numbered AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY speaker_code) AS n_candidates, ntile({TARGET}) OVER w - 1 AS nt FROM packed WINDOW w AS (PARTITION BY speaker_code ORDER BY run, pos)
), blocked AS (SELECT *, CASE WHEN n_candidates <= {TARGET} THEN ordinal ELSE nt END AS block FROM numbered),
chosen AS (SELECT *, row_number() OVER (PARTITION BY speaker_code, block ORDER BY sha256('{SEED}:' || speaker_code || ':' || ordinal)) = 1 AS drawn FROM blocked)"""
_BUILT = _CHOSEN + """, picked AS (SELECT *, row_number() OVER (PARTITION BY speaker_code ORDER BY ordinal) AS number FROM chosen WHERE drawn),
atrun AS (SELECT *, row_number() OVER (PARTITION BY speaker_code, run ORDER BY audio_name, start_time, file_path) - 1 AS at FROM runs)"""


def _turns(spark, d):
    return W.mark_turns(segments(spark, d), F.col("speaker_type") != "error")


def _runs(spark, d, close=False):
    return W.assign_runs(_turns(spark, d), GAP, close)


def _chosen(spark, d):
    return W.choose(W.pack_runs(_runs(spark, d), **PACK), TARGET, SEED)


@query(f"WITH {_TURNS} SELECT file_path, round(seconds_before, 6) AS seconds_before, turns_before FROM turns")
def windows_turns(spark, d):
    return _turns(spark, d).select("file_path", F.round("seconds_before", 6).alias("seconds_before"), "turns_before")


@query(f"WITH {_CLOSED} SELECT file_path, run, break_reason FROM runs")
def windows_runs(spark, d):
    return _runs(spark, d, True).select("file_path", "run", "break_reason")


@query(f"WITH {_CLOSED} SELECT count(*) FILTER (break_reason = 'troca_de_gravacao') AS n_recording, count(*) FILTER (break_reason = 'turno_de_entrevistador') AS n_turn, count(*) FILTER (break_reason = 'lacuna_temporal') AS n_gap, count(*) FILTER (break_reason = 'first') AS n_speakers, count(break_reason) AS n_runs, count(*) FILTER (observed) AS n_observed_turns FROM runs")
def windows_break_tally(spark, d):
    return W.break_tally(_runs(spark, d, True))


@query(f"WITH {_PACK} SELECT * FROM packed")
def windows_pack(spark, d):
    return W.pack_runs(_runs(spark, d), **PACK)


@query(f"WITH {_CHOSEN} SELECT speaker_code, run, pos, CAST(ordinal AS INTEGER) AS ordinal, n_candidates, CAST(block AS INTEGER) AS block, drawn FROM chosen")
def windows_choose(spark, d):
    return _chosen(spark, d).select("speaker_code", "run", "pos", "ordinal", "n_candidates", "block", "drawn")


@query(f"""WITH {_BUILT} SELECT printf('%s__w%02d', CAST(p.speaker_code AS VARCHAR), p.number) AS window_id, string_agg(r.file_path, ';' ORDER BY r.at) AS segments, round(sum(r.duration), 4) AS duration_s, count(*) AS n_segments,
string_agg(r.speaker_type, ' ' ORDER BY r.at) AS reference_text, CAST(p.block AS BIGINT) AS position_index, p.n_candidates,
substr(sha256('{{"reference_text":"' || string_agg(r.speaker_type, ' ' ORDER BY r.at) || '","segments":[' || string_agg('"' || r.file_path || '"', ',' ORDER BY r.at) || ']}}'), 1, 12) AS content_sha
FROM picked p JOIN atrun r ON r.speaker_code = p.speaker_code AND r.run = p.run AND r.at >= p.pos AND r.at < p.pos + p.length GROUP BY p.speaker_code, p.number, p.block, p.n_candidates""")
def windows_build(spark, d):
    out = W.build(_runs(spark, d), _chosen(spark, d), TARGET)
    return out.select("window_id", F.array_join(F.col("segments").cast("array<string>"), ";").alias("segments"), F.round("duration_s", 4).alias("duration_s"), "n_segments", "reference_text", "position_index", "n_candidates", "content_sha")


@query(f"WITH {_CHOSEN}, n AS (SELECT count(*) FILTER (drawn) AS n_windows FROM chosen GROUP BY speaker_code) SELECT n_windows, count(*) AS n FROM n GROUP BY 1")
def windows_histogram(spark, d):
    return W.histogram(_chosen(spark, d).groupBy("speaker_code").agg(F.count_if("drawn").alias("n_windows")), "n_windows")


@query(f"WITH {_CHOSEN} SELECT CASE WHEN drawn THEN 'kept' ELSE 'candidata_nao_sorteada' END AS reason, count(*) AS n FROM chosen GROUP BY 1")
def windows_candidate_ledger(spark, d):
    from ..operators.ledger import ledger, tagged

    return ledger(tagged(_chosen(spark, d), [(~F.col("drawn"), W.NOT_DRAWN)]))


@query("""WITH r AS (SELECT l_suppkey AS shard, l_partkey * 10 AS low, CAST(l_partkey * 10 + l_quantity AS BIGINT) AS high FROM lineitem),
m AS (SELECT *, max(high) OVER (PARTITION BY shard ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN low - reach < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY low, high ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
SELECT shard, CAST(island AS BIGINT) AS island, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY shard, island""")
def ranges_coalesced(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shard"), (F.col("l_partkey") * 10).alias("low"), (F.col("l_partkey") * 10 + F.col("l_quantity")).cast("long").alias("high"))
    return coalesce_ranges(r, ["shard"], "low", "high", 20)


def _bounds(spark, d):
    return group_bounds(table(spark, d, "part").groupBy(F.col("p_brand").alias("shard"), F.col("p_size").alias("row_group")).agg(F.count("*").alias("n")), "shard", "row_group", "n")


_BOUNDS = "g AS (SELECT p_brand AS shard, p_size AS row_group, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY shard ORDER BY row_group ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS row_from, CAST(sum(n) OVER (PARTITION BY shard ORDER BY row_group ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_to FROM g)"


@query(f"WITH {_BOUNDS} SELECT shard, row_group, n, row_from, row_to FROM b")
def shard_group_bounds(spark, d):
    return _bounds(spark, d)


@query(f"WITH {_BOUNDS}, r AS (SELECT p_partkey, p_brand AS shard, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row FROM part) SELECT r.shard, p_partkey, CAST(row AS INTEGER) AS row, row_group FROM r JOIN b ON r.shard = b.shard AND row >= row_from AND row < row_to")
def shard_rows_to_groups(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("shard"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("row"))
    return rows_to_groups(rows, _bounds(spark, d), "shard", "row", "row_group")


@query("SELECT p_brand AS shard, p_size AS row_group, count(DISTINCT p_partkey) AS n_wanted FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
def shard_plan(spark, d):
    index = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("shard"), F.col("p_size").alias("row_group"))
    return plan(index, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key")), "key", "shard", "row_group")[0]


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def shard_plan_missing(spark, d):
    index = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return plan(index.withColumns({"shard": F.lit(0), "row_group": F.lit(0)}), table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", "shard", "row_group")[1]


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey) AS a FROM lineitem),
x AS (SELECT *, 100000.0::DOUBLE * q / a AS e FROM w), f AS (SELECT *, CAST(floor(e) AS BIGINT) AS fl, 100000 - sum(CAST(floor(e) AS BIGINT)) OVER (PARTITION BY l_suppkey) AS rest FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY e - fl DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM f)
SELECT l_suppkey, CAST(sum(fl + CASE WHEN r <= rest THEN 1 ELSE 0 END) AS BIGINT) AS total, CAST(max(fl + CASE WHEN r <= rest THEN 1 ELSE 0 END) AS BIGINT) AS largest FROM z GROUP BY 1""")
def bytes_apportioned(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.col("l_quantity").cast("long").alias("q"))
    out = apportion(rows, ["l_suppkey"], "q", F.lit(100000.0), "o")
    return out.groupBy("l_suppkey").agg(F.sum("share").alias("total"), F.max("share").alias("largest"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def cache_latest(spark, d):
    return latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")
