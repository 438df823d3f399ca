"""Audit operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.analysis import restrict_age
from ..operators.ledger import ledger
from ..operators.windows import scope
from .bindings import REGION_MAP, SPEAKERS, SPOKEN, segments, speakers, spoken, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
_COUNTS = "CAST(count(DISTINCT speaker_code) AS BIGINT) AS n_speakers, count(*) AS n_segments, round_even(sum(duration) / 3600, 4) AS hours"
_BUCKET = "CASE WHEN age >= 16 AND age < 25 THEN '16-24' WHEN age >= 25 AND age < 35 THEN '25-34' WHEN age >= 35 AND age < 45 THEN '35-44' WHEN age >= 45 AND age < 60 THEN '45-59' WHEN age >= 60 AND age < 120 THEN '60-119' ELSE 'fora_das_bordas' END"
_SPREAD = "min({0}) AS min, round_even(quantile_cont({0}, 0.25), 4) AS q1, round_even(quantile_cont({0}, 0.5), 4) AS median, round_even(quantile_cont({0}, 0.75), 4) AS q3, max({0}) AS max, round_even(avg({0}), 4) AS mean"


@query(f"WITH {SPOKEN} SELECT birth_state, region, {_COUNTS} FROM spoken GROUP BY ALL")
def audit_counts_by_state(spark, d):
    return A.counts(spoken(spark, d), ["birth_state", "region"])


@query(f"WITH {SPOKEN}, s AS (SELECT birth_state, region, {_COUNTS} FROM spoken GROUP BY ALL) SELECT region, CAST(sum(n_speakers) AS BIGINT) AS n_speakers, CAST(sum(n_segments) AS BIGINT) AS n_segments FROM s GROUP BY region")
def audit_region_totals(spark, d):
    return A.region_totals(audit_counts_by_state(spark, d))


@query(f"WITH {SPOKEN} SELECT region, {_BUCKET} AS bucket, {_COUNTS} FROM spoken GROUP BY ALL")
def audit_age_crosstab(spark, d):
    return A.counts(spoken(spark, d), ["region", A.age_bucket(F.col("age")).alias("bucket")])


@query(f"WITH {SPOKEN} SELECT region, age, {_COUNTS} FROM spoken GROUP BY ALL")
def audit_age_distribution(spark, d):
    return A.counts(spoken(spark, d), ["region", "age"])


@query(f"SELECT l_returnflag, {_SPREAD.format('l_quantity')} FROM lineitem GROUP BY l_returnflag")
def audit_describe(spark, d):
    return A.describe(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query('SELECT count(DISTINCT o_custkey) AS "single", count(DISTINCT (o_custkey, o_orderstatus)) AS composite FROM orders')
def audit_key_candidates(spark, d):
    return A.key_candidates(table(spark, d, "orders"), "o_custkey", ["o_custkey", "o_orderstatus"])


@query("SELECT count(*) AS n_overlapping FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)")
def audit_split_overlap(spark, d):
    return A.split_overlap(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT o_custkey, count(*) AS n_segments, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(DISTINCT o_orderstatus) AS n_o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY o_custkey")
def audit_speaker_table(spark, d):
    return A.speaker_table(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], F.col("o_orderkey"))


@query("""WITH v AS (SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS a, count(DISTINCT o_orderpriority) > 1 AS b FROM orders GROUP BY 1),
u AS (SELECT 'o_orderstatus' AS attribute, o_custkey AS w, a AS bad FROM v UNION ALL SELECT 'o_orderpriority', o_custkey, b FROM v)
SELECT attribute, count(*) FILTER (bad) AS n_violations, coalesce(array_to_string(list_sort(list(w) FILTER (bad))[1:5], ','), '') AS examples FROM u GROUP BY attribute""")
def audit_one_to_one(spark, d):
    out = A.one_to_one(audit_speaker_table(spark, d), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"n_F\", count(*) FILTER (l_linestatus = 'O') AS \"n_O\", count(*) AS total, count(DISTINCT l_suppkey) AS n_speakers, count(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS n_speakers_low, round_even(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 4) AS pct_low FROM lineitem GROUP BY l_returnflag")
def audit_quality_by_region(spark, d):
    return A.quality_by_region(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "F", "l_suppkey")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders GROUP BY 1")
def audit_pivot(spark, d):
    return A.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(f"""WITH {SPEAKERS}, n AS (SELECT region, speaker_gender, count(*) AS n FROM speakers WHERE age < 40 GROUP BY ALL), c AS (SELECT DISTINCT speaker_gender FROM speakers), r AS (SELECT DISTINCT region FROM n)
SELECT r.region, c.speaker_gender, coalesce(n.n, 0) AS n FROM r CROSS JOIN c LEFT JOIN n ON n.region = r.region AND n.speaker_gender = c.speaker_gender""")
def audit_category_by_region(spark, d):
    s = speakers(spark, d)
    return A.category_by_region(s.where("age < 40"), "region", "speaker_gender", s.select("speaker_gender"))


@query(f"WITH {SPOKEN}, t AS (SELECT speaker_code, region, count(*) AS n FROM spoken GROUP BY ALL) SELECT region, count(*) AS n_speakers, min(n) AS min, round_even(quantile_cont(n, 0.5), 2) AS median, round_even(avg(n), 2) AS mean, max(n) AS max, CAST(sum(n) AS BIGINT) AS total, round_even(max(n) / sum(n), 4) AS max_share FROM t GROUP BY region")
def audit_segments_per_speaker(spark, d):
    return A.segments_per_speaker(spoken(spark, d).groupBy("speaker_code", "region").agg(F.count("*").alias("n_segments")), "region")


@query(f"WITH {SPEAKERS} SELECT region, count(*) AS n_speakers, round_even(quantile_cont(age, 0.5), 1) AS median_age, round_even(avg(age), 1) AS mean_age FROM speakers GROUP BY region")
def audit_age_stats(spark, d):
    return A.age_stats(speakers(spark, d), "region")


@query(f"WITH {SPEAKERS} SELECT CASE WHEN grouping(region) = 1 THEN 'geral' ELSE region END AS region, count(*) AS n, count(*) FILTER (speaker_gender = 'MACHINERY') AS n_unknown, round_even(100.0 * count(*) FILTER (speaker_gender = 'MACHINERY') / count(*), 4) AS pct_unknown FROM speakers GROUP BY ROLLUP (region)")
def audit_unknown_coverage(spark, d):
    return A.unknown_coverage(speakers(spark, d), "region", "speaker_gender", "MACHINERY")


@query("""SELECT 'n_nationkey' AS "column", 'int' AS type, count(*) FILTER (n_nationkey IS NULL) AS n_null, 0.0 AS pct_null, NULL AS "values" FROM nation
UNION ALL SELECT 'n_name', 'string', count(*) FILTER (n_name IS NULL), 0.0, NULL FROM nation
UNION ALL SELECT 'n_regionkey', 'int', (SELECT count(*) FILTER (n_regionkey IS NULL) FROM nation), 0.0, string_agg(k || '=' || n, '; ' ORDER BY n DESC, k) FROM (SELECT CAST(n_regionkey AS VARCHAR) AS k, count(*) AS n FROM nation GROUP BY 1)""")
def audit_schema_report(spark, d):
    return A.schema_report(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"])


@query(f"""WITH m AS (SELECT {_SPREAD.format('CAST(o_totalprice AS DOUBLE)')} FROM orders), p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT {_SPREAD.format('CAST(n AS DOUBLE)')} FROM p)
SELECT 'sentinels' AS section, 'status_p' AS key, CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'audio_quality', o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'duration', name, value FROM (UNPIVOT m ON min, q1, median, q3, max, mean)
UNION ALL SELECT 'segments_per_speaker', name, value FROM (UNPIVOT q ON min, q1, median, q3, max, mean)""")
def audit_data_quality(spark, d):
    return A.data_quality(table(spark, d, "orders"), {"status_p": F.col("o_orderstatus") == "P"}, "o_orderpriority", "o_totalprice", "o_custkey")


@query(f"WITH {SPOKEN}, s AS (SELECT birth_state, count(DISTINCT speaker_code) AS n_speakers FROM spoken WHERE region = 'NE' GROUP BY 1) SELECT k AS birth_state, n_speakers, n_speakers IS NOT NULL AS present FROM (SELECT CAST(unnest(range(9)) AS VARCHAR) AS k) LEFT JOIN s ON birth_state = k")
def audit_region_presence(spark, d):
    return A.region_presence(audit_counts_by_state(spark, d), REGION_MAP, "NE").select("birth_state", "n_speakers", "present")


@query("SELECT event_type AS speaker_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def audit_non_informants(spark, d):
    return A.informants(segments(spark, d), informant="click")[1]


@query(f"WITH {SPOKEN} SELECT CASE WHEN region NOT IN ('NE', 'SE') THEN 'regiao_fora_do_escopo' WHEN age NOT BETWEEN 20 AND 69 THEN 'idade_fora_da_faixa' ELSE 'kept' END AS reason, count(*) AS n FROM spoken GROUP BY 1")
def audit_scope_ledger(spark, d):
    return ledger(scope(spoken(spark, d), "region", "age", ["NE", "SE"], 20, 69))


@query(f"WITH {SPEAKERS} SELECT CASE WHEN age < 20 THEN 'idade < 20' WHEN age > 69 THEN 'idade > 69' ELSE 'kept' END AS reason, count(*) AS n FROM speakers GROUP BY 1")
def audit_age_ledger(spark, d):
    return ledger(restrict_age(speakers(spark, d), 20, 69))
