"""The driver's tables in the roles of a speech corpus, each with the same view as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States are nation keys here: these to the exposed region, those to the baseline, others out of scope.
REGION_MAP = {str(k): "NE" for k in range(9)} | {str(k): "SE" for k in range(9, 17)}
SEED = 20260918


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Events as segments: a user is speaker and recording; ``error`` events are an interviewer's."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("speaker_code"), F.col("user_id").alias("audio_name"), F.col("event_id").alias("file_path"), start.alias("start_time"), (start + F.col("value")).alias("end_time"), F.col("value").alias("duration"), F.col("event_type").alias("speaker_type"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("normalized_text"))


SEGMENTS = """segments AS (
  SELECT user_id AS speaker_code, user_id AS audio_name, event_id AS file_path, epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value AS end_time,
         value AS duration, event_type AS speaker_type FROM events)"""

_NE, _SE = (", ".join(k for k, r in REGION_MAP.items() if r == x) for x in ("NE", "SE"))
REGION_SQL = f"CASE WHEN c_nationkey IN ({_NE}) THEN 'NE' WHEN c_nationkey IN ({_SE}) THEN 'SE' ELSE 'fora_de_escopo' END"


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as speakers: state, region, age and group."""
    from ..operators.audit import region_of

    c = table(spark, d, "customer")
    state = F.col("c_nationkey").cast("string")
    return c.select(F.col("c_custkey").alias("speaker_code"), state.alias("birth_state"), region_of(state, REGION_MAP).alias("region"), F.floor(F.abs("c_acctbal") / 100).cast("int").alias("age"), F.col("c_mktsegment").alias("speaker_gender"))


SPEAKERS = f"""speakers AS (
  SELECT c_custkey AS speaker_code, CAST(c_nationkey AS VARCHAR) AS birth_state, {REGION_SQL} AS region, CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS age, c_mktsegment AS speaker_gender FROM customer)"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Orders as segments of their customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("speaker_code"), F.col("o_totalprice").alias("duration"), F.col("o_orderkey").alias("file_path"), F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("audio_quality"))
    return o.join(speakers(spark, d), "speaker_code")


SPOKEN = SPEAKERS + """, spoken AS (
  SELECT o_custkey AS speaker_code, o_totalprice AS duration, o_orderkey AS file_path, o_orderstatus AS split, o_orderpriority AS audio_quality, birth_state, region, age, speaker_gender
  FROM orders JOIN speakers ON speaker_code = o_custkey)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers: four keys make an item of one speaker, two models by two conditions; status P couldn't be read."""
    k = F.col("o_orderkey")
    item = F.floor(k / 4).cast("long")
    return table(spark, d, "orders").select(
        item.alias("item_id"),
        (item % 120).alias("speaker_code"),
        F.concat(F.lit("m"), (k % 2).cast("string")).alias("model_key"),
        F.when(k % 4 < 2, "asr").otherwise("reference").alias("condition"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("is_correct"),
        (F.col("o_totalprice") % 60).alias("window_duration_s"),
    )


RECORDS = """records AS (
  SELECT o_orderkey // 4 AS item_id, (o_orderkey // 4) % 120 AS speaker_code, 'm' || (o_orderkey % 2) AS model_key, CASE WHEN o_orderkey % 4 < 2 THEN 'asr' ELSE 'reference' END AS condition,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS is_correct, o_totalprice % 60 AS window_duration_s FROM orders)"""

TRIALS = SPEAKERS + ", " + RECORDS + """, tagged AS (
  SELECT records.*, region, age, speaker_gender, CASE WHEN is_correct IS NULL THEN 'resposta não interpretável (parsed_label ausente)' WHEN region IS NULL THEN 'falante ausente da tabela de falantes'
         WHEN region NOT IN ('NE', 'SE') THEN 'região fora de escopo (' || region || ')' END AS drop_reason
  FROM records LEFT JOIN speakers USING (speaker_code)), trials AS (SELECT * FROM tagged WHERE drop_reason IS NULL)"""
