"""A small planted corpus whose windows can be counted by hand: one speaker for each case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_S = 4.0
REGIONS = {"Bahia": "NE", "Pernambuco": "NE", "Ceará": "NE", "Paraíba": "NE", "São Paulo": "SE", "Minas Gerais": "SE", "Rio De Janeiro": "SE", "Espírito Santo": "SE"}
PHRASES = ("a gente morava perto do rio", "meu pai trabalhava na roça", "a escola era longe de casa", "no domingo tinha feira", "depois a cidade cresceu", "eu gostava de jogar bola", "minha avó fazia doce", "naquele tempo não tinha luz", "a festa durava três dias", "fui trabalhar muito cedo", "hoje está tudo diferente", "e foi assim que aconteceu")
#: speaker, state, age, gender, segments, split, interviewer turns before these segments, gap of 12 s before one, second recording from one, segments of low quality
SPEAKERS = (
    ("NE_LONG", "Bahia", 34, "F", 160, "train", [], None, None, 0),
    ("NE_SHORT", "Pernambuco", 41, "F", 30, "train", [], None, None, 0),
    ("NE_INTERRUPTED", "Ceará", 29, "F", 120, "train", [20, 21, 60, 95], None, None, 0),
    ("NE_MID", "Paraíba", 55, "M", 96, "train", [], None, None, 0),
    ("SE_LONG", "São Paulo", 38, "M", 160, "train", [], None, None, 0),
    ("SE_GAP", "Minas Gerais", 47, "F", 120, "train", [], 50, None, 0),
    ("SE_MULTI_AUDIO", "Rio De Janeiro", 33, "F", 128, "train", [], None, 64, 0),
    ("SE_LOW_QUALITY", "Espírito Santo", 26, "F", 120, "train", [], None, None, 60),
    ("SE_OUT_OF_AGE", "São Paulo", 72, "F", 96, "train", [], None, None, 0),
    ("SE_TEST_SPLIT", "São Paulo", 31, "F", 96, "test", [], None, None, 0),
    ("XX_FOREIGN", "", 44, "F", 96, "train", [], None, None, 0),
)


def planted(spark: SparkSession) -> DataFrame:
    """The segments of all speakers and of their interviewer."""
    people = spark.createDataFrame(SPEAKERS, "speaker_code string, birth_state string, age long, speaker_gender string, n int, split string, turns array<int>, gap_at int, again_at int, n_low int")
    i, second = F.col("i"), F.coalesce(F.col("i") >= F.col("again_at"), F.lit(False))
    rows = people.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    others = F.size(F.filter("turns", lambda t: t <= i))
    slot = (i + others - F.when(second, F.col("again_at")).otherwise(0)).cast("double")
    start = slot * SEGMENT_S + F.when(F.coalesce(i >= F.col("gap_at"), F.lit(False)), 12.0).otherwise(0.0)
    recording = F.concat("speaker_code", F.when(second, "_2").otherwise("_1"))
    pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", "speaker_code", i.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(len(PHRASES))).cast("int")
    own = rows.select("*", start.alias("start_time"), recording.alias("audio_name"), F.lit("R").alias("speaker_type"), F.get(F.array(*[F.lit(p) for p in PHRASES]), pick).alias("normalized_text"), F.when(i < F.col("n_low"), "low").otherwise("high").alias("audio_quality"))
    asked = own.where(F.array_contains("turns", i)).withColumns({"start_time": F.col("start_time") - SEGMENT_S, "speaker_type": F.lit("P/1"), "normalized_text": F.lit("e depois"), "age": F.lit(0).cast("long")}).withColumn("speaker_code", F.lit("INTERVIEWER"))
    both = own.unionByName(asked)
    key = F.format_string("%s/%s/%s_%04d_%s.wav", F.col("split"), F.col("audio_name"), F.col("audio_name"), F.col("i"), F.regexp_replace("speaker_type", "/", ""))
    return both.select(
        "audio_name", key.alias("file_path"), "speaker_type", "speaker_code", "speaker_gender", "birth_state", "age", "audio_quality", "split", "start_time",
        (F.col("start_time") + SEGMENT_S).alias("end_time"), F.lit(SEGMENT_S).alias("duration"), "normalized_text", F.col("normalized_text").alias("original_text"),
    )
