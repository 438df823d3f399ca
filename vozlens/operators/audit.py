"""Metadata audit: regions, distinct counts, cross-tabs, quantiles, one-to-one checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The labels of what lies outside.
OUT_OF_SCOPE, OUT_OF_EDGES, INFORMANT = "fora_de_escopo", "fora_das_bordas", "R"
REGIONS = ("NE", "SE")
NE_STATES = ("Maranhão", "Piauí", "Ceará", "Rio Grande Do Norte", "Paraíba", "Pernambuco", "Alagoas", "Sergipe", "Bahia")
SE_STATES = ("Minas Gerais", "Espírito Santo", "Rio De Janeiro", "São Paulo")
REGION_MAP = {s: "NE" for s in NE_STATES} | {s: "SE" for s in SE_STATES}
AGE_EDGES = (16, 25, 35, 45, 60, 120)


def region_of(state: Column, region_map: Mapping[str, str] = REGION_MAP) -> Column:
    """The state's region by the map, else ``OUT_OF_SCOPE``; null too."""
    pairs = F.create_map(*[F.lit(x) for kv in region_map.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, state), F.lit(OUT_OF_SCOPE))


def region_order(region: Column, first: Sequence[str] = (*REGIONS, OUT_OF_SCOPE)) -> list[Column]:
    """Sort keys: the named regions in their order, then others by name."""
    rank = reduce(lambda acc, r: acc.when(region == r[1], r[0]), list(enumerate(first))[1:], F.when(region == first[0], 0)).otherwise(len(first))
    return [rank, region]


def informants(df: DataFrame, kind: str = "speaker_type", informant: str = INFORMANT) -> tuple[DataFrame, DataFrame]:
    """The informants' rows, and (kind, n) of what is dropped."""
    return df.where(F.col(kind) == informant), df.where(~F.col(kind).eqNullSafe(F.lit(informant))).groupBy(kind).agg(F.count("*").alias("n"))


def age_bucket(age: Column, edges: Sequence[int] = AGE_EDGES) -> Column:
    """``a-b`` for ages in [a, b), else ``OUT_OF_EDGES``."""
    out = F.lit(OUT_OF_EDGES)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((age >= a) & (age < b), F.lit(f"{a}-{b - 1}")).otherwise(out)
    return out


def bucket_order(age: Column, edges: Sequence[int] = AGE_EDGES) -> Column:
    return F.when((age >= edges[0]) & (age < edges[-1]), sum(F.when(age >= e, 1).otherwise(0) for e in edges)).otherwise(len(edges) + 1)


def counts(df: DataFrame, keys: Sequence[str | Column], speaker: str = "speaker_code", duration: str = "duration") -> DataFrame:
    """Distinct speakers, segments and hours of each group; null keys are a group."""
    return df.groupBy(*keys).agg(F.count_distinct(speaker).alias("n_speakers"), F.count("*").alias("n_segments"), F.bround(F.sum(F.col(duration).cast("double")) / 3600, 4).alias("hours"))


def region_totals(by_state: DataFrame) -> DataFrame:
    """Second-level sums of per-state counts: a speaker of two states counts twice."""
    return by_state.groupBy("region").agg(F.sum("n_speakers").alias("n_speakers"), F.sum("n_segments").alias("n_segments"))


def quantiles(df: DataFrame, value: str | Column, at: Mapping[str, float], keys: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group, a column for each name of ``at``.

    Equal values are counted first.  What is left is ranked by ranges of values, which
    approximate quantiles part, so that a group of any size is many sorts and none holds
    its values at once; only a count for each group and range is carried over.  Nulls
    take no part; a group without values has no row.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counted = df.select(*keys, v.alias("value_")).where("value_ is not null").groupBy(*keys, "value_").agg(F.count("*").alias("count_"))
    # every use of ``counted`` reads the counts, so that all share one exchange
    bounds = counted.where("count_ > 0").agg(F.percentile_approx("value_", F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10_000)).alias("bounds_"))
    placed = counted.withColumn("bounds_", bounds.scalar()).withColumn("bin_", F.coalesce(F.size(F.filter("bounds_", lambda b: b < F.col("value_"))), F.lit(0))).drop("bounds_")
    upto = placed.withColumn("upto_", F.sum("count_").over(Window.partitionBy(*keys, "bin_").orderBy("value_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy(*keys, "bin_").agg(F.sum("count_").alias("n_")).withColumns({"before_": F.coalesce(before, F.lit(0)), "total_": F.sum("n_").over(Window.partitionBy(*keys))})
    same = reduce(Column.__and__, [F.col(f"u.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], F.col("u.bin_") == F.col("s.bin_"))
    ranked = upto.alias("u").join(sums.alias("s"), same).select(*[f"u.{k}" for k in keys], "value_", "total_", (F.col("before_") + F.col("upto_")).alias("end_"), (F.col("before_") + F.col("upto_") - F.col("count_")).alias("start_"))
    held = lambda rank: F.max(F.when((F.col("start_") <= rank) & (rank < F.col("end_")), F.col("value_")))
    place = {name: F.lit(float(p)) * (F.col("total_") - 1) for name, p in at.items()}
    ends = [f(place[name]) for name in at for f in (F.floor, F.ceil)]
    found = ranked.groupBy(*keys).agg(F.max("total_").alias("total_"), *[held(rank).alias(f"{name}_{side}") for name, side, rank in zip([n for n in at for _ in "lh"], "lh" * len(at), ends, strict=True)])
    between = lambda name, p: F.when(F.floor(p) == F.ceil(p), F.col(f"{name}_l")).otherwise((F.ceil(p) - p) * F.col(f"{name}_l") + (p - F.floor(p)) * F.col(f"{name}_h"))
    return found.where("total_ is not null").select(*keys, *[between(name, p).alias(name) for name, p in place.items()])


def with_quantiles(df: DataFrame, value: str | Column, at: Mapping[str, float], keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """The aggregates of each group and the quantiles of ``value``, put together by a union, which null keys don't trouble."""
    plain = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    both = plain.unionByName(quantiles(df, value, at, keys), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(name).alias(name) for name in (*aggs, *at)])


def describe(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """min, q1, median, q3, max, mean with exact, linearly interpolated quantiles."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    out = with_quantiles(df, v, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, {"min": F.min(v), "max": F.max(v), "mean": F.avg(v)})
    return out.select(*keys, *[F.bround(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")])


def key_candidates(df: DataFrame, key: str, composite: Sequence[str]) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("single"), F.count_distinct(*composite).alias("composite"))


def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """How many keys occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_overlapping"))


def speaker_table(df: DataFrame, speaker: str, attributes: Sequence[str], order: Column) -> DataFrame:
    """One row a speaker: each attribute's first non-null value in ``order``, how many it has, and the segments."""
    aggs = [F.count("*").alias("n_segments")]
    for a in attributes:
        aggs += [F.min_by(a, F.when(F.col(a).isNotNull(), order)).alias(a), F.count_distinct(a).alias(f"n_{a}")]
    return df.groupBy(speaker).agg(*aggs)


def one_to_one(table: DataFrame, speaker: str, attributes: Sequence[str], examples: int = 5) -> DataFrame:
    """(attribute, n_violations, examples): speakers with several values of an attribute, and the smallest of them."""
    flags = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), (F.col(f"n_{a}") > 1).alias("bad")) for a in attributes]))
    bad = table.select(F.col(speaker).alias("who"), flags.alias("f")).select("f.attribute", "f.bad", "who")
    ranked = bad.withColumn("r", F.row_number().over(Window.partitionBy("attribute", "bad").orderBy("who")))
    return ranked.groupBy("attribute").agg(F.count_if("bad").alias("n_violations"), F.array_sort(F.collect_list(F.when(F.col("bad") & (F.col("r") <= examples), F.col("who")))).alias("examples"))


def quality_by_region(df: DataFrame, region: str, quality: str, values: Sequence[str], low: str, speaker: str) -> DataFrame:
    """Dense region x quality counts, totals, per cent low, speakers, and speakers with any low segment."""
    cells = [F.count_if(F.col(quality) == v).alias(f"n_{v}") for v in values]
    is_low = F.col(quality) == low
    out = df.groupBy(region).agg(*cells, F.count("*").alias("total"), F.count_if(is_low).alias("n_low"), F.count_distinct(speaker).alias("n_speakers"), F.count_distinct(F.when(is_low, F.col(speaker))).alias("n_speakers_low"))
    return out.withColumn("pct_low", F.bround(100 * F.col("n_low") / F.col("total"), 4)).drop("n_low")


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of the values as columns, zeros where there are none, and the row total."""
    out = df.groupBy(key).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return out.withColumn("total", sum(F.col(f"`{v}`") for v in values))


def category_by_region(table: DataFrame, region: str, attribute: str, universe: DataFrame) -> DataFrame:
    """Counts of every (region, category), zeros too; categories are those of ``universe`` (one column) and the table.

    The grid is the product of two lists of labels, bounded by their distinct values.
    """
    n = table.groupBy(region, attribute).agg(F.count("*").alias("n"))
    labels = universe.select(F.col(universe.columns[0]).alias(attribute)).union(n.select(attribute)).distinct()
    grid = n.groupBy(region).agg(F.lit(1).alias("one")).join(labels.withColumn("one", F.lit(1)), "one").drop("one")
    found = grid.alias("g").join(n.alias("n"), F.col(f"g.{region}").eqNullSafe(F.col(f"n.{region}")) & F.col(f"g.{attribute}").eqNullSafe(F.col(f"n.{attribute}")), "left")
    return found.select(f"g.{region}", f"g.{attribute}", F.coalesce("n.n", F.lit(0)).alias("n"))


def segments_per_speaker(table: DataFrame, region: str, n: str = "n_segments") -> DataFrame:
    """Spread of the segments of a region's speakers, and the share of the largest of them."""
    aggs = {"n_speakers": F.count("*"), "min": F.min(n), "mean": F.avg(n), "max": F.max(n), "total": F.sum(n)}
    out = with_quantiles(table, n, {"median": 0.5}, [region], aggs)
    return out.withColumns({"median": F.bround("median", 2), "mean": F.bround("mean", 2), "max_share": F.bround(F.when(F.col("total") > 0, F.col("max") / F.col("total")), 4)})


def age_stats(table: DataFrame, region: str, age: str = "age") -> DataFrame:
    out = with_quantiles(table, age, {"median_age": 0.5}, [region], {"n_speakers": F.count("*"), "mean_age": F.avg(age)})
    return out.select(region, "n_speakers", F.bround("median_age", 1).alias("median_age"), F.bround("mean_age", 1).alias("mean_age"))


def unknown_coverage(table: DataFrame, region: str, attribute: str, unknown: str = "unknown") -> DataFrame:
    """Per cent unknown by region and over all (region ``geral``), in one rollup."""
    out = table.rollup(region).agg(F.grouping(region).alias("g"), F.count("*").alias("n"), F.count_if(F.col(attribute) == unknown).alias("n_unknown"))
    return out.select(F.when(F.col("g") == 1, "geral").otherwise(F.col(region)).alias(region), "n", "n_unknown", F.bround(100 * F.col("n_unknown") / F.col("n"), 4).alias("pct_unknown"))


def schema_report(df: DataFrame, low_cardinality: Sequence[str] = ()) -> DataFrame:
    """A row a column: type, nulls, per cent null, and the value counts of the named columns as text; one pass and one per named column."""
    kinds = dict(df.dtypes)
    cells = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"null_{i}").alias("n_null")) for i, c in enumerate(df.columns)]))
    out = cells.select("n", rows.alias("r")).select("r.*", F.bround(F.when(F.col("n") > 0, 100 * F.col("r.n_null") / F.col("n")), 4).alias("pct_null"))
    values = [df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))), lambda s: F.concat(F.coalesce(s["v"], F.lit("null")), F.lit("="), (-s["n"]).cast("string"))), "; ").alias("values")).select(F.lit(c).alias("column"), "values") for c in low_cardinality]
    return out.join(reduce(DataFrame.unionByName, values), "column", "left") if values else out.withColumn("values", F.lit(None).cast("string"))


def data_quality(df: DataFrame, sentinels: Mapping[str, Column], quality: str, duration: str, speaker: str) -> DataFrame:
    """Long table (section, key, value): sentinel counts, quality counts, spread of durations and of segments a speaker."""
    marks = df.agg(*[F.count_if(c).cast("double").alias(k) for k, c in sentinels.items()])
    named = lambda section, frame: frame.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in frame.columns])).alias("r")).select("r.*")
    per_quality = df.groupBy(quality).agg(F.count("*").cast("double").alias("value")).select(F.lit("audio_quality").alias("section"), F.col(quality).cast("string").alias("key"), "value")
    per_speaker = df.groupBy(speaker).agg(F.count("*").alias("n"))
    return named("sentinels", marks).unionByName(per_quality).unionByName(named("duration", describe(df, duration))).unionByName(named("segments_per_speaker", describe(per_speaker, "n")))


def region_presence(by_state: DataFrame, region_map: Mapping[str, str], region: str, state: str = "birth_state") -> DataFrame:
    """Every state of a region by the map, with its counts or absent."""
    states = by_state.sparkSession.createDataFrame([(s,) for s, r in sorted(region_map.items()) if r == region], f"{state} string")
    return states.join(by_state, state, "left").withColumn("present", F.col("n_speakers").isNotNull())
