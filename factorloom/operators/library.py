"""Statistics over factor outcomes, experiments and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import holds, ratio
from .contain import either_way
from .ordered import beside
from .ranges import attach


def read_library(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Library entries from a JSON document {"entries": [...]}: one row per entry."""
    reader = spark.read.option("multiLine", True)
    doc = (reader.schema(schema) if schema else reader).json(path)
    return doc.select(F.explode("entries").alias("e")).select("e.*")


def read_experiments(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


# Metrics in order of preference; a zero counts as absent.
PRIMARY = ("annual_return", "test_annual_return", "average_test_annual_return", "train_annual_return")


def experiments(records: DataFrame) -> DataFrame:
    """Flat experiment rows with the primary metric, newest first (records: id, timestamp, type, metrics, notes)."""
    have = records.select("metrics.*").columns
    metric = F.coalesce(*[F.when(F.col(f"metrics.{m}") != 0, F.col(f"metrics.{m}")) for m in PRIMARY if m in have])
    return records.select(
        "experiment_id", "timestamp", "experiment_type", metric.alias("primary_metric"), F.to_json("notes").alias("notes")
    ).orderBy(F.col("timestamp").desc(), "experiment_id")


def latest_runs(runs: DataFrame, n: int, order: str = "timestamp", key: str = "experiment_id") -> DataFrame:
    return runs.orderBy(F.col(order).desc(), key).limit(n)


def newest_provenance(runs: DataFrame) -> DataFrame:
    """The newest run of each factor from runs with an array ``factor_ids``."""
    each = runs.select(F.explode("factor_ids").alias("factor_id"), "experiment_id", "timestamp")
    return each.groupBy("factor_id").agg(
        F.max_by("experiment_id", F.struct("timestamp", "experiment_id")).alias("experiment_id"),
        F.max("timestamp").alias("timestamp"),
    )


def retain_last(log: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n records per key (the limit is applied before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def append_and_retain(log: DataFrame, rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """A log with new records and only its newest n."""
    return log.unionByName(rows, allowMissingColumns=True).orderBy(*[F.col(c).desc() for c in order]).limit(n)


def count_by(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("verdict") == "useful").alias("useful")
    ).withColumn("win_rate", F.col("useful") / F.col("entries"))


def structure_win_rate(outcomes: DataFrame, top: int = 10) -> DataFrame:
    """Win rate by structure, best first."""
    return count_by(outcomes, "structure").orderBy(F.col("win_rate").desc(), F.col("entries").desc(), "structure").limit(top)


def field_win_rate(outcomes: DataFrame) -> DataFrame:
    return count_by(outcomes.withColumn("field", F.explode("input_fields")), "field")


def direction_insight(outcomes: DataFrame, top: int = 3, exposed: float = 0.3) -> DataFrame:
    """Per direction: verdict counts, mean IC, failures with a large exposure, best fields of useful ones."""
    useful, useless = F.col("verdict") == "useful", F.col("verdict") == "useless"
    risky = F.exists(F.map_values("exposures"), lambda v: F.abs(v) > exposed)
    base = outcomes.groupBy("direction").agg(
        F.count_if(useful).alias("useful"),
        F.count_if(F.col("verdict") == "marginal").alias("marginal"),
        F.count_if(useless).alias("useless"),
        F.avg("rank_ic").alias("mean_ic"),
        F.count_if(useless & risky).alias("exposed_failures"),
    )
    fields = outcomes.filter(useful).select("direction", F.explode("input_fields").alias("f")).groupBy("direction", "f").agg(
        F.count(F.lit(1)).alias("c")
    )
    place = Window.partitionBy("direction").orderBy(F.col("c").desc(), "f")
    best = fields.withColumn("_p", F.row_number().over(place)).filter(F.col("_p") <= top).groupBy("direction").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "f"))), lambda s: s["f"]), ",").alias("top_fields")
    )
    return base.join(best, "direction", "left").fillna("", ["top_fields"])


def direction_guidance(outcomes: DataFrame, asked: DataFrame, top: int = 3, exposed: float = 0.3) -> DataFrame:
    """For every asked direction the verdicts, mean IC and best fields of outcomes whose direction holds it or stands in it, whatever the case.

    A direction without such outcomes is answered from all of them. Outcomes are folded by
    direction first, so a match costs one row for each direction, not for each outcome.
    """
    useful, useless = F.col("verdict") == "useful", F.col("verdict") == "useless"
    risky = F.exists(F.map_values("exposures"), lambda v: F.abs(v) > exposed)
    own = outcomes.withColumn("_d", F.lower("direction"))
    sums = own.groupBy("_d").agg(
        F.count_if(useful).alias("useful"),
        F.count_if(F.col("verdict") == "marginal").alias("marginal"),
        F.count_if(useless).alias("useless"),
        F.count_if(useless & risky).alias("exposed_failures"),
        F.sum("rank_ic").alias("_ic"),
        F.count("rank_ic").alias("_n"),
    )
    fields = own.filter(useful).select("_d", F.explode("input_fields").alias("f")).groupBy("_d", "f").agg(F.count(F.lit(1)).alias("c"))
    wanted = asked.select(F.col(asked.columns[0]).alias("asked")).distinct()
    low = wanted.select("asked", F.lower("asked").alias("_a"))
    pairs = either_way(low.select("_a"), sums.select("_d"), "_a", "_d")
    met = low.join(pairs, "_a")
    rest = wanted.join(met.select("asked").distinct(), "asked", "left_anti").select("asked", F.lit(True).alias("_all"))
    met = met.select("asked", "_d").unionByName(rest.select("asked", F.lit(None).cast("string").alias("_d")))
    everything = sums.groupBy().agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).withColumn("_d", F.lit(None).cast("string"))
    all_fields = fields.groupBy("f").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("_d"), "f", "c")
    sums, fields = sums.unionByName(everything), fields.unionByName(all_fields)

    def of_asked(side: DataFrame) -> DataFrame:
        return attach(met, side.withColumnRenamed("_d", "_k"), ["_d"], [c for c in side.columns if c != "_d"], side_keys=["_k"], how="inner")

    base = of_asked(sums).groupBy("asked").agg(
        *[F.sum(c).alias(c) for c in ("useful", "marginal", "useless", "exposed_failures")], ratio(F.sum("_ic"), F.sum("_n")).alias("mean_ic")
    )
    counted = of_asked(fields).groupBy("asked", "f").agg(F.sum("c").alias("c"))
    place = Window.partitionBy("asked").orderBy(F.col("c").desc(), "f")
    best = counted.withColumn("_p", F.row_number().over(place)).filter(F.col("_p") <= top).groupBy("asked").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "f"))), lambda s: s["f"]), ",").alias("top_fields")
    )
    fallback = rest.withColumnRenamed("_all", "from_all")
    got = base.join(best, "asked", "left").join(fallback, "asked", "left")
    return got.fillna("", ["top_fields"]).withColumn("from_all", F.coalesce("from_all", F.lit(False)))


def verdict_samples(outcomes: DataFrame, order: Sequence[str], useful: int = 5, other: int = 3) -> DataFrame:
    """The first few structures of each direction and verdict."""
    w = Window.partitionBy("direction", "verdict").orderBy(*order)
    limit = F.when(F.col("verdict") == "useful", useful).otherwise(other)
    d = outcomes.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(useful, other)).filter(F.col("_k") <= limit)
    return d.groupBy("direction", "verdict").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "structure"))), lambda s: s["structure"]), "|").alias("samples")
    )


def coverage_counts(outcomes: DataFrame, saturated_at: int = 3, underused_at: int = 1, fields: DataFrame | None = None) -> DataFrame:
    """(kind, value, n, state): counts by field, structure and direction.

    ``fields`` lists what could be used: a field without an outcome is the most underused of all.
    """
    parts = {"field": F.explode("input_fields"), "structure": F.col("structure"), "direction": F.col("direction")}
    rows = None
    for kind, c in parts.items():
        d = outcomes.select(c.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        rows = d if rows is None else rows.unionByName(d)
    if fields is not None:
        unused = fields.select(F.col(fields.columns[0]).alias("value")).distinct().join(rows.filter("kind = 'field'"), "value", "left_anti")
        rows = rows.unionByName(unused.select("value", F.lit(0).cast("long").alias("n"), F.lit("field").alias("kind")))
    state = (
        F.when((F.col("kind") == "direction") & (F.col("n") >= saturated_at), "saturated")
        .when((F.col("kind") == "field") & (F.col("n") <= underused_at), "underused")
        .otherwise("normal")
    )
    return rows.withColumn("state", state)


def unexplored(outcomes: DataFrame, standard: Sequence[str], column: str = "direction") -> DataFrame:
    """Standard values without an outcome."""
    spark = outcomes.sparkSession
    table = spark.createDataFrame([(s,) for s in standard], f"{column} string")
    return table.join(outcomes.select(column).distinct(), column, "left_anti")


def direction_priority(outcomes: DataFrame, floor: float = 0.015, rounds: int = 3, candidates: int = 5) -> DataFrame:
    """Search order of directions: win rate less a saturation penalty; saturated losers dropped."""
    d = outcomes.groupBy("direction").agg(
        F.count(F.lit(1)).alias("recorded"),
        F.count_if(holds((F.col("verdict") == "useful") & (F.col("rank_ic") > floor))).alias("_wins"),
    )
    d = d.withColumns({"win_rate": F.col("_wins") / F.col("recorded"), "saturated": F.col("recorded") >= 3})
    d = d.withColumn("priority", F.col("win_rate") * 0.5 - F.when(F.col("saturated"), 0.5).otherwise(0.0))
    wr = F.col("win_rate")
    d = d.withColumns(
        {
            "rounds": F.when(wr > 0.5, rounds + 2).when(wr > 0.2, rounds).when(wr > 0, max(1, rounds - 1)).otherwise(rounds),
            "candidates": F.when(wr > 0.5, candidates + 3).when(wr > 0.2, candidates).when(wr > 0, candidates + 2).otherwise(candidates),
        }
    )
    live = ~F.col("saturated") | (wr > 0.1)
    some = d.agg(F.max(live.cast("int")).alias("_some"))
    return beside(d, some).filter(live | (F.col("_some") == 0)).drop("_some", "_wins")


def memory_snapshot(experience: DataFrame, family: str, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first few experiences of a family (or tagged with it) per pattern type."""
    mine = experience.filter((F.col("family") == family) | F.array_contains("tags", family))
    w = Window.partitionBy("pattern_type").orderBy(*order)
    return mine.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def alerts(events: DataFrame, order: Sequence[str], limit: int = 50) -> DataFrame:
    """Most severe first, then oldest: critical < warning < info."""
    level = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return events.withColumn("_l", level).orderBy("_l", *order).limit(limit).drop("_l")
