"""Factor lifecycle: next status, archiving, lineage and versions.

Library tables may be large here; lineage walks by joins, not on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import holds
from ..session import settle

# The allowed status transitions.
TRANSITIONS = {
    "draft": ["candidate", "rejected"],
    "candidate": ["observe", "rejected"],
    "observe": ["paper", "rejected", "archived"],
    "paper": ["pilot", "observe", "archived"],
    "pilot": ["live", "paper", "retired"],
    "live": ["retired"],
    "approved": ["paper", "observe", "archived", "retired"],
    "rejected": ["archived"],
    "archived": [],
    "retired": ["archived"],
}


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(a, b) for a, targets in TRANSITIONS.items() for b in targets]
    return spark.createDataFrame(rows, "status string, target string")


def allowed(requests: DataFrame) -> DataFrame:
    """Keep the (status, target) requests that the transition table permits."""
    table = transition_table(requests.sparkSession)
    return requests.join(F.broadcast(table), ["status", "target"], "left_semi")


def recommend(entries: DataFrame) -> DataFrame:
    """Next status from OOS IC, days since evaluation, cost-adjusted IC and crowding."""
    s, days = F.col("status"), F.col("days_since_eval")
    oos, cost, crowd, regime = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("oos_ic", "cost_adj_ic", "crowding", "regime_adj_ic"))
    level = F.when(oos != 0, oos).otherwise(F.abs(F.coalesce("rank_ic", F.lit(0.0))))
    nxt = (
        F.when((s == "candidate") & (level > 0.015), "observe")
        .when((s == "observe") & (days >= 30) & (oos > 0.01) & (cost > 0), "paper")
        .when((s == "observe") & (level < 0.005) & (days > 60), "rejected")
        .when((s == "paper") & (days >= 60) & (oos > 0.015) & (crowd < 0.5), "pilot")
        .when((s == "paper") & (oos < 0) & (days > 90), "observe")
        .when((s == "pilot") & (days >= 90) & (cost > 0.01) & (regime > 0), "live")
        .when((s == "pilot") & (cost < 0) & (days > 120), "retired")
        .when((s == "live") & (((level < 0.005) & (days > 60)) | (crowd > 0.7)), "retired")
        .otherwise(s)
    )
    return entries.withColumn("target", nxt)


def archive(entries: DataFrame, today, min_days: int = 30, min_ic: float = 0.015) -> DataFrame:
    """Entries to archive: rejected, or observed for too long, or undated with a low IC."""
    age = F.datediff(F.lit(today).cast("date"), F.col("evaluated_at"))
    stale = F.when(F.col("evaluated_at").isNotNull(), age > min_days).otherwise(
        F.abs(F.coalesce("rank_ic", F.lit(0.0))) < min_ic
    )
    return entries.filter(holds((F.col("status") == "rejected") | ((F.col("status") == "observe") & stale)))


def lineage(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, cyclic) from (id, parent): ancestors by pointer doubling.

    Each round joins every node's jump target with the target's own jump, so a chain of
    length n needs log2(n) rounds.  A node whose chain never ends is on or behind a cycle.
    """
    state = nodes.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    state = state.join(known, "up", "left").select(
        "id",
        F.when(F.col("_known"), F.col("up")).alias("up"),
        F.when(F.col("_known"), F.col("depth")).otherwise(0).alias("depth"),
        F.when(F.col("_known"), F.col("up")).otherwise(F.col("id")).alias("root"),
    )
    state = settle(state)
    for _ in range(state.count().bit_length() + 1):
        if not state.filter(F.col("up").isNotNull()).limit(1).count():
            break
        side = state.select(
            F.col("id").alias("up"), F.col("up").alias("_up2"), F.col("depth").alias("_d2"), F.col("root").alias("_r2")
        )
        total = F.col("depth") + F.coalesce("_d2", F.lit(0))
        state = settle(
            state.join(side, "up", "left").select(
                "id", F.col("_up2").alias("up"), total.alias("depth"), F.coalesce("_r2", "root").alias("root")
            )
        )
    cyclic = F.col("up").isNotNull()
    return state.select(
        "id", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic")
    )


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent").isNull())


def latest_version(versions: DataFrame, key: str = "factor_id") -> DataFrame:
    """The newest version of each factor, by (version, ts)."""
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("version", "ts")).alias("_v")).select(key, "_v.*")
