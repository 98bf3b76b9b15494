"""Exact deduplication as a stateful stream.

1. Arrivals: for every row the SHA-256 of its normalised text, its id and where
   its content stands (file and row number). They are written to the shared
   folder, which the stream reads.
2. The stream keeps, by digest and without expiry, the smallest identifier, the
   locator of that row's content and the number of rows, in RocksDB state on disk
   with its changes in the stream's checkpoint. The state is a streaming
   aggregation: every task folds its own rows first, so that a text that makes a
   third of all rows reaches its state as one row per task.
3. On hits (rows whose digest another row holds) the full normalised bytes of both
   locators are compared in a join; rows of a large group are dealt out by a salt,
   the kept text once to each. Rows that share a digest but not the bytes are
   grouped by the bytes themselves.

Null texts count as empty texts; empty texts are equal to each other. A null id
is larger than any id; of rows with the same id the first by file and row number
stays. Tables without file and row numbers (other formats, unions, results of
Python) are written to the shared folder once, before anything is decided.

A ``Lasting`` state outlives the call: each arrival is landed in its folder, its
digests are looked up in the state of all arrivals before, and the stream goes on
from its checkpoint. What an earlier arrival kept stays; among the rows of one
arrival the smallest id does. An arrival that died can be given again under its
name. Extra columns are passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import carried, exists, shared_folder, written

PLACE = ["_file_", "_row_"]
SALTED = 128  # copies compared with one sent copy of the kept text
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # A partition's local files go when its task has committed them to the checkpoint.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normal(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass(frozen=True)
class Lasting:
    """A folder that all executors share, and the name of the arrival; the text column has the same name in all arrivals."""

    folder: str
    arrival: str

    @property
    def content(self) -> str:
        return f"{self.folder}/content/{self.arrival}"


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row number of each row."""
    place = docs.metadataColumn("_metadata")
    return docs.select("*", place["file_path"].alias("_file_"), place["row_index"].alias("_row_"))


def landed(docs: DataFrame, lasting: Lasting | None = None) -> DataFrame:
    """``docs`` as a table whose rows have places: itself where its files give row numbers, else written once."""
    if lasting is not None:
        spark = docs.sparkSession
        if not exists(spark, f"{lasting.content}/_SUCCESS"):
            docs.write.mode("overwrite").option("compression", "zstd").parquet(lasting.content)
        return spark.read.schema(docs.schema).parquet(lasting.content)
    try:
        placed(docs).schema  # noqa: B018
        return docs
    except AnalysisException:
        return written(docs, "landed")


def keyed_state(spark: SparkSession, schema: T.StructType, arrivals: str, out: str, log: str) -> DataFrame:
    """(digest, first, n) of all arrivals so far, through a stream over the files of the arrivals."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        first = F.min(F.struct("turn", F.col("id").isNull().alias("no_id"), "id", *PLACE)).alias("first")
        state = spark.readStream.schema(schema).parquet(arrivals).groupBy("digest").agg(first, F.count("*").alias("n"))
        stream = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", log)
            .foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch-{k:08d}"))
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.withColumn("batch", F.lit(0).cast("long")).schema
    changes = spark.read.schema(schema).parquet(f"{out}/batch-*") if exists(spark, f"{out}/batch-00000000") else spark.createDataFrame([], schema)
    # a digest may have changed in several batches: the latest is its state
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s")).select("digest", "s.first", "s.n")


def turn_of(spark: SparkSession, lasting: Lasting) -> int:
    """How many arrivals came before this one."""
    if not exists(spark, f"{lasting.folder}/arrivals"):
        return 0
    seen = spark.read.parquet(f"{lasting.folder}/arrivals/*").groupBy("arrival").agg(F.max("turn").alias("turn")).collect()  # one row for each arrival
    return {r["arrival"]: r["turn"] for r in seen}.get(lasting.arrival, max((r["turn"] for r in seen), default=-1) + 1)


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, lasting: Lasting | None = None) -> DataFrame:
    """One row per row of ``docs``: its id and place, digest, keep_id, group_size and kept."""
    spark = docs.sparkSession
    docs = landed(docs, lasting)
    rows = placed(docs)
    if lasting is None:
        turn, name, content = 0, "", rows
        every, out, log = (shared_folder(spark, f"dedup-{x}") for x in ("arrivals", "state", "stream"))
        path = every
    else:
        turn, name = turn_of(spark, lasting), lasting.arrival
        content = placed(spark.read.schema(docs.select(text).schema).parquet(f"{lasting.folder}/content/*"))
        every, out, log = (f"{lasting.folder}/{x}" for x in ("arrivals/*", "changes", "stream"))
        path = f"{lasting.folder}/arrivals/{lasting.arrival}"
    come = rows.select(F.col(doc_id).alias("id"), *PLACE, digest(normal(F.col(text))).alias("digest"), F.lit(turn).alias("turn"), F.lit(name).alias("arrival"))
    if not exists(spark, f"{path}/_SUCCESS"):
        come.write.mode("overwrite").option("compression", "zstd").parquet(path)
    arrivals = spark.read.schema(come.schema).parquet(path)
    groups = written(keyed_state(spark, come.schema, every, out, log), "dedup-groups")
    # Large groups: AQE splits their side of this narrow join.
    members = arrivals.join(groups, "digest")
    members = members.select("id", *PLACE, "digest", "turn", "first", "n", F.expr(" AND ".join(f"first.{c} = {c}" for c in PLACE)).alias("kept"))
    odd = written(members_with_other_bytes(content, members.filter("n > 1"), text), "dedup-odd")
    if not odd.isEmpty():
        all_of = arrivals if lasting is None else spark.read.schema(come.schema).parquet(every)
        rest = by_bytes(content, all_of, odd, text).filter(F.col("turn") == turn)
        members = members.join(odd.select("digest").distinct(), "digest", "left_anti").unionByName(rest)
    return members.select(F.col("id").alias(doc_id), *PLACE, "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), "kept")


def members_with_other_bytes(content: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """Rows of ``hits`` whose normalised bytes aren't those of the row that stays, which may have arrived before."""
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    salt = F.when(F.col("kept"), F.lit(None).cast("int")).otherwise(F.pmod(F.xxhash64(*PLACE), salts).cast("int"))
    wanted = hits.select(*PLACE, "digest", "kept", salts.alias("salts"), salt.alias("salt"))
    before = hits.filter(F.col("first.turn") < F.col("turn")).select(*(F.col(f"first.{c}").alias(c) for c in PLACE), "digest", F.lit(True).alias("kept"), salts.alias("salts"))
    wanted = wanted.unionByName(before.distinct().withColumn("salt", F.lit(None).cast("int")))
    texts = content.select(*PLACE, F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), PLACE)
    texts = texts.select("digest", "kept", "salts", "salt", *PLACE, normal(F.col("text")).alias("bytes"))
    texts = texts.withColumn("salt", F.explode(F.when(F.col("kept"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("salt"))))
    copies = texts.filter(~F.col("kept")).select("digest", "salt", *PLACE, "bytes")
    stay = texts.filter("kept").select("digest", "salt", F.col("bytes").alias("kept_bytes"))
    return copies.join(stay, ["digest", "salt"]).filter("bytes != kept_bytes").select("digest", *PLACE)


def by_bytes(content: DataFrame, arrivals: DataFrame, odd: DataFrame, text: str) -> DataFrame:
    """Members of the digests that several texts share, grouped by the bytes."""
    digests = odd.select("digest").distinct()
    found = arrivals.join(digests, "digest").join(content.select(*PLACE, normal(F.col(text)).alias("bytes")), PLACE)
    first = F.min(F.struct("turn", F.col("id").isNull().alias("no_id"), "id", *PLACE)).alias("first")
    same = found.join(found.groupBy("digest", "bytes").agg(first, F.count("*").alias("n")), ["digest", "bytes"])
    return same.select("id", *PLACE, "digest", "turn", "first", "n", F.expr(" AND ".join(f"first.{c} = {c}" for c in PLACE)).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lasting: Lasting | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    if not {*PLACE}.isdisjoint(docs.columns):
        cols, fields = carried(docs, docs.columns)
        names = dict(zip(docs.columns, (f.name for f in fields), strict=True))
        return dedup(docs.select(*cols), names[doc_id], names[text], lasting).toDF(*docs.columns)
    docs = landed(docs, lasting)
    stay = decisions(docs, doc_id, text, lasting=lasting).filter("kept").select(*PLACE)
    return placed(docs).join(stay, PLACE, "left_semi").drop(*PLACE)
