"""A training corpus from raw documents: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between two stages the rows are a Parquet table,
so a lost executor costs a part of one stage.

Null and empty texts: toxicity scores them like any text without n-grams, of
several one stays, they have no shingles, windows or tokens. Extra columns are
passed on whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, dedup, jaccard, pieces, toxicity
from factorloom.llm.store import fresh, table, written

NEAR = jaccard.Rule(width=5, above=80)  # five-word shingles, similarity of 0.8 or more


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a classifier learnt from the labels that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_toxicity_")
    return toxicity.score(docs, model, to=name).filter(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to runs of white space) the document with the smallest id."""
    return dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id."""
    return jaccard.drop_near_copies(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover under a twentieth of the words."""
    names = tuple(fresh(docs, f"_{c}_") for c in decontaminate.RESULTS)
    got = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), results=names)
    return got.filter(~F.col(names[-1])).drop(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that stays, with the digest of the text decoded from them."""
    import public_tokenizers

    got = pieces.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# The classifier and the tokenizer have no SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
