"""Keyword tagging, chunking, retrieval and conversation summaries over text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ordered import beside

# Keyword rules in order, with the research direction each stands for.
NEWS_RULES = [
    (["资金流", "北向", "外资"], "capital_flow"),
    (["波动", "震荡", "恐慌"], "volatility_regime"),
    (["业绩", "盈利", "利润"], "quality_earnings"),
    (["涨", "跌", "反弹", "趋势"], "momentum_reversal"),
    (["情绪", "信心", "散户"], "sentiment_behavioral"),
    (["估值", "市盈", "市净", "便宜"], "value_contrarian"),
    (["流动", "换手", "成交"], "liquidity_premium"),
]

# Factor families in order, with their keywords.
FAMILY_RULES = [
    (["动量", "趋势", "momentum", "trend", "延续", "惯性"], "momentum"),
    (["反转", "均值回归", "reversal", "mean_reversion", "超跌"], "reversal"),
    (["波动", "风险", "volatility", "risk", "波动率", "标准差"], "volatility"),
    (["量价", "换手", "成交量", "volume", "turnover", "资金流"], "volume_price"),
    (["流动性", "换手率", "liquidity", "amihud"], "liquidity"),
    (["基本面", "财务", "盈利", "估值", "fundamental", "earnings"], "fundamental"),
]

Rules = Sequence[tuple[Sequence[str], str]]


def has_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def first_rule(text: Column, rules: Rules) -> Column:
    """Label of the first rule with a keyword in the text."""
    return F.coalesce(*[F.when(has_any(text, words), F.lit(label)) for words, label in rules])


def keyword_tag(docs: DataFrame, rules: Rules = NEWS_RULES, title: str = "title", content: str = "content") -> DataFrame:
    """Add ``direction``: the first matching rule on title and whole content (NULL without a match)."""
    return docs.withColumn("direction", first_rule(F.concat_ws(" ", title, content), rules))


def keyword_filter(docs: DataFrame, words: Sequence[str], column: str = "title") -> DataFrame:
    return docs.filter(has_any(F.col(column), words))


def new_directions(tagged: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first item of each direction that is not known yet (partial aggregates, hot directions are safe)."""
    fresh = tagged.filter(F.col("direction").isNotNull()).join(known.select("direction").distinct(), "direction", "left_anti")
    rest = [c for c in fresh.columns if c != "direction"]
    first = fresh.groupBy("direction").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select("direction", "_r.*")


def family_match(text: str | Column, rules: Rules = FAMILY_RULES) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(first_rule(F.lower(text), rules), F.lit("generic"))


def chunk_markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per heading section: chunk_no, title, content and its token set."""
    parts = F.split(F.col(text), r"\n(?=#{1,3} )")
    d = docs.select(key, F.posexplode(parts).alias("_i", "_c")).withColumn("content", F.regexp_replace("_c", r"^\s+|\s+$", ""))
    d = d.filter(F.col("content") != "")
    number = F.col("_i") + 1
    heading = F.trim(F.regexp_replace(F.substring_index("content", "\n", 1), "^[# ]+", ""))
    title = F.when(heading != "", heading).otherwise(F.concat(F.lit("Section "), number.cast("string")))
    return d.select(key, number.alias("chunk_no"), title.alias("title"), "content", tokens("content").alias("tokens"))


def retrieve(chunks: DataFrame, question: str, order: Sequence[str], limit: int = 6) -> DataFrame:
    """Top chunks by token overlap over a length penalty; the first chunks when none overlaps.

    The question's tokens are a literal, so scoring is a projection and the top-k a
    per-task heap.
    """
    spark = chunks.sparkSession
    asked = spark.range(1).select(tokens(F.lit(question)).alias("t")).first()["t"]
    overlap = F.size(F.array_intersect("tokens", F.array(*[F.lit(t) for t in asked]).cast("array<string>")))
    length = F.greatest(F.lit(1.0), F.log10((F.length("content") + 10).cast("double")))
    scored = chunks.withColumn("overlap", overlap).withColumn("score", F.col("overlap") / length)
    # Rows without overlap score 0 and come last in order: they serve only when nothing overlaps.
    top = scored.orderBy(F.col("score").desc(), *order).limit(limit)
    best = F.max("overlap").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("_m", best).filter((F.col("overlap") > 0) | (F.col("_m") == 0)).drop("_m")


def knowledge_match(entries: DataFrame, direction: str, top: int = 3) -> DataFrame:
    """Entries whose direction equals or contains the asked one (or is contained); else the best keyword scores."""
    asked = direction.lower()
    words = asked.replace("_", " ").split()
    has = F.lower("direction")
    exact = F.contains(has, F.lit(asked)) | F.contains(F.lit(asked), has)
    text = F.lower(F.concat_ws(" ", "direction", "name", "text"))
    score = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    d = entries.withColumns({"exact": exact, "score": score})
    hits = d.filter("exact").withColumn("score", F.lit(None).cast("int"))
    found = d.agg(F.max(F.col("exact").cast("int")).alias("_any"))
    soft = d.filter((~F.col("exact")) & (F.col("score") > 0)).orderBy(F.col("score").desc(), "key").limit(top)
    soft = beside(soft, found).filter(F.coalesce("_any", F.lit(0)) == 0).drop("_any")
    return hits.unionByName(soft)


def conversation_rollup(messages: DataFrame, n: int = 8, chars: int | None = None) -> DataFrame:
    """The last n messages of each conversation joined to one summary (optionally cut per message).

    The row-number limit is applied before the shuffle, so a very long conversation sends
    only its last messages.
    """
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_b", F.row_number().over(back)).filter(F.col("_b") <= n)
    said = F.substring("text", 1, chars) if chars else F.col("text")
    line = F.concat(F.lit("- "), F.col("role"), F.lit(": "), said)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"])
    return last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.array_join(lines, "\n").alias("summary"))
