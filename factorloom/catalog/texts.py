"""Text, knowledge, outcome-library, lifecycle and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import query, r6, show
from .evaluation import factor_frame, factor_long
from .sqlkit import FOUR, ic_daily, long_factors
from ..operators import ic, knowledge, library, lifecycle, scorecard
from ..session import shared_folder
from ..sources.adapters import PANEL_SQL, date_is_wide, table, weekly_panel
from ..streaming import panel_stream

# -- documents ----------------------------------------------------------------------------------

# Word rules in the tables' own vocabulary, with the same shape as the built-in rules.
WORD_RULES = [
    (["nter", "ering"], "capital_flow"),
    (["eaux", "ière"], "volatility_regime"),
    (["und", "sch"], "quality_earnings"),
    (["tion"], "momentum_reversal"),
    (["los", "que"], "sentiment_behavioral"),
    (["on", "an"], "value_contrarian"),
]


def docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))


def rule_sql(text: str, rules=WORD_RULES, lower: bool = False) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for words, label in rules
    )
    return f"CASE {whens} END"


TAGGED = f"""dc AS (SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title, text AS content FROM documents),
tg AS (SELECT *, {rule_sql("(title || ' ' || content)")} AS direction FROM dc)"""


@query("x_keyword_tag", f"WITH {TAGGED} SELECT doc_id, direction FROM tg")
def keyword_tag(spark, sf_dir):
    return knowledge.keyword_tag(docs(spark, sf_dir), WORD_RULES).select("doc_id", "direction")


# Headlines over the parts table: one for each rule, one for none, two that fit several rules.
HEADLINES = ["北向资金净流入", "市场震荡加剧", "业绩超预期", "指数反弹", "散户信心回升", "估值仍然便宜", "成交清淡", "产品更名", "外资看好盈利", "恐慌中下跌"]
NEWS = f"nw AS (SELECT p_partkey AS id, ({HEADLINES!r})[1 + p_partkey % {len(HEADLINES)}] AS title, p_name AS content FROM part)"


def news_sql(rules) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(title, {w!r}) OR contains(content, {w!r})' for w in words)} THEN '{label}'" for words, label in rules)
    return f"CASE {cases} END"


@query("x_news_tag", f"WITH {NEWS} SELECT id, title, {news_sql(knowledge.NEWS_RULES)} AS direction FROM nw")
def news_tag(spark, sf_dir):
    lines = F.array(*[F.lit(h) for h in HEADLINES])
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.element_at(lines, (F.col("p_partkey") % len(HEADLINES) + 1).cast("int")).alias("title"), F.col("p_name").alias("content")
    )
    return knowledge.keyword_tag(p).select("id", "title", "direction")


@query("x_keyword_filter", f"WITH {TAGGED} SELECT doc_id FROM tg WHERE contains(title, 'tion') OR contains(title, 'eaux')")
def keyword_filter(spark, sf_dir):
    return knowledge.keyword_filter(docs(spark, sf_dir), ["tion", "eaux"]).select("doc_id")


@query(
    "x_new_directions",
    f"""WITH {TAGGED} SELECT direction, min(doc_id) AS doc_id FROM tg WHERE direction IS NOT NULL AND direction NOT IN
 (SELECT CASE WHEN lang = 'en' THEN 'capital_flow' ELSE 'none' END FROM documents) GROUP BY direction""",
)
def new_directions(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "capital_flow").otherwise("none").alias("direction"))
    tagged = knowledge.keyword_tag(docs(spark, sf_dir), WORD_RULES).select("direction", "doc_id")
    return knowledge.new_directions(tagged, known, ["doc_id"]).select("direction", "doc_id")


FAM = [(words, label) for words, label in knowledge.FAMILY_RULES]


@query(
    "x_family_match",
    f"""SELECT doc_id, coalesce({rule_sql("lower(text)", WORD_RULES)}, 'generic') AS family, coalesce({rule_sql("lower(text)", FAM)}, 'generic') AS factor_family FROM documents""",
)
def family_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", knowledge.family_match("text", WORD_RULES).alias("family"), knowledge.family_match("text").alias("factor_family"))


# Documents with each second line marked as a heading, so that sections exist.
CHUNKS = r"""hd AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS text FROM documents),
ck AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n(#{1,3} )', chr(1) || '\1', 'g'), chr(1))) AS c, generate_subscripts(string_split(regexp_replace(text, '\n(#{1,3} )', chr(1) || '\1', 'g'), chr(1)), 1) AS n FROM hd),
ct AS (SELECT doc_id, n AS chunk_no, regexp_replace(c, '^\s+|\s+$', '', 'g') AS content FROM ck),
ch AS (SELECT *, trim(regexp_replace(split_part(content, chr(10), 1), '^[# ]+', '')) AS h FROM ct WHERE content <> ''),
tk AS (SELECT doc_id, chunk_no, CASE WHEN h <> '' THEN h ELSE 'Section ' || chunk_no END AS title, content,
  list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 1)) AS tokens FROM ch)"""


def marked_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))
    return knowledge.chunk_markdown(d, "doc_id", "text")


@query("x_chunk_markdown", f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, title, length(content) AS chars, len(tokens) AS n_tokens FROM tk")
def chunk_markdown(spark, sf_dir):
    d = marked_chunks(spark, sf_dir)
    return d.select("doc_id", "chunk_no", "title", F.length("content").cast("bigint").alias("chars"), F.size("tokens").cast("bigint").alias("n_tokens"))


QUESTION = "the and with on of nterti leaux des"


@query(
    "x_retrieve_topk",
    f"""WITH {CHUNKS}, sc AS (SELECT doc_id, chunk_no, len(list_intersect(tokens, string_split('{QUESTION}', ' '))) AS overlap, length(content) AS l FROM tk)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, overlap, {r6('overlap / greatest(1.0, log10(l + 10))', 'score')} FROM sc ORDER BY overlap / greatest(1.0, log10(l + 10)) DESC, doc_id, chunk_no LIMIT 6""",
)
def retrieve(spark, sf_dir):
    d = knowledge.retrieve(marked_chunks(spark, sf_dir), QUESTION, ["doc_id", "chunk_no"]).withColumn("overlap", F.col("overlap").cast("bigint"))
    return show(d, ["doc_id", "chunk_no", "overlap"], ["score"])


@query(
    "x_knowledge_match",
    """SELECT p_partkey AS "key", p_name AS name FROM part WHERE contains(lower(p_name), 'red') OR contains('red', lower(p_name))""",
)
def knowledge_match(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("direction"), F.col("p_name").alias("name"), F.col("p_type").alias("text"))
    return knowledge.knowledge_match(e, "red").select("key", "name")


@query(
    "x_knowledge_match_fuzzy",
    """WITH e AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_name || ' ' || p_type) AS t FROM part), s AS (SELECT k, CAST(contains(t, 'small') AS INT) + CAST(contains(t, 'blue') AS INT) + CAST(contains(t, 'zzz') AS INT) AS score FROM e)
SELECT k AS "key", score FROM s WHERE score > 0 ORDER BY score DESC, k LIMIT 3""",
)
def knowledge_match_fuzzy(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("direction"), F.col("p_name").alias("name"), F.col("p_type").alias("text"))
    return knowledge.knowledge_match(e, "small_blue_zzz").select("key", "score")


@query(
    "x_conversation_rollup",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id, count(*) AS messages, string_agg('- ' || role || ': ' || text, chr(10) ORDER BY turn) AS summary FROM l WHERE b <= 8 GROUP BY conv_id""",
)
def conversation_rollup(spark, sf_dir):
    return knowledge.conversation_rollup(table(spark, sf_dir, "conversations"), 8)


@query(
    "x_json_map_access",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(abs(CAST(json_extract(props, '$.k') AS DOUBLE) / 100) > 0.3 OR abs(value / 100) > 0.3 AS INT) AS exposed FROM events",
)
def json_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    m = F.create_map(F.lit("k"), F.col("p.k") / 100, F.lit("value"), F.col("value") / 100)
    d = e.withColumn("exposures", F.from_json(F.to_json(m), "map<string,double>"))
    return d.select("event_id", F.col("p.k").alias("k"), F.exists(F.map_values("exposures"), lambda v: F.abs(v) > 0.3).cast("int").alias("exposed"))


# -- outcomes --------------------------------------------------------------------------------------

OUTCOMES = """oc AS (SELECT o_orderkey AS id, c_mktsegment AS direction, o_orderpriority || '/' || c_mktsegment || '/' || o_orderstatus AS structure, o_orderpriority AS family,
  CASE o_orderstatus WHEN 'F' THEN 'useful' WHEN 'O' THEN 'marginal' ELSE 'useless' END AS verdict, round(o_totalprice / 10000000, 6) AS rank_ic,
  c_mktsegment AS f1, o_orderpriority AS f2, o_totalprice / 1000000 AS e1, c_acctbal / 20000 AS e2, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey)"""


def outcomes(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("direction"),
        F.concat_ws("/", "o_orderpriority", "c_mktsegment", "o_orderstatus").alias("structure"),
        F.col("o_orderpriority").alias("family"),
        F.when(F.col("o_orderstatus") == "F", "useful").when(F.col("o_orderstatus") == "O", "marginal").otherwise("useless").alias("verdict"),
        F.round(F.col("o_totalprice") / 10000000, 6).alias("rank_ic"),
        F.array("c_mktsegment", "o_orderpriority").alias("input_fields"),
        F.create_map(F.lit("industry"), F.col("o_totalprice") / 1000000, F.lit("size"), F.col("c_acctbal") / 20000).alias("exposures"),
        F.col("o_orderdate").alias("ts"),
        F.array("o_orderpriority", "c_mktsegment").alias("tags"),
    )


STATS = "count(*) AS entries, count(*) FILTER (WHERE verdict = 'useful') AS useful, " + r6("avg(CASE WHEN verdict = 'useful' THEN 1.0 ELSE 0 END)", "win_rate")


@query("g_status_counts", f"WITH {OUTCOMES} SELECT family, {STATS} FROM oc GROUP BY 1")
def status_counts(spark, sf_dir):
    return show(library.count_by(outcomes(spark, sf_dir), "family"), ["family", "entries", "useful"], ["win_rate"])


@query(
    "g_structure_win_rate",
    f"WITH {OUTCOMES} SELECT structure, {STATS} FROM oc GROUP BY 1 ORDER BY avg(CASE WHEN verdict = 'useful' THEN 1.0 ELSE 0 END) DESC, count(*) DESC, 1 LIMIT 10",
)
def structure_win_rate(spark, sf_dir):
    return show(library.structure_win_rate(outcomes(spark, sf_dir)), ["structure", "entries", "useful"], ["win_rate"])


@query("g_field_win_rate", f"WITH {OUTCOMES}, x AS (SELECT f1 AS field, verdict FROM oc UNION ALL SELECT f2, verdict FROM oc) SELECT field, {STATS} FROM x GROUP BY 1")
def field_win_rate(spark, sf_dir):
    return show(library.field_win_rate(outcomes(spark, sf_dir)), ["field", "entries", "useful"], ["win_rate"])


@query(
    "g_direction_insight",
    f"""WITH {OUTCOMES}, x AS (SELECT direction, f1 AS f FROM oc WHERE verdict = 'useful' UNION ALL SELECT direction, f2 FROM oc WHERE verdict = 'useful'),
c AS (SELECT direction, f, count(*) AS c FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY c DESC, f) AS p FROM c),
t AS (SELECT direction, string_agg(f, ',' ORDER BY p) AS top_fields FROM r WHERE p <= 3 GROUP BY 1)
SELECT oc.direction, coalesce(any_value(top_fields), '') AS top_fields, count(*) FILTER (WHERE verdict = 'useful') AS useful, count(*) FILTER (WHERE verdict = 'marginal') AS marginal,
 count(*) FILTER (WHERE verdict = 'useless') AS useless, count(*) FILTER (WHERE verdict = 'useless' AND (abs(e1) > 0.3 OR abs(e2) > 0.3)) AS exposed_failures, {r6('avg(rank_ic)', 'mean_ic')}
FROM oc LEFT JOIN t ON oc.direction = t.direction GROUP BY 1""",
)
def direction_insight(spark, sf_dir):
    d = library.direction_insight(outcomes(spark, sf_dir))
    return show(d, ["direction", "top_fields", "useful", "marginal", "useless", "exposed_failures"], ["mean_ic"])


# Asked: every direction in lower case, its first four letters, a longer text that holds it, and one that fits none.
ASKED = """ask AS (SELECT DISTINCT lower(direction) AS asked FROM oc UNION SELECT DISTINCT left(direction, 4) FROM oc
  UNION SELECT DISTINCT 'all ' || direction || ' names' FROM oc UNION SELECT r_name || '?' FROM region UNION SELECT left(direction, 1) FROM oc)"""


@query(
    "g_direction_guidance",
    f"""WITH {OUTCOMES}, {ASKED},
m AS (SELECT asked, d FROM ask, (SELECT DISTINCT lower(direction) AS d FROM oc) WHERE contains(d, lower(asked)) OR contains(lower(asked), d)),
mm AS (SELECT asked, d, false AS from_all FROM m UNION ALL SELECT asked, d, true FROM ask, (SELECT DISTINCT lower(direction) AS d FROM oc) WHERE asked NOT IN (SELECT asked FROM m)),
x AS (SELECT lower(direction) AS d, f1 AS f FROM oc WHERE verdict = 'useful' UNION ALL SELECT lower(direction), f2 FROM oc WHERE verdict = 'useful'),
c AS (SELECT asked, f, count(*) AS c FROM mm JOIN x USING (d) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY c DESC, f) AS p FROM c),
t AS (SELECT asked, string_agg(f, ',' ORDER BY p) AS top_fields FROM r WHERE p <= 3 GROUP BY 1)
SELECT mm.asked, CAST(any_value(from_all) AS INT) AS from_all, coalesce(any_value(top_fields), '') AS top_fields, count(*) FILTER (WHERE verdict = 'useful') AS useful,
 count(*) FILTER (WHERE verdict = 'marginal') AS marginal, count(*) FILTER (WHERE verdict = 'useless') AS useless,
 count(*) FILTER (WHERE verdict = 'useless' AND (abs(e1) > 0.3 OR abs(e2) > 0.3)) AS exposed_failures, {r6('avg(rank_ic)', 'mean_ic')}
FROM mm JOIN oc ON lower(oc.direction) = mm.d LEFT JOIN t ON t.asked = mm.asked GROUP BY 1""",
)
def direction_guidance(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    d = F.col("direction")
    forms = F.array(F.lower(d), F.left(d, F.lit(4)), F.concat(F.lit("all "), d, F.lit(" names")), F.left(d, F.lit(1)))
    asked = o.select("direction").distinct().select(F.explode(forms).alias("asked"))
    asked = asked.unionByName(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("?")).alias("asked")))
    got = library.direction_guidance(o, asked).withColumn("from_all", F.col("from_all").cast("int"))
    return show(got, ["asked", "from_all", "top_fields", "useful", "marginal", "useless", "exposed_failures"], ["mean_ic"])


@query(
    "g_verdict_samples",
    f"""WITH {OUTCOMES}, r AS (SELECT *, row_number() OVER (PARTITION BY direction, verdict ORDER BY id) AS k FROM oc)
SELECT direction, verdict, string_agg(structure, '|' ORDER BY k) AS samples FROM r WHERE k <= CASE WHEN verdict = 'useful' THEN 5 ELSE 3 END GROUP BY 1, 2""",
)
def verdict_samples(spark, sf_dir):
    return library.verdict_samples(outcomes(spark, sf_dir), ["id"])


@query(
    "g_coverage_counts",
    f"""WITH {OUTCOMES}, x AS (SELECT 'field' AS kind, f1 AS value FROM oc UNION ALL SELECT 'field', f2 FROM oc UNION ALL SELECT 'structure', structure FROM oc UNION ALL SELECT 'direction', direction FROM oc),
u AS (SELECT DISTINCT r_name AS value FROM region UNION SELECT c_mktsegment FROM customer),
c AS (SELECT kind, value, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'field', value, 0 FROM u WHERE value NOT IN (SELECT value FROM x WHERE kind = 'field'))
SELECT kind, value, n, CASE WHEN kind = 'direction' AND n >= 3 THEN 'saturated' WHEN kind = 'field' AND n <= 1 THEN 'underused' ELSE 'normal' END AS state FROM c""",
)
def coverage_counts(spark, sf_dir):
    usable = table(spark, sf_dir, "region").select("r_name").union(table(spark, sf_dir, "customer").select("c_mktsegment"))
    return library.coverage_counts(outcomes(spark, sf_dir), fields=usable).select("kind", "value", "n", "state")


@query("g_unexplored", f"WITH {OUTCOMES} SELECT d AS direction FROM (SELECT unnest(['BUILDING', 'momentum', 'reversal', 'MACHINERY', 'liquidity']) AS d) WHERE d NOT IN (SELECT direction FROM oc)")
def unexplored(spark, sf_dir):
    return library.unexplored(outcomes(spark, sf_dir), ["BUILDING", "momentum", "reversal", "MACHINERY", "liquidity"])


@query(
    "g_direction_priority",
    f"""WITH {OUTCOMES}, d AS (SELECT direction, count(*) AS recorded, count(*) FILTER (WHERE verdict = 'useful' AND rank_ic > 0.015) / count(*) AS w FROM oc GROUP BY 1),
p AS (SELECT *, w * 0.5 - CASE WHEN recorded >= 3 THEN 0.5 ELSE 0 END AS pr, recorded < 3 OR w > 0.1 AS live FROM d), q AS (SELECT *, max(live) OVER () AS l2 FROM p)
SELECT direction, recorded, CASE WHEN w > 0.5 THEN 5 WHEN w > 0.2 THEN 3 WHEN w > 0 THEN 2 ELSE 3 END AS rounds, CASE WHEN w > 0.5 THEN 8 WHEN w > 0.2 THEN 5 WHEN w > 0 THEN 7 ELSE 5 END AS candidates, {r6('pr', 'priority')} FROM q WHERE live OR NOT l2""",
)
def direction_priority(spark, sf_dir):
    return show(library.direction_priority(outcomes(spark, sf_dir)), ["direction", "recorded", "rounds", "candidates"], ["priority"])


@query(
    "g_memory_snapshot",
    f"""WITH {OUTCOMES}, r AS (SELECT verdict AS pattern_type, id, row_number() OVER (PARTITION BY verdict ORDER BY id) AS place FROM oc WHERE family = '1-URGENT' OR direction = '1-URGENT') SELECT pattern_type, id, place FROM r WHERE place <= 3""",
)
def memory_snapshot(spark, sf_dir):
    d = outcomes(spark, sf_dir).withColumnRenamed("verdict", "pattern_type")
    return library.memory_snapshot(d, "1-URGENT", ["id"]).select("pattern_type", "id", "place")


@query(
    "g_novelty_penalty",
    f"""WITH {OUTCOMES}, f AS (SELECT family, count(*) / sum(count(*)) OVER () AS share FROM oc GROUP BY 1),
k AS (SELECT family, count(*) FILTER (WHERE verdict = 'useless') AS failed, count(*) FILTER (WHERE verdict = 'marginal') AS findings, count(*) AS c FROM oc GROUP BY 1),
b AS (SELECT family, CASE WHEN failed = 0 AND findings = 0 THEN 0.3 ELSE least(0.5, 0.1 * failed + 0.05 * findings) END AS bonus FROM k),
x AS (SELECT family FROM k ORDER BY c DESC, family LIMIT 1),
n AS (SELECT id AS "key", oc.family, greatest(0, greatest(0.1, 1 - share) - 0.3 * share) AS s, bonus FROM oc JOIN f ON oc.family = f.family JOIN b ON b.family = oc.family
  WHERE verdict = 'useful' AND oc.family NOT IN (SELECT family FROM x))
SELECT "key", family, {r6('s', 'novelty_score')}, {r6('bonus', 'bonus')} FROM n ORDER BY s + bonus DESC, "key" LIMIT 10""",
)
def novelty(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    tried = o.groupBy("family").agg(
        F.count_if(F.col("verdict") == "useless").alias("failed"), F.count_if(F.col("verdict") == "marginal").alias("findings"), F.count(F.lit(1)).alias("c")
    )
    bonus = tried.select("family", scorecard.exploration_bonus(F.col("failed"), F.col("findings")).alias("bonus"))
    candidates = o.filter("verdict = 'useful'").select(F.col("id").alias("key"), "family").join(bonus, "family")
    crowded = tried.orderBy(F.col("c").desc(), "family").limit(1)  # the family that is explored most is left out
    return show(scorecard.novelty(candidates, o, bonus="bonus", excluded=crowded), ["key", "family"], ["novelty_score", "bonus"])


@query(
    "i_constraint_scores",
    f"""WITH {OUTCOMES}, s AS (SELECT id, least(1.0, abs(e2)) AS mc, CASE WHEN verdict = 'useful' THEN '' ELSE structure END AS hyp, direction AS family, rank_ic * 20 AS mono, CAST(length(structure) % 9 AS INT) AS d FROM oc)
SELECT id, {r6('greatest(0, 1 - mc)', 'originality_score')}, {r6("CASE WHEN hyp = '' THEN 0.45 ELSE least(1.0, 0.6 + CASE WHEN contains(lower(hyp), lower(family)) THEN 0.2 ELSE 0 END + least(0.2, greatest(mono, 0) * 0.2)) END", 'alignment_score')},
 {r6('1 - least(d / 6.0, 1) * 0.55', 'complexity_score')}, {r6('CASE WHEN d > 0 THEN 0.95 ELSE 0 END', 'safety_score')} FROM s""",
)
def constraint_scores(spark, sf_dir):
    s = outcomes(spark, sf_dir).select(
        "id", F.least(F.lit(1.0), F.abs(F.col("exposures")["size"])).alias("max_corr"), F.when(F.col("verdict") == "useful", "").otherwise(F.col("structure")).alias("hypothesis"),
        F.col("direction").alias("family"), (F.col("rank_ic") * 20).alias("monotonicity"), (F.length("structure") % 9).alias("tree_depth"),
    )
    return show(scorecard.constraint_scores(s), ["id"], ["originality_score", "alignment_score", "complexity_score", "safety_score"])


@query(
    "t_alerts",
    """SELECT event_id, event_type FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END, ts, event_id LIMIT 50""",
)
def alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return library.alerts(e.withColumn("severity", level), ["ts", "event_id"]).select("event_id", "event_type")


@query("s_retain_last_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def retain_last(spark, sf_dir):
    return library.retain_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 30).select("user_id", "event_id")


@query("s_append_and_retain", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def append_retain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    return library.append_and_retain(e.filter("event_type = 'error'").drop("event_type"), e.filter("event_type <> 'error'").drop("event_type"), ["ts", "event_id"], 500).select("event_id")


def experiment_records(spark, sf_dir):
    """Nested experiment records (as JSON text, read back with a schema) from orders."""
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("experiment_id"), F.col("o_orderdate").cast("date").alias("timestamp"), F.col("o_orderpriority").alias("experiment_type"),
            F.struct(
                F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 1000000).alias("annual_return"),
                F.when(F.col("o_orderstatus") == "O", F.lit(0.0)).alias("test_annual_return"),
                F.lit(-0.01).alias("train_annual_return"),
            ).alias("metrics"),
            F.struct(F.col("o_orderstatus").alias("label")).alias("notes"),
        )
    )
    schema = "experiment_id bigint, timestamp date, experiment_type string, metrics struct<annual_return: double, test_annual_return: double, train_annual_return: double>, notes struct<label: string>"
    return o.select(F.from_json(doc, schema).alias("r")).select("r.*")


@query(
    "s_scan_experiments",
    f"""SELECT o_orderkey AS experiment_id, CAST(o_orderdate::DATE AS VARCHAR) AS "timestamp", o_orderpriority AS experiment_type, '{{"label":"' || o_orderstatus || '"}}' AS notes,
 {r6("CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000000 ELSE -0.01 END", 'primary_metric')} FROM orders""",
)
def scan_experiments(spark, sf_dir):
    d = library.experiments(experiment_records(spark, sf_dir)).withColumn("timestamp", F.col("timestamp").cast("string"))
    return show(d, ["experiment_id", "timestamp", "experiment_type", "notes"], ["primary_metric"])


@query("s_latest_runs", 'SELECT o_orderkey AS experiment_id, CAST(o_orderdate::DATE AS VARCHAR) AS "timestamp" FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 20')
def latest_runs(spark, sf_dir):
    d = library.latest_runs(experiment_records(spark, sf_dir), 20)
    return d.select("experiment_id", F.col("timestamp").cast("string").alias("timestamp"))


@query(
    "s_factor_provenance",
    """WITH x AS (SELECT l_partkey AS factor_id, l_orderkey AS e, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT factor_id, arg_max(e, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(e AS VARCHAR), 12, '0')) AS experiment_id FROM x GROUP BY 1""",
)
def provenance(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    runs = runs.select(F.array("l_partkey").alias("factor_ids"), F.col("o_orderkey").alias("experiment_id"), F.col("o_orderdate").alias("timestamp"))
    return library.newest_provenance(runs).select("factor_id", "experiment_id")


@query(
    "s_scan_factor_library",
    f"""WITH {OUTCOMES} SELECT direction AS library, id AS factor_id, verdict AS status, {r6('rank_ic', 'rank_ic')} FROM oc""",
)
def scan_factor_library(spark, sf_dir):
    entry = F.struct(F.col("id").alias("factor_id"), F.struct(F.col("verdict").alias("status")).alias("spec"), F.struct("rank_ic").alias("scorecard"))
    docs_ = outcomes(spark, sf_dir).select("direction", F.to_json(F.struct(F.array(entry).alias("entries"))).alias("j"))
    schema = "entries array<struct<factor_id: bigint, spec: struct<status: string>, scorecard: struct<rank_ic: double>>>"
    e = docs_.select("direction", F.explode(F.from_json("j", schema)["entries"]).alias("e"))
    d = e.select(F.col("direction").alias("library"), "e.factor_id", F.col("e.spec.status").alias("status"), F.col("e.scorecard.rank_ic").alias("rank_ic"))
    return show(d, ["library", "factor_id", "status"], ["rank_ic"])


# -- lifecycle -------------------------------------------------------------------------------------------

LIFE = """lf AS (SELECT o_orderkey AS id, (['candidate', 'observe', 'paper', 'pilot', 'live'])[1 + o_orderkey % 5] AS status, CAST(o_custkey % 150 AS INT) AS days, (o_totalprice - 200000) / 10000000 AS oos,
  (o_totalprice - 250000) / 10000000 AS cost, (o_orderkey % 10) / 10.0 AS crowd, o_orderdate::DATE AS ev, o_totalprice / 10000000 AS ric, (o_custkey % 7 - 3) / 100.0 AS reg FROM orders)"""


def lifecycle_entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(s) for s in ("candidate", "observe", "paper", "pilot", "live")])
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"),
        (F.col("o_custkey") % 150).cast("int").alias("days_since_eval"),
        ((F.col("o_totalprice") - 200000) / 10000000).alias("oos_ic"),
        ((F.col("o_totalprice") - 250000) / 10000000).alias("cost_adj_ic"),
        (F.col("o_orderkey") % 10 / 10.0).alias("crowding"),
        ((F.col("o_custkey") % 7 - 3) / 100.0).alias("regime_adj_ic"),
        F.col("o_orderdate").cast("date").alias("evaluated_at"),
        (F.col("o_totalprice") / 10000000).alias("rank_ic"),
    )


NEXT = """CASE WHEN status = 'candidate' AND lv > 0.015 THEN 'observe' WHEN status = 'observe' AND days >= 30 AND oos > 0.01 AND cost > 0 THEN 'paper' WHEN status = 'observe' AND lv < 0.005 AND days > 60 THEN 'rejected'
 WHEN status = 'paper' AND days >= 60 AND oos > 0.015 AND crowd < 0.5 THEN 'pilot' WHEN status = 'paper' AND oos < 0 AND days > 90 THEN 'observe' WHEN status = 'pilot' AND days >= 90 AND cost > 0.01 AND reg > 0 THEN 'live'
 WHEN status = 'pilot' AND cost < 0 AND days > 120 THEN 'retired' WHEN status = 'live' AND ((lv < 0.005 AND days > 60) OR crowd > 0.7) THEN 'retired' ELSE status END"""


@query("m_lifecycle_recommend", f"WITH {LIFE} SELECT id, status, {NEXT} AS target FROM (SELECT *, CASE WHEN oos <> 0 THEN oos ELSE ric END AS lv FROM lf)")
def lifecycle_recommend(spark, sf_dir):
    return lifecycle.recommend(lifecycle_entries(spark, sf_dir)).select("id", "status", "target")


ALLOWED = ", ".join(f"('{a}', '{b}')" for a, ts in lifecycle.TRANSITIONS.items() for b in ts)


@query(
    "m_lifecycle_transitions",
    f"""WITH {LIFE}, q AS (SELECT id, status, (['observe', 'paper', 'retired', 'rejected'])[1 + id % 4] AS target FROM lf) SELECT id, status, target FROM q WHERE (status, target) IN ({ALLOWED})""",
)
def lifecycle_transitions(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("observe", "paper", "retired", "rejected")])
    q = lifecycle_entries(spark, sf_dir).select("id", "status", F.element_at(names, (F.col("id") % 4 + 1).cast("int")).alias("target"))
    return lifecycle.allowed(q).select("id", "status", "target")


@query(
    "m_archive_underperforming",
    f"""WITH {LIFE}, e AS (SELECT id, CASE WHEN status = 'live' THEN 'rejected' ELSE status END AS status, CASE WHEN id % 3 > 0 THEN ev END AS ev, ric FROM lf)
SELECT id, status FROM e WHERE status = 'rejected' OR (status = 'observe' AND CASE WHEN ev IS NOT NULL THEN date_diff('day', ev, DATE '1999-01-01') > 30 ELSE abs(ric) < 0.015 END)""",
)
def archive(spark, sf_dir):
    e = lifecycle_entries(spark, sf_dir).withColumns(
        {"status": F.when(F.col("status") == "live", "rejected").otherwise(F.col("status")), "evaluated_at": F.when(F.col("id") % 3 > 0, F.col("evaluated_at"))}
    )
    return lifecycle.archive(e, "1999-01-01").select("id", "status")


@query(
    "m_lineage",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 WHEN p_partkey % 100 > 0 THEN p_partkey - 10 END AS parent FROM part),
w(id, root, depth) AS (SELECT id, id, 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.root, w.depth + 1 FROM n JOIN w ON n.parent = w.id)
SELECT id, root, CAST(depth AS BIGINT) AS depth, 0 AS cyclic FROM w""",
)
def lineage(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.when(k % 10 > 0, k - 1).when(k % 100 > 0, k - 10)
    d = lifecycle.lineage(table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent")))
    return d.withColumn("cyclic", F.col("cyclic").cast("int"))


@query("m_lineage_roots", "SELECT p_partkey AS id FROM part WHERE p_partkey % 100 = 0")
def lineage_roots(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.when(k % 10 > 0, k - 1).when(k % 100 > 0, k - 10)
    return lifecycle.roots(table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent"))).select("id")


@query("m_latest_version", "SELECT o_custkey AS factor_id, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_version(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("factor_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"))
    return lifecycle.latest_version(v).select("factor_id", "version")


# -- user factors and streams -----------------------------------------------------------------------------


@query(
    "u_user_factor",
    f"""WITH {PANEL_SQL}, facs AS (SELECT 'spread' AS factor_id, date, asset, (high - low) / close AS factor_value, lead(close, 5) OVER (PARTITION BY asset ORDER BY date) / close - 1 AS label FROM panel), {ic_daily('facs')}
SELECT factor_id, count(*) AS n_dates, {r6('avg(rank_ic)', 'ic_mean')} FROM daily GROUP BY 1""",
)
def user_factor(spark, sf_dir):
    from ..plans import user

    user.register("spread", lambda p: p.select("date", "asset", ((F.col("high") - F.col("low")) / F.col("close")).alias("factor_value")))
    long = user.evaluate(ic.with_label(weekly_panel(spark, sf_dir)), ["spread"])
    return show(ic.batch_rank_ic(long, wide=date_is_wide(spark, sf_dir)), ["factor_id", "n_dates"], ["ic_mean"])


@query(
    "u_common_dates",
    f"WITH {long_factors()} SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM facs WHERE factor_value IS NOT NULL GROUP BY date HAVING count(DISTINCT factor_id) = 4",
)
def common_dates(spark, sf_dir):
    df, _ = factor_frame(spark, sf_dir)
    d = df.groupBy("date").agg(*[F.count(f"`{f}`").alias(f"k{i}") for i, f in enumerate(FOUR)])
    d = d.filter(F.least(*[f"k{i}" for i in range(len(FOUR))]) > 0)
    return show(d.withColumn("n", sum((F.col(f"k{i}") for i in range(len(FOUR))), F.lit(0).cast("bigint"))), ["date", "n"], [])


@query(
    "z_stream_ic_log",
    f"""WITH {long_factors()}, {ic_daily('facs')} SELECT factor_id, count(*) AS n, CAST(max(date) AS VARCHAR) AS last_date, {r6('avg(rank_ic)', 'mean_ic')} FROM daily GROUP BY 1""",
)
def stream_ic_log(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    home = _scratch(spark)
    panel_stream.append_ic(ic.daily_ic(long, wide=wide).repartition(4), f"{home}/log")
    panel_stream.run_ic_log(spark, f"{home}/log", f"{home}/ckpt", f"{home}/stats", 1).awaitTermination()
    d = spark.read.parquet(f"{home}/stats").withColumn("last_date", F.col("last_date").cast("string"))
    return show(d, ["factor_id", "n", "last_date"], ["mean_ic"])


@query("z_stream_panel_upsert", f"WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('close * CASE WHEN volume > 60 THEN 2 ELSE 1 END', 'close', 4)} FROM panel")
def stream_panel_upsert(spark, sf_dir):
    home = _scratch(spark)
    p = weekly_panel(spark, sf_dir).select("date", "asset", "close", "volume")
    again = p.filter(F.col("volume") > 60).withColumn("close", F.col("close") * 2)
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("asset", T.StringType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("arrived", T.LongType())])
    # The panel with outdated copies of the rows that are corrected later, then the corrections: the stream is
    # stopped in between and goes on from its checkpoint.
    old = again.withColumn("close", F.lit(-1.0))
    for arrivals in ((old.withColumn("arrived", F.lit(1)), p.withColumn("arrived", F.lit(2))), (again.withColumn("arrived", F.lit(3)),)):
        for rows in arrivals:
            rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(f"{home}/in")
        panel_stream.run_panel_upsert(spark, schema, f"{home}/in", f"{home}/table", f"{home}/ckpt", arrived="arrived").awaitTermination()
    return show(spark.read.parquet(f"{home}/table"), ["date", "asset"], ["close"], 4)


def _scratch(spark) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
