"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    import public_tokenizers

    from .pieces import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier learnt from labels that aren't held out."""
    from . import toxicity
    from .labelled import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by boosted trees learnt from labels that aren't held out."""
    from . import quality
    from .labelled import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.score(docs, trees)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    from .dedup import decisions

    got = decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op2_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that windows of benchmark items cover."""
    from .decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


ORACLES["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '{WORD}') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g
       FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM bs)),
dw AS (SELECT doc_id, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bs))),
hit AS (SELECT doc_id, dw.l, s, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of every document, and licences that their notices name."""
    from .licenses import scan

    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    return got.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 0.9 similar."""
    from .jaccard import Rule, join

    got = join(table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(width=3, above=90))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base kinds and all spans."""
    from .pii import BASE, find

    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    from .wrappers import extract

    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 35 repeated words cover."""
    from .substrings import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM r),
k AS (SELECT d.doc_id, p, t FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d) d),
n AS (SELECT k.doc_id, count(*) AS n_words, count(x.p) AS n_removed, string_agg(t, ' ' ORDER BY k.p) FILTER (WHERE x.p IS NULL) AS kept
      FROM k LEFT JOIN x ON k.doc_id = x.doc_id AND k.p = x.p GROUP BY k.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""


ORACLES["op1_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its first five positives."""
    from .negatives import mine, prepared

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(table(spark, sf_dir, "embeddings"), label))


ORACLES["op11_hard_negatives"] = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid AS b, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT a, anchor_id, b AS pos, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (a, anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY a, pos ORDER BY s.score DESC, s.id, s.b)
QUALIFY row_number() OVER w <= 10
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that aren't held out."""
    from .language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and the terms that set it off."""
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLES["op13_source_divergence"] = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN kept USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
gp AS (SELECT lang, source, t, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM a JOIN v USING (lang)),
l AS (SELECT lang, t, sum(n) AS n FROM a GROUP BY lang, t),
lp AS (SELECT lang, t, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
         FROM gp x JOIN gp y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(pair.value, 0) AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
term AS (SELECT lang, source, t AS item, (p - q) * (p - q) // (p + q) AS value FROM gp JOIN lp USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term
QUALIFY rank <= 10
"""
