"""Personal data by weak supervision, in DataFrame operations only.

Base spans: e-mail, IP address, card and phone number, by fixed patterns and
checks. They are always reported.

Secrets (keys, tokens, passwords) are learnt. Candidates are words of twelve or
more characters that hold a digit. Labelers vote on each: patterns of known
formats, a gazetteer of names in front of it, its context, and shapes that speak
against. Expectation-maximisation over the counts of the vote patterns (at most
3 ** labelers rows, whatever the corpus) estimates how reliable every labeler is
and how likely a candidate of each pattern is a secret. These posteriors train the
final classifier: naive Bayes over the votes and features of the span itself.

The texts are read once. A table of the matches, each with its number, the length
of the text before it and a little context, goes to the shared folder; positions
are running sums over the matches of one document. Offsets count code points.

Null and empty texts have no spans. Repeated rows, and rows with a null id, are
told apart by a row number and get their own results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

# What counts as base, in the order of reports. Quantifiers are possessive where nothing can be
# given back, so that long runs need neither stack nor second tries; an address starts at its run or after the last match.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{12,}+",
}
# What a text must hold for a pattern to be worth a look.
NEEDS = {"email": "@", "phone": "+"}
KINDS = list(PATTERNS)
BASE = KINDS[:4]

NAMES = "pass(word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential|bearer"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    at = F.sequence(F.lit(1), F.length(number))
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The checks behind the base patterns; candidates for secrets pass."""
    parts = F.split(value, r"\.")
    octets = F.forall(parts, lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)).between(0, 255) & (F.length(F.ltrim(p, F.lit("0"))) <= 3))
    number = digits(value)
    n = F.length(number)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(14, 19), luhn(number)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, id, found): for each kind the matches with the length of the gap before and context on both sides."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for kind, pattern in PATTERNS.items():
        # both walk the same matches: split gives what lies between them
        look = F.contains(t, F.lit(NEEDS[kind])) if kind in NEEDS else t.rlike("[0-9]")
        parts += [F.when(look, F.split(t, pattern, -1)).alias(f"gaps_{kind}"), F.when(look, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias(f"values_{kind}")]
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), *parts)

    def of_kind(kind: str) -> Column:
        gaps = F.col(f"gaps_{kind}")

        def one(v: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), v.alias("value"), F.length(gap).alias("gap"),
                F.right(gap, F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
            )

        return F.coalesce(F.transform(f"values_{kind}", one), F.expr("cast(array() as array<struct<kind:string,i:int,value:string,gap:int,before:string,after:string>>)"))

    return cut.select("row", "id", F.flatten(F.array(*map(of_kind, KINDS))).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """One row per match with start and end, checks passed."""
    rows = found.select("row", F.explode("found").alias("m")).select("row", "m.*")
    run = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(run))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    return rows.filter(valid(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "before", "after")


def votes() -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for a secret, 0 against, 2 for none."""
    v, before = F.col("value"), F.lower("before")
    letters, numbers = v.rlike("[A-Za-z]"), F.length(digits(v))
    known = v.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | v.rlike("^gh[pousr]_[A-Za-z0-9]{20,}$") | v.rlike("^(sk|pk|rk)_[A-Za-z0-9_]{16,}$") | v.rlike("^[0-9a-f]{32,}$") & letters
    return {
        "pattern": F.when(known, 1).otherwise(2),
        "gazetteer": F.when(before.rlike(rf"({NAMES})[\"']?\s*[=:]?\s*[\"']?$"), 1).otherwise(2),
        "context": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[a-z,.]\s+$|^$"), F.when(letters & (numbers >= 4), 2).otherwise(0)).otherwise(2),
        "shape": F.when(letters & (numbers >= 3) & (F.length(v) >= 16), 1).when(~letters | (numbers <= 1), 0).otherwise(2),
    }


def expect(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], dict[int, tuple[float, float]], float]:
    """Posterior of each vote pattern, reliability of each labeler (against, for), and the share of secrets."""
    width = len(next(iter(patterns), ()))
    right = {j: (0.8, 0.8) for j in range(width)}
    share = 0.5
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share / (1 - share))
            for j, vote in enumerate(p):
                no, yes = right[j]
                odds += math.log(yes / (1 - no)) if vote == 1 else math.log((1 - yes) / no) if vote == 0 else 0.0
            post[p] = 1 / (1 + math.exp(-odds))
        total = sum(patterns.values())
        share = min(max((sum(n * post[p] for p, n in patterns.items()) + 1) / (total + 2), 1e-3), 1 - 1e-3)
        for j in range(width):
            # priors of four right votes in five keep labelers that rarely vote near their start
            a1 = 4 + sum(n * post[p] for p, n in patterns.items() if p[j] == 1)
            b1 = 5 + sum(n * post[p] for p, n in patterns.items() if p[j] != 2)
            a0 = 4 + sum(n * (1 - post[p]) for p, n in patterns.items() if p[j] == 0)
            b0 = 5 + sum(n * (1 - post[p]) for p, n in patterns.items() if p[j] != 2)
            right[j] = (min(max(a0 / b0, 0.55), 0.999), min(max(a1 / b1, 0.55), 0.999))
    return post, right, share


def features() -> dict[str, Column]:
    """Features of the final classifier, each with few values."""
    v = F.col("value")
    return votes() | {
        "size": F.least(F.floor(F.length(v) / 8), F.lit(6)).cast("int"),
        "numbers": F.floor(4 * F.length(digits(v)) / F.length(v)).cast("int"),
        "cases": F.when(v.rlike("[a-z]"), 1).otherwise(0) + F.when(v.rlike("[A-Z]"), 2).otherwise(0),
        "quote": F.when(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"), 1).otherwise(0),
    }


def classifier(candidates: DataFrame) -> Column:
    """Probability that a candidate is a secret, as an expression over its columns."""
    named = candidates.select(*[c.alias(k) for k, c in features().items()])
    labelers = list(votes())
    counts = {tuple(r[k] for k in labelers): r["count"] for r in named.groupBy(*labelers).count().collect()}
    if not counts:
        return F.lit(0.0)
    post, _, share = expect(counts)
    p = F.lit(0.0)
    for pattern, value in post.items():
        same = F.lit(True)
        for k, vote in zip(labelers, pattern, strict=True):
            same &= F.col(k) == vote
        p = F.when(same, F.lit(value)).otherwise(p)
    trained = named.withColumn("p", p)
    # one row for every value of every feature
    stacked = trained.select("p", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("int").alias("v")) for k in named.columns])).alias("x"))
    table = stacked.groupBy("x.k", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = sum(counts.values())
    yes_all, no_all = share * total + 1, (1 - share) * total + 1
    odds = F.lit(math.log(share / (1 - share)))
    for k, c in features().items():
        term = F.lit(0.0)
        for r in table:
            if r["k"] == k:
                term = F.when(c == r["v"], F.lit(math.log((r["yes"] + 1) / (yes_all + 2)) - math.log((r["no"] + 1) / (no_all + 2)))).otherwise(term)
        odds = odds + term
    return 1 / (1 + F.exp(-odds))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(id, spans) of every row; spans are (start, end, kind, value, score), by start and kind."""
    found = written(matches(docs, doc_id, text), "pii-matches")
    rows = written(placed(found), "pii-spans")
    candidates = rows.filter("kind = 'secret'")
    # what a base span covers already is no secret of its own
    base = rows.filter("kind != 'secret'")
    scored = candidates.withColumn("score", classifier(candidates)).filter(F.col("score") >= least)
    covered = scored.join(base.select("row", F.col("start").alias("s"), F.col("end").alias("e")), "row").filter("s < end and start < e")
    scored = scored.join(covered.select("row", "start").distinct(), ["row", "start"], "left_anti")
    spans = base.withColumn("score", F.lit(1.0)).unionByName(scored.select(*base.columns, "score"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("place"), "end", "kind", "value", "score"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:bigint,place:int,end:bigint,kind:string,value:string,score:double>>)")
    return found.select("row", "id").join(by_row, "row", "left").select("id", F.coalesce("spans", empty).alias("spans"))
