"""Jaccard join of word-shingle sets through a token-group matrix.

Documents link when intersection / union >= similarity. The result is the
component of every document; links inside a component that is already joined
are not looked for again, links between different components are all found.

1. Sets. A token is the 64-bit hash of k words. Documents with equal sets are one
   class and only classes go on. A set of n can only reach the similarity with a set
   that holds ceil(s n) of its tokens, so a class with more tokens of its own is done.
   Own tokens are counted twice: those under a fixed bound (the sample) over all
   documents, then all tokens over the classes that the sample leaves open. The order of
   tokens is the same everywhere: by that exact count, then by hash. A class keeps the
   shared ones of its first n - ceil(s n) + 1 tokens (its index prefix is n - ceil(2s / (1 + s) n) + 1
   for sets that are as large or larger); in one of them it meets every set it links with.
2. Groups. Classes that agree in a min-hash are compared with the smallest of them;
   classes that link are one group. Copies of one text with few changes end in a
   few groups however many there are.
3. Matrix. For every token the groups in whose members' prefixes it occurs, with
   the members' sizes and the token's first place (the stored token union). Two
   groups that share a token are bounded: with the first shared token at place p
   of a set of n, at most n - p tokens can be shared.
4. Only pairs of groups whose bound allows a link are opened: the members of the
   smaller group meet members of the other that hold the shared token, pass the
   sizes' bound and the bound at their own first shared token. These pairs are
   compared on the full sets.

Null, empty and blank texts have no set: they are alone. Texts of fewer than k
words have their whole sequence as their one token. Equal rows fall into one
class. The component of a row is the smallest id reachable; a null id counts as
larger than any. Other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .dedup import PLACE, landed, placed
from .store import carried, forget, written
from .words import LOWER, NOT_SPACE, U, lists, mix, slices, words

SIGNS = 3  # pairs of min-hashes for the first groups
BROADCAST_CLASSES = 250_000  # names of classes sent to every task at most (about 40 bytes each)
SALTED = 64  # members compared with one sent copy of a leader's set


@dataclass(frozen=True)
class Rule:
    """Shingle width and similarity as a fraction; all bounds in whole numbers."""

    width: int = 5
    above: int = 80
    below: int = 100

    def linked(self, both: Column, n: Column, m: Column) -> Column:
        return F.lit(self.below) * both >= F.lit(self.above) * (n + m - both)

    def needed(self, n: Column, m: Column) -> Column:
        """Fewest tokens that sets of n and m must share."""
        k = self.above + self.below
        return F.floor((F.lit(self.above) * (n + m) + (k - 1)) / k)

    def sizes_fit(self, small: Column, large: Column) -> Column:
        return F.lit(self.below) * small >= F.lit(self.above) * large

    def probe(self, n):
        return n - (self.above * n + self.below - 1) // self.below + 1

    def probe_column(self, n: Column) -> Column:
        return n - F.floor((F.lit(self.above) * n + (self.below - 1)) / self.below) + 1

    @property
    def sample(self) -> int:
        """Tokens up to this hash are counted first: one and a half times the share of a set that may differ."""
        return min(2**64 - 1, 3 * (self.below - self.above) * 2**64 // (2 * self.below))

    def index(self, n: Column) -> Column:
        k = self.above + self.below
        return n - F.floor((F.lit(2 * self.above) * n + (k - 1)) / k) + 1


def tokens(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct shingles, by row and token."""
    w = words(data, offsets, NOT_SPACE, LOWER)
    at, h = w.grams(width)
    row = w.row[at]
    short = np.flatnonzero((np.diff(w.first) < width) & (np.diff(w.first) > 0))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, w.spans(w.first[short], w.first[short + 1])])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(row):
        return row, h
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by sorted row, modulo 2**64."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    bounds = np.searchsorted(row, np.arange(n + 1))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def digests(row: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    return [sums(row, mix(h ^ U(k)), n).view(np.int64) for k in (0x1234567, 0x89ABCDEF0)]


def sampled_sets(docs: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame:
    """(id, n, digests, min-hashes, sample) of every row."""
    names = ["id", "n", "d1", "d2", *(f"sign{i}" for i in range(SIGNS)), "sample"]
    schema = T.StructType([
        T.StructField("id", docs.schema[doc_id].dataType),
        *(T.StructField(c, T.LongType()) for c in names[1:-1]),
        T.StructField("sample", T.ArrayType(T.LongType())),
    ])

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(1)):
                row, h = tokens(data, offsets, rule.width)
                size = hi - lo
                n = np.bincount(row, minlength=size)
                signs = []
                some = np.flatnonzero(n)
                heads = np.searchsorted(row, some)
                for i in range(SIGNS):
                    s = np.zeros(size, np.uint64)
                    if len(h):  # both min-hashes of a pair have to agree: one alone may come from a passage that many texts share
                        for k in (2 * i + 1, 2 * i + 2):
                            s[some] = mix(s[some] + np.minimum.reduceat(mix(h + U(7919 * k)), heads))
                    signs.append(pa.array(s.view(np.int64)))
                inside = h <= U(rule.sample)
                sample = lists(h[inside].view(np.int64), np.bincount(row[inside], minlength=size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, size), pa.array(n), *map(pa.array, digests(row, h, size)), *signs, sample], names=names)

    return docs.select(F.col(doc_id).alias("id"), text).mapInArrow(run, schema)


def tallies(marks: DataFrame) -> DataFrame:
    """(own, key, n) of (cls, token) rows: how many tokens of its own the class ``key`` has, and how many rows hold the token ``key`` of several classes."""
    counted = marks.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("n"))
    own = counted.filter("a = b").groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    shared = counted.filter("a != b").select(F.lit(False).alias("own"), F.col("token").alias("key"), "n")
    return written(own.select(F.lit(True).alias("own"), "key", "n").unionByName(shared), "token-tallies")


def by_token(marks: DataFrame) -> DataFrame:
    """(cls, token, often, own) of (cls, token) rows, once each: how many rows hold the token, and whether they are of one class.

    Rows are dealt out by token one time; what else is asked of a token is found where its rows are.
    """
    held = marks.repartition("token").groupBy("token", "cls").agg(F.count(F.lit(1)).alias("k"))
    of_token = Window.partitionBy("token")
    own = F.min("cls").over(of_token) == F.max("cls").over(of_token)
    return held.select("cls", "token", F.sum("k").over(of_token).alias("often"), own.alias("own"))


def still_open(classes: DataFrame, counts: DataFrame, key: str, rule: Rule) -> DataFrame:
    """Of (cls, n, ...) rows those that may link, with ``rare``, the number of their own tokens."""
    own = counts.filter("own").select(F.col("key").alias(key), F.col("n").alias("rare"))
    got = classes.join(own, key, "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    return got.filter(F.col("rare") < rule.probe_column(F.col("n")))


def open_classes(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, classes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(cls, n, min-hashes, rare, prefix) of the classes that may link, and the full sets (cls, n, tokens) of them and others.

    In the first count a class is known by its first digest; that two of them share it and a token too is no likelier than two equal token hashes.
    """
    counts = tallies(rows.select(F.col("d1").alias("cls"), F.explode("sample").alias("token")))
    first = written(still_open(classes.select("cls", "n", "d1"), counts, "d1", rule).select("cls"), "open-classes")
    forget(counts)
    names = first.withColumnRenamed("cls", "row")
    signs = [f"sign{i}" for i in range(SIGNS)]
    some = rows.select("row", "id", "n", "d1", "d2", *signs).join(F.broadcast(names) if first.count() <= BROADCAST_CLASSES else names, "row")
    some = written(some.withColumnRenamed("row", "cls"), "open-rows")
    sets = written(full_sets(docs, doc_id, text, rule, some.select("cls", "id", "d1", "d2")), "open-sets")
    dealt = by_token(sets.select("cls", F.explode("tokens").alias("token")))
    places = F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct("often", "token"))))
    of_class = dealt.groupBy("cls").agg(F.count_if("own").alias("rare"), places.alias("all"))
    left = some.select("cls", "n", *signs).join(of_class, "cls").filter((F.col("rare") < rule.probe_column(F.col("n"))) & (F.size("all") > 0))
    kept = F.slice("all", F.lit(1), (rule.probe_column(F.col("n")) - F.col("rare")).cast("int"))
    reps = left.withColumn("prefix", F.transform(kept, lambda x: x["token"])).drop("all")
    reps = written(reps, "shingle-reps")
    forget(first, some)
    return reps, sets


def among(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows whose column is one of the keys, without dealing out the other rows if the keys are few."""
    keys = written(keys.distinct(), "jaccard-keys")
    if keys.count() <= BROADCAST_CLASSES:
        keys = F.broadcast(keys)
    return rows.join(keys, name, "left_semi")


def either(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return pairs.select(F.col(a).alias(name)).unionByName(pairs.select(F.col(b).alias(name)))


def likely(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Of the pairs (a, b) those whose kept first tokens leave a link possible.

    The tokens up to the smaller of the two last kept ones are known on both sides,
    so at most the shared kept tokens and what follows the kept ones can be shared.
    """
    pairs = written(pairs, "jaccard-pairs")
    kept = among(reps.select("cls", "n", "rare", "prefix"), either(pairs, "a", "b", "cls"), "cls")
    rows = pairs.join(kept.toDF("a", "n", "n_own", "own"), "a").join(kept.toDF("b", "m", "m_own", "others"), "b")
    n, m = F.col("n"), F.col("m")
    most = F.size(F.array_intersect("own", "others")) + F.greatest(n - F.col("n_own") - F.size("own"), m - F.col("m_own") - F.size("others"))
    return rows.filter(rule.sizes_fit(F.least(n, m), F.greatest(n, m)) & (most >= rule.needed(n, m))).select("a", "b")


def full_sets(docs: DataFrame, doc_id: str, text: str, rule: Rule, wanted: DataFrame) -> DataFrame:
    """(cls, n, tokens) of the classes in ``wanted`` (cls, id, d1, d2), read from their texts."""
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).alias("own"), F.col(text).alias("text")).join(wanted, F.col("own").eqNullSafe(F.col("id")))

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(3)):
                row, h = tokens(data, offsets, rule.width)
                size = hi - lo
                d1, d2 = digests(row, h, size)
                part = batch.slice(lo, size)
                # another row may have the same id: only the class's own set counts
                same = (d1 == part.column(1).to_numpy(zero_copy_only=False)) & (d2 == part.column(2).to_numpy(zero_copy_only=False))
                bounds = np.searchsorted(row, np.arange(size + 1)).astype(np.int32)
                got = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds).astype(np.int64)), got], names=["cls", "n", "tokens"])
                yield out.filter(pa.array(same))

    return texts.select("cls", "d1", "d2", "text").mapInArrow(run, "cls long, n long, tokens array<long>")


def compared(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of the pairs (a, b) of classes those that link; a class with many partners is sent once for each SALTED of them."""
    partners = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    small = pairs.count() <= BROADCAST_CLASSES
    pairs = pairs.join(partners, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    if small:  # the sets stay where they were read
        pairs, partners = F.broadcast(pairs), F.broadcast(partners)
    sent = sets.join(partners, sets["cls"] == partners["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    own = sets.join(pairs, sets["cls"] == pairs["a"]).select("a", "b", "salt", "n", "tokens")
    both = F.size(F.array_intersect("tokens", "others"))
    return own.join(sent, ["b", "salt"]).filter(rule.linked(both, F.col("n"), F.col("m"))).select("a", "b")


def opened(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of classes of different groups that may link; ``members`` has cls, comp, alone, n, rare and prefix."""
    place = lambda *cols: [*cols, F.posexplode("prefix").alias("_pos", "token")]
    at = (F.col("_pos") + F.col("rare")).alias("pos")  # behind the class's own tokens

    def postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the probe prefixes, and of the shorter index prefixes."""
        all_of = rows.select(*place("cls", "comp", "n", "rare")).select("cls", "comp", "n", at, "token")
        return all_of, all_of.filter(F.col("pos") < rule.index(F.col("n")))

    # Rows of groups of one class are the matrix already. A row counts below zero if none of its members has the
    # token in the index prefix.
    all_of = members.select(*place("comp", "alone", "n", "rare")).select("comp", "alone", "n", at, "token")
    low = F.col("pos") < rule.index(F.col("n"))
    one = all_of.filter("alone").select("token", "comp", "n", F.col("n").alias("n2"), "pos", F.when(low, 1).otherwise(-1).cast("long").alias("rows"))
    many = all_of.filter("NOT alone").groupBy("token", "comp").agg(F.min("n"), F.max("n"), F.min("pos"), F.count("*") * F.when(F.max(low), 1).otherwise(-1))
    matrix = one.union(many)

    # y has the larger sets of a pair and looks up x
    sides = [matrix.toDF("token", s, f"{s}_min", f"{s}_max", f"{s}_pos", f"{s}_rows") for s in "yx"]
    fit = (F.col("x") != F.col("y")) & (F.col("x_min") <= F.col("y_max")) & rule.sizes_fit(F.col("x_max"), F.col("y_min"))
    least_of = lambda x, y: rule.needed(F.greatest(x, F.floor(y * rule.above / rule.below)), y)
    fit &= F.least(F.col("x_max") - F.col("x_pos"), F.col("y_max") - F.col("y_pos")) >= least_of(F.col("x_min"), F.col("y_min"))
    # Written as a condition on both sides (y_min is positive), so that it isn't pushed below the exchange and both sides share one.
    indexed = F.when(F.col("y_min") > 0, F.col("x_rows") > 0)
    met = written(sides[0].join(sides[1], "token").filter(fit & indexed), "matrix-met")
    bound = F.least(F.max("x_max") - F.min("x_pos"), F.max("y_max") - F.min("y_pos"))
    least = least_of(F.min("x_min"), F.min("y_min"))
    pairs = met.groupBy("x", "y").agg(bound.alias("bound"), least.alias("least")).filter("bound >= least")
    pairs = written(pairs.select("x", "y"), "matrix-pairs")
    met = met.join(pairs, ["x", "y"]).select("x", "y", "token", (F.abs("x_rows") <= F.abs("y_rows")).alias("x_first"))

    posted, low = postings(among(members, either(pairs, "x", "y", "comp"), "comp"))
    sides = {"x": low, "y": posted}
    out = []
    for first, then in (("x", "y"), ("y", "x")):
        near = sides[first].select(F.col("comp").alias(first), "token", F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"))
        far = sides[then].select(F.col("comp").alias(then), "token", F.col("cls").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("qp"))
        few = met.filter(F.col("x_first") == (first == "x")).select("x", "y", "token").join(near, [first, "token"])
        small, large = (F.col("pn"), F.col("qn")) if first == "x" else (F.col("qn"), F.col("pn"))
        fits = (small <= large) & rule.sizes_fit(small, large)
        # A pair that links has its first shared token where what follows on either side is still enough.
        room = F.least(F.col("pn") - F.col("pp"), F.col("qn") - F.col("qp"))
        right = far.withColumnRenamed(then, "other").withColumnRenamed("token", "far_token")
        few = few.withColumnRenamed("token", "near_token")
        met_rows = few.join(right, (F.col(then) == F.col("other")) & (F.col("near_token") == F.col("far_token")) & fits & (room >= rule.needed(F.col("pn"), F.col("qn"))))
        out.append(met_rows.select("p", "q", "pn", "qn", "pp", "qp"))
    met_rows = out[0].unionByName(out[1])
    first_shared = F.least(F.col("pn") - F.min("pp"), F.col("qn") - F.min("qp"))
    return met_rows.groupBy("p", "q", "pn", "qn").agg(first_shared.alias("room")).filter(F.col("room") >= rule.needed(F.col("pn"), F.col("qn"))).select(F.col("p").alias("a"), F.col("q").alias("b"))


def join(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component, d1, d2) of every row of ``docs``."""
    rows = written(sampled_sets(docs, doc_id, text, rule).withColumn("row", F.monotonically_increasing_id()), "shingle-samples")
    classes = rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("cls"), F.min("id").alias("least"))
    classes = written(classes, "shingle-classes")
    reps, sets = open_classes(docs, doc_id, text, rows, classes, rule)

    near = []
    for i in range(SIGNS):
        # The class with the fewest tokens of its own is the likeliest to be what the others were made from.
        first = F.min(F.struct("rare", F.col("cls").alias("b"), F.col("n").alias("m"))).alias("first")
        leaders = reps.groupBy(f"sign{i}").agg(first, F.count("*").alias("k")).filter("k > 1").select(f"sign{i}", "first.b", "first.m")
        rows_of = reps.select(F.col("cls").alias("a"), f"sign{i}", "n").join(leaders, f"sign{i}").filter("a != b")
        near.append(rows_of.filter(rule.sizes_fit(F.least("n", "m"), F.greatest("n", "m"))).select("a", "b"))
    near = written(likely(near[0].unionByName(near[1]).unionByName(near[2]).distinct(), reps, rule), "jaccard-near")
    links = written(compared(near, among(sets, either(near, "a", "b", "cls"), "cls"), rule), "jaccard-links")

    groups = components(links)
    members = reps.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), F.col("comp").isNull().alias("alone"), "n", "rare", "prefix")
    pairs = written(likely(opened(members, rule), reps, rule), "jaccard-opened")
    more = compared(pairs, among(sets, either(pairs, "a", "b", "cls"), "cls"), rule)
    whole = components(written(links.unionByName(more), "jaccard-all"))

    of_class = classes.join(whole.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = of_class.groupBy("comp").agg(F.min("least").alias("component"))
    of_class = of_class.join(least, "comp").select("d1", "d2", "n", "component")
    got = rows.select("id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    return got.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), "d1", "d2")


def drop_near_copies(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component: the first by id (null ids last), then by file and row number; rows without words stay."""
    if not {*PLACE}.isdisjoint(docs.columns):
        cols, fields = carried(docs, docs.columns)
        names = dict(zip(docs.columns, (f.name for f in fields), strict=True))
        return drop_near_copies(docs.select(*cols), rule, names[doc_id], names[text]).toDF(*docs.columns)
    docs = landed(docs)
    rows = placed(docs).select(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), *PLACE).alias("id"), F.col(text).alias("text"))
    stay = join(rows, rule, "id", "text").filter(F.col("id") == F.col("component")).select(*(F.col(f"id.{c}").alias(c) for c in PLACE))
    return placed(docs).join(stay, PLACE, "left_semi").drop(*PLACE)
