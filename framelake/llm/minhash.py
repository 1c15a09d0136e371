"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text's set of 5-word shingles gives its size, digest and 125 minima (one pass).  Equal sets are one class; classes
   alone go on.
2. Bands of minima make buckets, as many as keep the probability that a pair of the least similarity misses all of them below 1e-6:
   25 of 5 for 0.85 (4e-7), 31 of 4 for 0.8 (8e-8).
3. Of buckets with the same members one is kept.  In a bucket with several components, members are compared with a few centres, never
   with all others.  Centres are members outside the bucket's largest component which were none before; once there are no
   more of them, every two members of different components have been compared: so buckets of at most ``SMALL`` members end.
   The members of larger ones are dealt again by the rarest shingles of their full sets, as many as any two of the least similarity must
   share one of: those who share a common passage only part.  The place of a shingle in the order of its set bounds what two sets that meet there first can
   share, so each row tells the largest set that it can be linked with there, and only members within each other's bounds are compared.  A member is a
   centre only if another component has one within its bounds.  These buckets take centres until none has any more to take, so no pair is left out.
4. A pair's signatures are compared 25 minima at a time; it is dropped once the posterior probability (uniform
   prior) of the least similarity (``percent``) is below ``MISS``.  Survivors are verified on their full sets.
5. Links become components by alternating large-star and small-star steps.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component; a text
of fewer than five words has one shingle; very long texts are taken whole, words of any length too; repeated rows get equal results;
rows of one id with different texts are documents of their own that share the id; a null id is below all others; other columns,
whatever their names, are not read, and kept by ``drop_near_duplicates``.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, stage
from .hashing import FOLD, U, mixed, word_hashes

SHINGLE, BANDS, BAND_ROWS = 5, 25, 5
MINIMA = BANDS * BAND_ROWS
STEP = 25
PERCENT = 85
MISS, MISS_BANDS = 1e-7, 1e-6
#: Centres of a bucket in its first rounds: one, with which most near copies find their component, then up to two.
FIRST_ROUNDS = (1, 2)
#: Members of a bucket of which all may be centres in one round.
SMALL = 12
#: Centres of a larger bucket of a shingle in its first round, and how many times as many in each later one.
MORE = 8
#: Sizes of sets are put in classes, each this much wider than the last, to find the members within each other's bounds.
WIDER = 1.01
#: Which members of a bucket are compared: those of two components that are within each other's bounds.
COMPARED = "c <> m_c and m_n <= nd_most and nd_n <= m_most"
SALTS = 16
NULL_ID = -(2**63)
_rng = np.random.default_rng(104729)
MULTIPLY, ADD = _rng.integers(0, 2**64, MINIMA, dtype=U) | U(1), _rng.integers(0, 2**64, MINIMA, dtype=U)
PLACE = _rng.integers(0, 2**64, max(SHINGLE, BAND_ROWS), dtype=U) | U(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes((text or "").encode("utf-8", "replace").translate(FOLD))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mixed((h * PLACE[: len(h)]).sum(keepdims=True, dtype=U) + U(len(h)))
    total = h[: len(h) - SHINGLE + 1] * PLACE[0]
    for j in range(1, SHINGLE):
        total += h[j : len(h) - SHINGLE + 1 + j] * PLACE[j]
    return np.unique(mixed(total))


def signature(x: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 2**64 - 1, U)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * MULTIPLY + ADD).min(0), out=out)
    return (out >> U(32)).astype(np.uint32)


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, minima in each): the longest bands that a pair of similarity percent misses with probability MISS_BANDS at most."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (MINIMA // rows)
    rows = next((r for r in range(BAND_ROWS, 1, -1) if missed(r) <= MISS_BANDS), 1)
    return MINIMA // rows, rows


def band_keys(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n, size = banding(percent)
    rows = sig[: n * size].reshape(n, size).astype(U)
    return mixed((rows * PLACE[:size]).sum(1, dtype=U) * U(n) + np.arange(n, dtype=U)).view(np.int64)


def least_matches(step: int = STEP, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """After each further step minima, the fewest matches that keep P(similarity >= percent) at miss or more."""
    t, out = percent / 100, []
    for n in range(step, MINIMA + 1, step):
        below = lambda m: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))  # noqa: E731, B023
        out.append(next(m for m in range(n + 1) if below(m) >= miss))
    return out


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID).cast("long"))


def checksum(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def signatures(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(nd_id, nd_text, nd_n, nd_digest, nd_sig, nd_bands) of each row; nd_text is the text's checksum."""

    def compute(batches):
        for batch in batches:
            n, digest, sigs, bands = [], [], [], []
            for text in batch.column(2):
                x = shingles(text.as_py())
                n.append(len(x))
                if len(x):
                    s = signature(x)
                    digest.append(set_digest(x))
                    sigs.append(s.tobytes())
                    bands.append(band_keys(s, percent))
                else:
                    digest.append(None), sigs.append(None), bands.append(None)  # noqa: B018
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["nd_id", "nd_text", "nd_n", "nd_digest", "nd_sig", "nd_bands"])

    return docs.select(key_of(F.col(id_col)).alias("nd_id"), checksum(F.col(text_col)).alias("nd_text"), F.col(text_col)).mapInArrow(compute, "nd_id long, nd_text string, nd_n long, nd_digest binary, nd_sig binary, nd_bands array<long>")


def set_digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, nd_set) of the classes in nodes (node, nd_id, nd_digest)."""

    def compute(batches):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_digest, sets), pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["nd_digest", "nd_set"])

    ids = nodes.select("nd_id").distinct()
    sets = docs.select(key_of(F.col(id_col)).alias("nd_id"), F.col(text_col)).join(ids, "nd_id", "left_semi").drop("nd_id").mapInArrow(compute, "nd_digest binary, nd_set array<long>")
    return sets.join(nodes.select("node", "nd_digest"), "nd_digest").drop("nd_digest").dropDuplicates(["node"])


def likely(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that no comparison of signature steps rules out, nor their sizes."""
    least = np.array(least_matches(percent=percent))
    rows = pairs.join(sigs.select(F.col("node").alias("a"), F.col("nd_n").alias("na"), F.col("nd_sig").alias("sa")), "a")
    rows = rows.join(sigs.select(F.col("node").alias("b"), F.col("nd_n").alias("nb"), F.col("nd_sig").alias("sb")), "b")
    rows = rows.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, MINIMA) for k in (2, 3))
            alive, matched = np.arange(len(x)), np.zeros(len(x), int)
            for k, m in enumerate(least):
                own = slice(k * STEP, (k + 1) * STEP)
                matched[alive] += (x[alive, own] == y[alive, own]).sum(1)
                alive = alive[matched[alive] >= m]
            yield batch.select([0, 1]).take(pa.array(alive))

    return rows.mapInArrow(prune, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("nd_set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("nd_set").alias("sb")), "b")
    rows = rows.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return rows.filter(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges but the least of its component, and that least node.

    Alternates star steps until the edges stay; each round is a written table, and only a count and a checksum come back.
    """
    seen = None
    while True:
        before, edges = edges, stage(_small_star(_large_star(edges)), "stars")
        discard(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges
        seen = now


def _labelled(members: DataFrame, stars: DataFrame | None) -> DataFrame:
    """members with the component c that stars give each node."""
    if stars is None:
        return members.withColumn("c", F.col("node"))
    return members.join(stars.select(F.col("a").alias("node"), F.col("b").alias("star")), "node", "left").withColumn("c", F.coalesce("star", "node")).drop("star")


def _open(own: DataFrame, used: DataFrame | None) -> DataFrame:
    """Rows of own which are outside their bucket's largest component and were no centre yet."""
    counts = own.groupBy("nd_k", "c").agg(F.count(F.lit(1)).alias("n"))
    order = F.shiftleft(F.col("n"), 31) + F.xxhash64("c").bitwiseAND(F.lit((1 << 31) - 1))
    largest = counts.groupBy("nd_k").agg(F.max_by("c", order).alias("c_big"), F.count(F.lit(1)).alias("nc")).filter("nc > 1").drop("nc")
    rows = own.join(largest, "nd_k").filter("c <> c_big").drop("c_big")
    return rows if used is None else rows.join(used, ["nd_k", "node"], "left_anti")


def _largest(percent: int, before: str = "0") -> Column:
    """nd_most: size of the largest set of similarity percent / 100 with one of nd_n shingles, of which it has none of the first before."""
    return F.expr(f"({100 + percent} * (nd_n - ({before})) - {percent} * nd_n) div {percent}")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(log(WIDER))).cast("int")


def _within(rows: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Rows of own for which another component has a member in the bucket, neither larger than the other's nd_most.

    Members are met by classes of their size, as far as a row's bounds go.
    """
    others = own.groupBy(F.col("nd_k").alias("m_k"), _size_class(F.col("nd_n")).alias("m_size"), F.col("nd_n").alias("m_n"), F.col("c").alias("m_c")).agg(F.max("nd_most").alias("m_most"))
    least = F.greatest(F.lit(1), F.floor(percent * F.col("nd_n") / 100))
    rows_by_size = rows.withColumn("size", F.explode(F.sequence(_size_class(least), _size_class(F.col("nd_most")))))
    met = rows_by_size.join(others, (F.col("nd_k") == F.col("m_k")) & (F.col("size") == F.col("m_size")) & F.expr(COMPARED), "left_semi")
    return met.drop("size").distinct()


def _prefixes(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(nd_k, node, nd_n, nd_id, nd_most): nodes of left by each shingle of their prefixes; nodes of similarity percent / 100 or more share one, and
    are no larger than each other's nd_most at the first that they share.

    Shingles are put in order by the number of left's nodes that have them, rare ones first.  Two sets with an intersection of c at least share one of
    their first n - c + 1, and c is no less than percent of either size.  Shingles of one node come first and are only counted.
    """
    rows = sets.join(left, "node").select("node", "nd_n", "nd_id", F.explode("nd_set").alias("nd_k"))
    several = rows.groupBy("nd_k").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    rows = rows.join(several, "nd_k")
    order = Window.partitionBy("node").orderBy("f", "nd_k")
    rows = rows.withColumns({"at": F.row_number().over(order), "shared": F.count(F.lit(1)).over(Window.partitionBy("node"))})
    length = F.expr(f"nd_n - ({percent} * nd_n + 99) div 100 + 1")
    rows = rows.filter(F.col("at") <= length - (F.col("nd_n") - F.col("shared"))).withColumn("nd_most", _largest(percent, "nd_n - shared + at - 1"))
    return rows.select("nd_k", "node", "nd_n", "nd_id", "nd_most")


def _distinct_sets(members: DataFrame, stars: DataFrame | None) -> DataFrame:
    """Members of one bucket for each set of nodes that has several components: of shingles the first in order, with the widest bounds."""
    h = F.xxhash64("node")
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("y")]
    sets = _labelled(members, stars).groupBy("nd_k").agg(*marks, F.sum("nd_most").alias("bounds"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    sets = sets.groupBy("n", "x", "y").agg(F.max(F.struct("bounds", "nd_k"))["nd_k"].alias("nd_k"))
    return stage(members.join(sets.select("nd_k", F.col("n").alias("nd_size")), "nd_k"), "members")


def _centres(rows: DataFrame, most: int, turn: Column) -> DataFrame:
    """Up to most centres of each bucket out of rows, by hash parts, so a large bucket is not put in order."""
    pick = lambda c: F.min_by(c, "turn")
    rows = rows.withColumns({"turn": turn, "part": F.pmod(F.xxhash64(F.lit(-1), "node"), F.lit(most))})
    return rows.groupBy("nd_k", "part").agg(pick("node").alias("m_node"), pick("nd_n").alias("m_n"), pick("c").alias("m_c"), pick("nd_most").alias("m_most")).drop("part")


def _all_centres(rows: DataFrame) -> DataFrame:
    return rows.select("nd_k", F.col("node").alias("m_node"), F.col("nd_n").alias("m_n"), F.col("c").alias("m_c"), F.col("nd_most").alias("m_most"))


class Links:
    """Pairs compared so far, and the components of those that are linked."""

    def __init__(self, sigs: DataFrame, sets: DataFrame, percent: int):
        self.sigs, self.sets, self.percent = sigs, sets, percent
        self.stars: DataFrame | None = None
        self.tested: DataFrame | None = None

    def compare(self, own: DataFrame, centres: DataFrame) -> None:
        """Compare the members of own with their buckets' centres within bounds, but for those of their component."""
        pairs = own.join(centres, "nd_k").filter(COMPARED).select(F.least("node", "m_node").alias("a"), F.greatest("node", "m_node").alias("b")).distinct()
        pairs = stage(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            found = stage(verified(likely(pairs, self.sigs, self.percent), self.sets, self.percent), "links")
            if not found.isEmpty():
                before, self.stars = self.stars, components(found if self.stars is None else found.union(self.stars))
                discard(before)
            discard(found)
        before = self.tested
        self.tested = pairs if before is None else stage(before.union(pairs), "tested")  # one table, so plans do not grow
        if before is not None:
            discard(before, pairs)


def _settled(members: DataFrame, links: Links, rounds: tuple[int, ...] | None, first: Column | None) -> DataFrame:
    """Compare the members of each bucket with its centres, as many in each round as rounds tell, and all that small buckets have; (node, nd_n, nd_id)
    of the buckets that still have open members.  Without rounds they go on, with more centres each, until no bucket has."""
    spark, used, r = members.sparkSession, None, 0
    while True:
        own = stage(_labelled(members, links.stars), "labelled")
        discard(members)
        waiting = stage(_open(own, used) if rounds else _within(_open(own, used), own, links.percent), "open")
        members = own.join(waiting.select("nd_k").distinct(), "nd_k", "left_semi").drop("c")
        if waiting.isEmpty() or rounds and r > len(rounds):
            left = stage(members.select("node", "nd_n", "nd_id").distinct(), "left")
            discard(own, waiting)
            return left
        most = rounds[r] if rounds and r < len(rounds) else None if rounds else MORE ** (r + 1)
        turn = first if first is not None and r == 0 else F.xxhash64(F.lit(r), "node")
        small = F.col("nd_size") <= SMALL
        centres = _all_centres(waiting.filter(small))
        if rounds and r < len(rounds):  # in the first rounds one or two settle most of the small buckets too
            centres = _centres(waiting, most, turn)
        elif most:
            centres = centres.union(_centres(waiting.filter(~small), most, turn))
        centres = stage(centres, "centres")
        links.compare(own, centres)
        now = centres.select("nd_k", F.col("m_node").alias("node"))
        used = now if used is None else stage(used.union(now), "used")
        members = stage(members, "members")
        discard(own, waiting)
        release(spark)
        r += 1


def links_and_components(docs: DataFrame, id_col: str, text_col: str, base: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(nd_digest, component): the least id of the component of each class that shares a bucket; None if none does."""
    classes = base.filter("nd_n > 0")
    bands = classes.select("nd_digest", "nd_n", F.explode("nd_bands").alias("nd_k"))
    short = F.xxhash64("nd_digest")
    shared = bands.groupBy("nd_k").agg(F.min(short).alias("lo"), F.max(short).alias("hi")).filter("lo < hi").select("nd_k")
    members = stage(bands.join(shared, "nd_k", "left_semi").dropDuplicates(["nd_k", "nd_digest"]), "buckets")
    least = classes.groupBy("nd_digest").agg(F.min("nd_id").alias("nd_id"))
    nodes = stage(least.join(members.select("nd_digest").distinct(), "nd_digest", "left_semi").withColumn("node", F.monotonically_increasing_id()), "nodes")
    if nodes.isEmpty():
        return None
    members = members.join(nodes, "nd_digest").select("nd_k", "node", "nd_n", "nd_id", _largest(percent).alias("nd_most"))
    sets = stage(full_sets(docs, nodes, id_col, text_col), "sets")
    sigs = stage(classes.select("nd_digest", "nd_n", "nd_sig").join(nodes.select("nd_digest", "node"), "nd_digest").drop("nd_digest").dropDuplicates(["node"]), "node-signatures")
    links = Links(sigs, sets, percent)
    left = _settled(_distinct_sets(members, None), links, FIRST_ROUNDS, F.col("nd_id"))
    if not left.isEmpty():
        members = stage(_prefixes(left, sets, percent), "prefixes")
        _settled(_distinct_sets(members, links.stars), links, None, None)
        discard(members)
    stars = links.stars
    owned = nodes if stars is None else nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("star")), "node", "left")
    owned = owned.withColumn("c", F.col("node") if stars is None else F.coalesce("star", "node"))
    return owned.select("nd_digest", "c").join(owned.groupBy("c").agg(F.min("nd_id").alias("component")), "c").select("nd_digest", "component")


def _results(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(nd_id, nd_text, nd_n, component) of each row; the classes that a hot digest joins are salted."""
    base = stage(signatures(docs, id_col, text_col, percent), "signatures")
    linked = links_and_components(docs, id_col, text_col, base, percent)
    classes = base.filter("nd_n > 0").groupBy("nd_digest").agg(F.min("nd_id").alias("lo"), F.max("nd_id").alias("hi"))
    classes = classes.withColumn("component", F.col("lo")) if linked is None else classes.join(linked.withColumnRenamed("component", "least"), "nd_digest", "left").withColumn("component", F.coalesce("least", "lo"))
    moved = classes.filter("lo < hi or component < lo").select("nd_digest", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = base.select("nd_id", "nd_text", "nd_n", "nd_digest", F.pmod(F.xxhash64("nd_id"), F.lit(SALTS)).cast("int").alias("salt")).join(moved, ["nd_digest", "salt"], "left")
    return rows.select("nd_id", "nd_text", "nd_n", F.coalesce("component", "nd_id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.  Pairs of similarity percent / 100 or more are linked."""
    null = lambda c: F.when(F.col(c) != F.lit(NULL_ID).cast("long"), F.col(c))
    rows = _results(docs, id_col, text_col, percent)
    return rows.select(null("nd_id").alias(id_col), F.col("nd_n").alias("n_shingles"), null("component").alias("component_id"), (F.col("component") == F.col("nd_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: the least id's; of several texts of that id the one of least checksum, of
    equal rows any.  Rows without words all stay."""
    rows = stage(_results(docs, id_col, text_col, percent).filter("nd_n > 0"), "results")
    best = rows.filter("component = nd_id").groupBy("component").agg(F.min("nd_text").alias("nd_best"))
    counted = rows.groupBy("nd_id", "nd_text", "component").agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted.join(best, "component", "left").select("nd_id", "nd_text", ((F.col("nd_id") == F.col("component")) & (F.col("nd_text") == F.col("nd_best"))).alias("stays"), "n"), "texts")
    key = ["nd_id", "nd_text"]
    own = docs.select(F.struct(*docs.columns).alias("nd_row"), key_of(F.col(id_col)).alias("nd_id"), checksum(F.col(text_col)).alias("nd_text"))
    own = own.join(counted.filter("not stays").select(key), key, "left_anti")
    several = counted.filter("stays and n > 1").select(key)
    if several.isEmpty():  # no equal rows: nothing to be read a second time
        return own.select("nd_row.*")
    once = own.join(several, key, "left_anti")
    return once.unionByName(own.join(several, key, "left_semi").dropDuplicates(key)).select("nd_row.*")
