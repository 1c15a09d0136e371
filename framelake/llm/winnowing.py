"""Winnowing fingerprints of documents, in DataFrame functions only.

A text is cut into pieces: runs without ASCII white space, of at most
``PIECE`` code points (so that text without spaces has positions too).  Each k
consecutive pieces give a polynomial hash modulo two primes, 60 bits in all; of each
window of w hashes the least is kept, of equal ones the rightmost, with its
position.  Two texts which share w + k - 1 consecutive pieces share a
fingerprint entry.

Defined results: a null or blank text has an empty fingerprint; a text of fewer
than k pieces has one entry made of all its pieces; two empty fingerprints are
alike (1.0), an empty and another are not (0.0).  Repeated rows stay, each
with its own result; equal ids are ordered by the text's hash.  Very long texts are
fingerprinted whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, shuffle_partitions

K, W, PIECE = 3, 6, 8
#: Primes of 31 and 29 bits, each with its base; a hash holds the residues of the first in its high bits.
PRIMES, BASES, LOW_BITS = (2**31 - 1, 2**29 - 3), (1_000_003, 998_244), 29


def pieces(text: Column, piece: int = PIECE) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(rf"[^\x20\x09-\x0D]{{1,{piece}}}"), F.lit(0))


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, LOW_BITS).bitwiseOR(low)


def _residue(h: Column, k: int) -> Column:
    return F.shiftright(h, LOW_BITS) if k == 0 else h.bitwiseAND(F.lit((1 << LOW_BITS) - 1))


def piece_hash(piece: Column) -> Column:
    """Both residues of a piece's hash."""
    x = F.xxhash64(piece)
    return _joined(F.pmod(x, F.lit(PRIMES[0])), F.pmod(F.shiftright(x, 32), F.lit(PRIMES[1])))


def grams(h: Column, k: int = K) -> Column:
    """array<long>: the hashes of the k-grams of the piece hashes h; fewer pieces make one hash of all."""

    def gram(i):
        out = []
        for n, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            total = F.lit(0).cast("long")
            for j in range(k):
                total = total + _residue(F.get(h, i + j), n) * F.lit(pow(base, k - 1 - j, p)).cast("long") % F.lit(p)
            out.append(total % F.lit(p))
        return _joined(*out)

    def whole(n):
        return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASES[n]) + _residue(x, n)) % F.lit(PRIMES[n]))

    return (
        F.when(F.size(h) == 0, F.array().cast("array<long>"))
        .when(F.size(h) < k, F.array(_joined(whole(0), whole(1))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), gram))
    )


def least_positions(v: Column, w: int = W) -> Column:
    """array<int>: the positions, ascending, of the least of each window of w hashes, the rightmost of equal ones.

    In a window a hash is compared with its place in it, 3 bits, behind it.
    """
    if w > 8:
        raise ValueError("a window has at most 8 hashes")
    ranked = lambda i, n: F.least(*[F.shiftleft(F.get(v, i + j), 3).bitwiseOR(F.lit(n - 1 - j)) for j in range(n)])
    place = lambda i: (i + (w - 1) - ranked(i, w).bitwiseAND(F.lit(7))).cast("int")
    last = F.size(v) - F.array_position(F.reverse(v), F.array_min(v)).cast("int")  # of a text of one window at most
    return F.when(F.size(v) == 0, F.array().cast("array<int>")).when(F.size(v) <= w, F.array(last)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(v) - w), place)))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """struct(hashes array<long>, positions array<int>) of the kept grams, in text order."""
    entries = lambda v, at: F.struct(F.transform(at, lambda p: F.get(v, p)).alias("hashes"), at.alias("positions"))
    return let(F.transform(pieces(text), piece_hash), lambda h: let(grams(h, k), lambda v: let(least_positions(v, w), lambda at: entries(v, at))))


def as_string(fingerprint: Column) -> Column:
    """hash:position, comma-joined."""
    return F.lower(F.array_join(F.zip_with(fingerprint["hashes"], fingerprint["positions"], lambda h, p: F.concat(F.hex(h), F.lit(":"), p.cast("string"))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    both, either = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(F.array_union(a["hashes"], b["hashes"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id, fingerprint string) for each row; no shuffle."""
    return docs.select(F.col(id_col), as_string(winnow(F.col(text_col), k, w)).alias("fingerprint"))


def _block(n: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below n, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
    b = F.array(*[F.lit(x).cast("long") for x in bounds])
    jump = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(b, at + s - 1) <= n), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), jump)


def with_next(docs: DataFrame, id_col: str, text_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (wn_id, wn_text, extra...) with those of the next row by descending id as next_*; after the last comes the first.

    Ids are cut into as many ranges as the shuffle has partitions, times four;
    the first row of each range also goes to the range before it.  The text is shuffled once,
    and only the ranges' bounds and largest ids come to the driver.
    """
    spark = docs.sparkSession
    parts = max(8, 4 * shuffle_partitions(spark))
    low = F.lit(-(2**63)).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("wn_id"), F.coalesce(F.col(text_col), F.lit("")).alias("wn_text")).withColumn("wn_n", F.coalesce("wn_id", low))
    ids = src.select("wn_n")
    cuts = ids.agg(F.percentile_approx("wn_n", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    block = _block(F.col("wn_n"), bounds)
    tops = sorted(ids.groupBy(block.alias("b")).agg(F.max("wn_n").alias("m")).collect(), key=lambda r: -r["b"])  # a row per range
    guest = F.lit(None).cast("int")
    if tops:
        # the top of each range is guest of the range before it; the very first of the last one
        homes = sorted((r["m"], tops[j - 1]["b"]) for j, r in enumerate(tops))
        at = _block(F.col("wn_n"), [m for m, _ in homes]) - 1
        guest = F.when(F.get(F.array(*[F.lit(m).cast("long") for m, _ in homes]), at) == F.col("wn_n"), F.get(F.array(*[F.lit(b) for _, b in homes]), at))
    places = F.array_compact(F.array(F.struct(block.alias("b"), F.lit(0).alias("g")), F.when(guest.isNotNull(), F.struct(guest.alias("b"), F.lit(1).alias("g")))))
    dealt = src.withColumn("wn_p", F.explode(places)).select("wn_id", "wn_n", "wn_text", F.col("wn_p.b").alias("wn_b"), F.col("wn_p.g").alias("wn_g")).repartition("wn_b")
    for name, value in (extra or {}).items():
        dealt = dealt.withColumn(name, value)
    order = Window.partitionBy("wn_b").orderBy("wn_g", F.col("wn_n").desc(), F.xxhash64("wn_text"))
    for name in ["wn_text", *(extra or {})]:
        dealt = dealt.withColumn(f"next_{name}", F.lead(name).over(order))
    return dealt.filter("wn_g = 0").drop("wn_b", "wn_g", "wn_n")


def edited_text(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones of following."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    rows = with_next(docs, id_col, text_col, {"wn_fp": winnow(F.col("wn_text"), k, w)})
    rows = rows.withColumn("wn_edited", edited_text(F.col("wn_text"), F.col("next_wn_text"))).drop("next_wn_text")
    near_next = likeness(F.col("wn_fp"), F.col("next_wn_fp"))
    out = F.struct(
        F.length("wn_text").cast("long").alias("n_chars"),
        F.sha2(F.col("wn_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("wn_fp")).alias("fingerprint"),
        let(winnow(F.col("wn_edited"), k, w), lambda e: F.struct(as_string(e).alias("s"), likeness(F.col("wn_fp"), e).alias("near"))).alias("e"),
        near_next.alias("near_next"),
    )
    return rows.select(F.col("wn_id").alias(id_col), out.alias("o")).select(
        id_col, "o.n_chars", "o.edited_sha256", "o.fingerprint", F.col("o.e.s").alias("edited_fingerprint"), F.col("o.e.near").alias("near_edited"), "o.near_next"
    )
