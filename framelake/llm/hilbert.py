"""Hilbert-curve sharding, in DataFrame functions only.

Metadata dimensions are quantised to equi-depth codes of ``bits`` bits that keep their order,
rows are sorted by the Hilbert index of the codes, and the order is cut into runs
whose row counts differ by one at most (law ``rows``).

Only metadata, sizes and checksums are shuffled, never the text (but by ``sharded``, which gives whole rows).  Codes come
from the ranks of whole values, as at most 2^bits bounds; ranks come from a range-sorted table whose row numbers are written with
it, plus prefix sums over its partitions.

Defined results: null metadata has the last code; a null text has size 1 and the checksum of no bytes; very long texts only
have a large size; equal index values are ordered by id (null first), then checksum; repeated rows stay, each with its
slot; other columns, whatever their names, are not read by ``shard``.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS, BITS = 8, 5


def curve_table(dims: int) -> list[int]:
    """For each state (entry corner, direction) and cell label: next state * 2^dims + place of the cell on the curve."""
    n, size = dims, 1 << dims
    ror = lambda x, r: ((x >> r % n) | (x << (n - r % n))) & (size - 1)
    gray = lambda w: w ^ (w >> 1)
    places = {gray(w): w for w in range(size)}
    trailing = lambda w: (~w & (w + 1)).bit_length() - 1
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    turn = lambda w: 0 if not w else trailing(w - 1 if w % 2 == 0 else w) % n
    out = []
    for state in range(size * n):
        corner, way = divmod(state, n)
        for label in range(size):
            w = places[ror(label ^ corner, way + 1)]
            corner2 = corner ^ ror(entry(w), n - (way + 1) % n)
            out.append((corner2 * n + (way + turn(w) + 1) % n) * size + w)
    return out


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the curve; codes are below 2^bits."""
    n, size = len(codes), 1 << len(codes)
    table = F.array(*[F.lit(x) for x in curve_table(n)])

    def step(s, bit):
        label = F.lit(0)
        for j, c in enumerate(codes):
            label = label + F.expr("1") * F.when(c.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), bit + 1)) != 0, 1 << j).otherwise(0)
        to = F.get(table, s["state"] * size + label)
        return F.struct(F.floor(to / size).cast("int").alias("state"), (s["index"] * size + to % size).cast("long").alias("index"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step)["index"]


def code_bounds(rows: DataFrame, dims: list[str], bits: int) -> dict[str, list[tuple]]:
    """For each dimension the least value of each of its codes, ascending: its values' order cut to 2^bits - 1 equally filled codes.

    Whole values are counted and ranked (a value is never split); only a row per code comes to the driver.
    """
    top, out = (1 << bits) - 1, {}
    for d in dims:
        counts = rows.filter(F.col(d).isNotNull()).groupBy(d).agg(F.count(F.lit(1)).alias("hb_c"))
        placed = _placed(counts.orderBy(d), "hilbert-values")
        before = Window.partitionBy("hb_part").orderBy("hb_row").rowsBetween(Window.unboundedPreceding, -1)
        parts = placed.groupBy("hb_part").agg(F.sum("hb_c").alias("hb_n"))
        ahead = Window.orderBy("hb_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per sort partition
        parts = parts.select("hb_part", F.coalesce(F.sum("hb_n").over(ahead), F.lit(0)).alias("hb_base"), F.sum("hb_n").over(Window.partitionBy()).alias("hb_total"))
        place = F.floor((F.col("hb_base") + F.coalesce(F.sum("hb_c").over(before), F.lit(0))) * top / F.col("hb_total")).cast("int")
        found = placed.join(F.broadcast(parts), "hb_part").select(d, place.alias("hb_code")).groupBy("hb_code").agg(F.min(d).alias("hb_least")).collect()  # 2^bits rows at most
        out[d] = sorted((r["hb_code"], r["hb_least"]) for r in found)
    return out


def code_of(value: Column, bounds: list[tuple], bits: int) -> Column:
    """Code of a value by the bounds of its dimension; null has the last code."""
    out = F.lit(0)
    for code, least in bounds:
        out = F.when(value >= F.lit(least), code).otherwise(out)
    return F.when(value.isNull(), (1 << bits) - 1).otherwise(out)


def _placed(ordered: DataFrame, label: str) -> DataFrame:
    """ordered, written once with the partition (hb_part) and the place in it (hb_row) of each row."""
    rows = stage(ordered.withColumn("hb_row", F.monotonically_increasing_id()), label)
    return rows.withColumns({"hb_part": F.shiftright("hb_row", 33), "hb_row": F.col("hb_row").bitwiseAND(F.lit((1 << 33) - 1))})


def curve_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_dims=("lang", "source"), bits: int = BITS, whole_rows: bool = False) -> DataFrame:
    """(hb_id, hb_size, hb_crc, codes, hb_curve, hb_rank, hb_total): the global order along the curve.  whole_rows: with hb_doc, all of docs' columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"hb_d{i}" for i in range(len(text_dims))]
    own = [F.col(id_col).alias("hb_id"), (F.octet_length(text).cast("long") + 1).alias("hb_size"), F.crc32(text.cast("binary")).alias("hb_crc"), *[F.col(d).alias(n) for d, n in zip(text_dims, names, strict=True)]]
    small = stage(docs.select(*own), "hilbert")
    dims = [*names, "hb_size"]
    bounds = code_bounds(small, dims, bits)
    rows = docs.select(*own, F.struct(*docs.columns).alias("hb_doc")) if whole_rows else small
    codes = [f"hb_code{i}" for i in range(len(dims))]
    rows = rows.withColumns({c: code_of(F.col(d), bounds[d], bits) for c, d in zip(codes, dims, strict=True)})
    rows = rows.select("hb_id", "hb_size", "hb_crc", *codes, hilbert_index([F.col(c) for c in codes], bits).alias("hb_curve"), *(["hb_doc"] if whole_rows else []))
    ordered = _placed(rows.orderBy("hb_curve", "hb_id", "hb_crc"), "hilbert-order")
    counts = ordered.groupBy("hb_part").agg(F.count(F.lit(1)).alias("hb_c"))
    before, whole = Window.orderBy("hb_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    bases = counts.select("hb_part", F.coalesce(F.sum("hb_c").over(before), F.lit(0)).alias("hb_base"), F.sum("hb_c").over(whole).alias("hb_total"))
    out = ordered.join(F.broadcast(bases), "hb_part")  # a row per sort partition
    return out.withColumn("hb_rank", F.col("hb_base") + F.col("hb_row")).drop("hb_part", "hb_base", "hb_row")


def cut_rows(shards: int = SHARDS) -> tuple[Column, Column]:
    """(shard, slot) of hb_rank: the first total % shards runs have one row more."""
    small, more = F.expr(f"hb_total div {shards}"), F.expr(f"hb_total % {shards}")
    edge = more * (small + 1)
    shard = F.when(F.col("hb_rank") < edge, F.expr(f"hb_rank div (hb_total div {shards} + 1)")).otherwise(more + F.floor((F.col("hb_rank") - edge) / F.greatest(small, F.lit(1))))
    slot = F.when(F.col("hb_rank") < edge, F.col("hb_rank") % (small + 1)).otherwise((F.col("hb_rank") - edge) % F.greatest(small, F.lit(1)))
    return shard.cast("int"), slot.cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_dims=("lang", "source"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard, hilbert index and dimension codes of each row."""
    at, slot = cut_rows(shards)
    rows = curve_order(docs, id_col, text_col, text_dims, bits)
    codes = [c for c in rows.columns if c.startswith("hb_code")]
    return rows.select(
        F.col("hb_id").alias(id_col), F.col("hb_size").alias("size"), F.col("hb_crc").alias("text_crc32"), F.lit("rows").alias("law"), at.alias("shard"), slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("hb_curve").alias("hilbert"), *[F.col(c).alias(c.replace("hb_", "")) for c in codes],
    )


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_dims=("lang", "source"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """docs, all columns, each row with its shard and slot; a column of docs that has one of these names gives way."""
    at, slot = cut_rows(shards)
    rows = curve_order(docs, id_col, text_col, text_dims, bits, whole_rows=True)
    kept = [F.col("hb_doc")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(*kept, at.alias("shard"), slot.alias("slot"))
