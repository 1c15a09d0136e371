"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Each source's documents, in a seeded order, are one run of words cut into blocks of
``block_words``.  Blocks go to sources by the highest quotients u / (2 s - 1),
u being the source's target in its blocks; house sizes N/S, 2N/S, ... give the
integer quotas of S shards (the method is house-monotone, so quotas are never
negative).  Of a source's m blocks, quota div m passes take all, and the rest
of the quota is chosen evenly from a seeded start, so a document's words taken
follow in closed form from its place.

Defined results: a null text has size 0; null is a source of its own and comes last;
a source without words has target 0; repeated rows each count; very long texts are counted whole, and may be taken in part by
``mix``, as whole rows by ``repeated``; other columns, whatever their names, are not read by ``mix`` and kept by ``repeated``.
An empty table gives no rows.  Only a row per source (and shard) passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
BLOCK_WORDS, SHARDS, SEED = 32, 8, "mix-1"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts by code point, null last, and joins like any value."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """sizes (mx_key, mx_source_size) with weight and target: water-filling of share * all words under repeat * size."""
    every = Window.orderBy("mx_key")
    turn = (F.row_number().over(every) - 1) % len(weights) + 1
    rows = sizes.withColumn("mx_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("mx_cap", F.col("mx_source_size") * repeat)
    by_ratio = Window.orderBy(F.col("mx_cap") / F.col("mx_w"), "mx_key")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    goal = F.sum("mx_source_size").over(whole) * share
    rows = rows.withColumn(
        "mx_level", (goal - F.coalesce(F.sum("mx_cap").over(before), F.lit(0))) / (F.sum("mx_w").over(whole) - F.coalesce(F.sum("mx_w").over(before), F.lit(0.0)))
    )
    # the first source, by cap / weight, which the level of those after it does not fill, fixes the level of all
    level = F.min(F.when(F.col("mx_level") * F.col("mx_w") <= F.col("mx_cap"), F.struct(F.col("mx_cap") / F.col("mx_w"), "mx_key", F.col("mx_level").alias("l")))).over(whole)
    return rows.withColumn("mx_target", F.least(F.col("mx_cap").cast("double"), F.coalesce(level["l"] * F.col("mx_w"), F.lit(0.0)))).drop("mx_level")


def apportion(rows: DataFrame, units: str, cap: str, shards: int = SHARDS) -> DataFrame:
    """Adds mx_quota: array of seats after 1..shards parts of the house, round(sum(units)) seats in all.

    With n sources, the seats at multiplier (N - n/2)/U are all among the N highest
    quotients and less than n short of N; only those missing are ranked.
    """
    whole = Window.partitionBy("mx_shard")
    r = rows.withColumn("mx_shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    r = r.withColumns({"mx_u": F.sum(units).over(whole), "mx_n": F.count(F.lit(1)).over(whole)})
    r = r.withColumn("mx_house", F.floor(F.round("mx_u") * F.col("mx_shard") / shards))
    seats = lambda house: F.when(F.col("mx_u") <= 0, F.lit(0)).otherwise(F.least(F.col(cap), F.greatest(F.lit(0), F.floor(F.col(units) * house / F.col("mx_u") + 0.5)))).cast("long")
    r = r.withColumns({"mx_low": seats(F.col("mx_house") - F.col("mx_n") / 2), "mx_high": F.least(F.col(cap), seats(F.col("mx_house") + 2 * F.col("mx_n")) + 2)})
    r = r.withColumn("mx_left", F.col("mx_house") - F.sum("mx_low").over(whole))
    more = r.filter(F.col(units) > 0).withColumn("mx_seat", F.explode(F.when(F.col("mx_high") > F.col("mx_low"), F.sequence(F.col("mx_low") + 1, F.col("mx_high")))))
    rank = F.row_number().over(whole.orderBy((F.col(units) / (2 * F.col("mx_seat") - 1)).desc(), "mx_key", "mx_seat"))
    more = more.withColumn("mx_rank", rank).filter("mx_rank <= mx_left").groupBy("mx_key", "mx_shard").agg(F.count(F.lit(1)).alias("mx_more"))
    quotas = r.join(more, ["mx_key", "mx_shard"], "left").withColumn("mx_q", F.col("mx_low") + F.coalesce("mx_more", F.lit(0)))
    quotas = quotas.groupBy("mx_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("mx_shard", "mx_q"))), lambda x: x["mx_q"]).alias("mx_quota"))
    return rows.join(quotas, "mx_key")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED,
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, and first_shard, the shard of its first block taken (null: none).

    The text is scanned once; (source, hash bucket) groups split a hot source.
    """
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    rows = stage(docs.select(F.col(id_col).alias("mx_id"), source_key(F.col(source_col)).alias("mx_key"), words(F.col(text_col)).alias("mx_size"), order.alias("mx_order")), "mix")
    rows = rows.withColumn("mx_bucket", F.substring("mx_order", 1, 3))
    buckets = rows.groupBy("mx_key", "mx_bucket").agg(F.sum("mx_size").alias("mx_in_bucket"))
    sizes = buckets.groupBy("mx_key").agg(F.sum("mx_in_bucket").alias("mx_source_size"))
    plan = targets(sizes, weights, share, repeat).withColumn("mx_m", F.ceil(F.col("mx_source_size") / block_words).cast("long"))
    plan = plan.withColumns({"mx_units": F.when(F.col("mx_source_size") > 0, F.col("mx_target") * F.col("mx_m") / F.col("mx_source_size")).otherwise(F.lit(0.0)), "mx_most": F.col("mx_m") * repeat})
    plan = apportion(plan, "mx_units", "mx_most", shards).select("mx_key", "mx_source_size", "mx_target", "mx_m", "mx_quota")
    before = Window.partitionBy("mx_key").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("mx_base", F.coalesce(F.sum("mx_in_bucket").over(before), F.lit(0))).drop("mx_in_bucket").join(plan, "mx_key")
    inside = Window.partitionBy("mx_key", "mx_bucket").orderBy("mx_order", "mx_id", "mx_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(buckets, ["mx_key", "mx_bucket"]).withColumn("mx_a", F.col("mx_base") + F.coalesce(F.sum("mx_size").over(inside), F.lit(0)))
    rows = rows.withColumn("mx_b", F.col("mx_a") + F.col("mx_size"))
    return rows.select(
        F.col("mx_id").alias(id_col), F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"),
        _taken(block_words, seed).alias("taken"), _first_shard(block_words, seed).alias("first_shard"),
    )


def _taken(block: int, seed: str) -> Column:
    a, b, m = "mx_a", "mx_b", "greatest(mx_m, 1)"
    q = "element_at(mx_quota, -1)"
    e = f"({q} % {m})"
    c = _start(seed)
    upto = lambda i: f"((cast({i} as decimal(19,0)) * cast({e} as decimal(19,0)) + {c}) div {m})"
    first, last = f"({a} div {block})", f"(({b} - 1) div {block})"
    one = lambda i: f"({upto(f'{i} + 1')} - {upto(i)})"
    extra = (
        f"case when mx_size = 0 then 0 when {first} = {last} then {one(first)} * mx_size "
        f"else {one(first)} * (({first} + 1) * {block} - {a}) + {block} * ({upto(last)} - {upto(f'{first} + 1')}) + {one(last)} * ({b} - {last} * {block}) end"
    )
    return F.expr(f"cast(({q} div {m}) * mx_size + {extra} as bigint)")


def _start(seed: str) -> str:
    return f"pmod(cast(conv(substring(md5(concat(mx_key, ':{seed}')), 1, 15), 16, 10) as bigint), greatest(mx_m, 1))"


def _first_shard(block: int, seed: str) -> Column:
    """Draws are numbered pass by pass; a shard takes the draws up to its cumulative quota."""
    m, q = "greatest(mx_m, 1)", "element_at(mx_quota, -1)"
    e = f"({q} % {m})"
    upto = f"((cast(mx_a div {block} as decimal(19,0)) * cast({e} as decimal(19,0)) + {_start(seed)}) div {m})"
    draw = f"case when {q} >= {m} then mx_a div {block} else {upto} end"
    return F.when((F.col("mx_size") > 0) & (_taken(block, seed) > 0), F.expr(f"size(filter(mx_quota, x -> x <= {draw}))")).cast("int")


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: str = SEED,
) -> DataFrame:
    """docs, all columns, each row written 0 to ``repeat`` times, so that the words of each source meet its target.

    The k-th row of a source, by size, then in the seeded order, gets round(k r) - round((k - 1) r) copies, r being target / source
    size.  The rounding carries on from row to row and sizes ascend, so (summation by parts) a source's words differ from
    its target by one of its largest rows at most.  Rows of one size in one hash bucket are ranked together, so a hot source is split.
    """
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    group = ["mx_key", "mx_size", "mx_bucket"]
    rows = docs.select(F.struct(*docs.columns).alias("mx_row"), source_key(F.col(source_col)).alias("mx_key"), words(F.col(text_col)).alias("mx_size"), order.alias("mx_order"), F.substring(order, 1, 2).alias("mx_bucket")).filter("mx_size > 0")
    groups = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("mx_n")), "mix-groups")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_size = groups.groupBy("mx_key", "mx_size").agg(F.sum("mx_n").alias("mx_n"))
    plan = targets(by_size.groupBy("mx_key").agg(F.sum(F.col("mx_n") * F.col("mx_size")).alias("mx_source_size")), weights, share, repeat)
    plan = plan.select("mx_key", (F.col("mx_target") / F.col("mx_source_size")).alias("mx_ratio"))
    bases = by_size.withColumn("mx_smaller", F.coalesce(F.sum("mx_n").over(before("mx_key", "mx_size")), F.lit(0))).drop("mx_n").join(plan, "mx_key")
    groups = groups.withColumn("mx_before", F.coalesce(F.sum("mx_n").over(before(*group)), F.lit(0))).drop("mx_n").join(bases, ["mx_key", "mx_size"])
    inside = Window.partitionBy(*group).orderBy("mx_order", F.col("mx_row")[id_col], F.xxhash64(F.col("mx_row")[text_col]))
    rows = rows.join(groups, group).withColumn("mx_k", F.col("mx_smaller") + F.col("mx_before") + F.row_number().over(inside))
    upto = lambda k: F.floor(k * F.col("mx_ratio") + 0.5)
    rows = rows.withColumn("mx_copies", (upto(F.col("mx_k")) - upto(F.col("mx_k") - 1)).cast("int")).filter("mx_copies > 0")
    return rows.withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies")))).select("mx_row.*")
