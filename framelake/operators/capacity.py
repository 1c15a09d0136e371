"""Capacity knobs of a host, and replay of a trace through its cache and its admission queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp

# Fixed values.
MAP_RESERVE, MAPS_PER_ARCHIVE = 2048, 2
OPEN_LOW, OPEN_HIGH, OPEN_FALLBACK = 64, 100_000, 1024
FLIGHT_SHARE, FLIGHT_BYTES = 5, 32 << 20
FLIGHT_LOW, FLIGHT_HIGH, FLIGHT_FALLBACK = 64, 4096, 64


def knobs(hosts: DataFrame) -> DataFrame:
    """hosts (max_map_count, mem_total, open_flag, inflight_flag; any may be null) with both knobs and where they come from.

    A flag wins over the automatic value, that over the fallback.  map_ok tells whether the map limit covers the open archives.
    """
    auto_open = clamp(F.greatest(F.col("max_map_count") - MAP_RESERVE, F.lit(0)).cast("long") - F.pmod(F.greatest(F.col("max_map_count") - MAP_RESERVE, F.lit(0)), F.lit(2)), 0, 2**62)
    auto_open = clamp((auto_open / MAPS_PER_ARCHIVE).cast("long"), OPEN_LOW, OPEN_HIGH)
    share = F.expr(f"(cast(mem_total as decimal(20,0)) * {FLIGHT_SHARE} div 100) div {FLIGHT_BYTES}")
    auto_flight = F.when(F.col("mem_total").isNotNull(), clamp(share, FLIGHT_LOW, FLIGHT_HIGH))
    auto_open = F.when(F.col("max_map_count").isNotNull(), auto_open)
    source = lambda flag, auto: F.when(F.col(flag).isNotNull(), "flag").when(F.col(auto).isNotNull(), "auto").otherwise("fallback")
    out = hosts.withColumns({
        "max_open": F.coalesce("open_flag", auto_open, F.lit(OPEN_FALLBACK)).cast("long"), "open_source": source("open_flag", "max_map_count"),
        "max_inflight": F.coalesce("inflight_flag", auto_flight, F.lit(FLIGHT_FALLBACK)).cast("long"), "inflight_source": source("inflight_flag", "mem_total"),
    })
    return out.withColumn("map_ok", F.col("max_map_count") >= MAPS_PER_ARCHIVE * F.col("max_open") + MAP_RESERVE)


def audit_line(rows: DataFrame) -> DataFrame:
    return rows.withColumn("audit", F.format_string("max_open_archives=%d (%s) max_inflight=%d (%s)", "max_open", "open_source", "max_inflight", "inflight_source"))


def replay_lru(trace: DataFrame, capacity: int) -> DataFrame:
    """trace (host, seq, id) with hit: whether the id is among the last ``capacity`` distinct ids of the host.

    A host's trace streams in its order; hosts are spread.  A capacity below 1 counts as 1.
    """
    size = max(1, capacity)

    def replay(batches):
        from collections import OrderedDict

        import pyarrow as pa

        host, recent = None, OrderedDict()
        for batch in batches:
            hits = []
            for h, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if h != host:
                    host, recent = h, OrderedDict()
                hits.append(x in recent)
                recent[x] = None
                recent.move_to_end(x)
                if len(recent) > size:
                    recent.popitem(last=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=["host", "seq", "id", "hit"])

    return _in_order(trace.select("host", "seq", "id"), "seq").mapInArrow(replay, "host string, seq long, id string, hit boolean")


def _in_order(trace: DataFrame, *order: str) -> DataFrame:
    """Each host's rows in order, in one partition: they stream through, so only the cache or the permits are held."""
    return trace.repartition("host").sortWithinPartitions("host", *order)


def replay_admission(trace: DataFrame, permits: int, timeout: float) -> DataFrame:
    """trace (host, seq, arrival, service in seconds) with start, wait and status: 200, or 503 for one that waits longer than timeout.

    First come, first served; one that gives up takes no permit.
    """
    if not (timeout >= 0 and timeout != float("inf")):
        raise ValueError("the permit timeout must be finite and not negative")

    def replay(batches):
        import heapq

        import pyarrow as pa

        host, free = None, []
        for batch in batches:
            starts, waits, status = [], [], []
            for h, arrival, service in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if h != host:
                    host, free = h, [float("-inf")] * permits
                start = max(arrival, free[0]) if free else float("inf")
                late = start - arrival > timeout
                if not late:
                    heapq.heapreplace(free, start + service)
                starts.append(None if late else start)
                waits.append(timeout if late else start - arrival)
                status.append(503 if late else 200)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.float64()), pa.array(waits, pa.float64()), pa.array(status, pa.int32())], names=["host", "seq", "arrival", "service", "start", "wait", "status"])

    rows = _in_order(trace.select("host", "seq", F.col("arrival").cast("double"), F.col("service").cast("double")), "arrival", "seq")
    return rows.mapInArrow(replay, "host string, seq long, arrival double, service double, start double, wait double, status int")
