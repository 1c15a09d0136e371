"""Column functions for ticks, fixed-point values, byte fields and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import I64_MAX, U32_MAX


def scale_ceil(ticks: Column, from_scale: Column, to_scale: Column) -> Column:
    """ceil(ticks * to / from) in 128-bit decimals; raises beyond 64 bits, where an integral division would wrap silently."""
    d = lambda c, p: c.cast(f"decimal({p},0)")
    total = d(ticks, 20) * d(to_scale, 10) + d(from_scale, 10) - F.lit(1)
    fits = total < d(from_scale, 10) * F.lit(I64_MAX).cast("decimal(20,0)")
    exact = (total - F.pmod(total, d(from_scale, 10))) / d(from_scale, 10)
    return F.when(fits, exact.cast("decimal(38,0)").cast("long")).otherwise(F.raise_error(F.lit("scaled time stamp exceeds 64 bits")).cast("long"))


def nominal_ticks(seconds: float, timescale: Column) -> Column:
    """max(1, ceil(seconds * timescale)) in doubles, as IEEE gives it."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(seconds)) * timescale.cast("double")).cast("long"))


def div_ceil(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")


def pad8(length: Column) -> Column:
    """Bytes to the next multiple of eight."""
    return (F.lit(8) - length % 8) % 8


def fixed16_decode(value: Column) -> Column:
    return F.shiftright(value, 16)


def fixed16_encode(value: Column) -> Column:
    """value in 16.16, at most the largest 32-bit number."""
    return F.least(value * 65536, F.lit(U32_MAX).cast("long"))


def be_read(field: Column) -> Column:
    """Big-endian unsigned integer of a binary field of up to 8 bytes; null beyond 63 bits."""
    n = F.conv(F.hex(field), 16, 10).cast("decimal(20,0)")
    return F.when(n <= F.lit(I64_MAX).cast("decimal(20,0)"), n.cast("long"))


def be_read_signed32(field: Column) -> Column:
    n = be_read(field)
    return F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int")


def be_write(value: Column, width: int) -> Column:
    """width bytes, big-endian; negative 32-bit values in two's complement."""
    n = F.when(value < 0, value + F.lit(1 << 8 * min(width, 7)).cast("long")).otherwise(value.cast("long")) if width < 8 else value.cast("long")
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def flag_set(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit)) != 0


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low).cast("long")), F.lit(high).cast("long"))


def fourcc(field: Column) -> Column:
    """Four bytes as latin-1 text; spaces stay."""
    return F.decode(field, "ISO-8859-1")


def segment_name(idx: Column) -> Column:
    """File name of the 0-based segment; at least four digits, never cut."""
    return F.format_string("seg_%04d.m4s", idx + 1)


def segment_index(name: Column) -> Column:
    """0-based segment of a file name: seg_, four digits or more, .m4s; null if it is none, zero, or over 32 bits."""
    digits = F.regexp_extract(name, r"\Aseg_([0-9]{4,})\.m4s\z", 1)
    n = F.when(F.length(digits) > 0, digits).try_cast("decimal(38,0)")
    return F.when((n >= 1) & (n <= U32_MAX), (n - 1).cast("long"))


def id_status(value: Column) -> Column:
    """ok, or why an archive id is refused."""
    return (
        F.when(F.octet_length(value) == 0, "empty")
        .when(F.octet_length(value) > 64, "too_long")
        .when(~value.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), "bad_chars")
        .otherwise("ok")
    )


def extinf(ticks: Column, timescale: Column) -> Column:
    """ticks / timescale with six decimals.

    The decimal expansion of the double itself is rounded, halves to even; the formatter of the JVM rounds its shortest
    form, half up, and differs on ties, so the printing is done by an Arrow UDF.
    """
    return _six_decimals()(ticks.cast("double") / timescale.cast("double"))


def _six_decimals():
    import pandas as pd

    def six(seconds: pd.Series) -> pd.Series:
        return seconds.map(lambda x: None if x != x else f"{x:.6f}")

    six.__annotations__ = {"seconds": pd.Series, "return": pd.Series}
    return F.pandas_udf(six, "string")
