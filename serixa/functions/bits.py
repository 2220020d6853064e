"""Column functions on integers: wrapping, zigzag, widths and sizes.

All stay inside whole-stage codegen.  Values wrap by masks, never by narrowing
casts, which ANSI mode rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frontends by number, with their header flag and command-line names.
FRONTENDS = {"none": 0, "i16": 1, "tick8": 2, "fire": 3, "delta": 4}
FRONTEND_FLAGS = {0: 0, 1: 2, 2: 4, 3: 64, 4: 2}
ALIASES = {"none": 0, "raw": 0, "i16": 1, "int16": 1, "tick8": 2, "ticks": 2}
#: Error codes and their texts.
ERRORS = {
    0: "ok",
    -1: "destination too small",
    -2: "invalid or truncated source",
    -3: "crc mismatch",
    -4: "weight_id mismatch",
    -5: "null argument",
    -6: "internal error",
}


def wrap16(x: Column) -> Column:
    return (x + 32768).bitwiseAND(65535) - 32768


def wrap32(x: Column) -> Column:
    return (x.cast("long") + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)


def saturate16(x: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), x))


def zigzag16(d: Column) -> Column:
    """Unsigned 16-bit zigzag of a wrapped difference."""
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 15)).bitwiseAND(65535)


def unzigzag16(u: Column) -> Column:
    return wrap16(F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(1))))


def zigzag32(d: Column) -> Column:
    d = d.cast("long")
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 31)).bitwiseAND(F.lit((1 << 32) - 1))


def unzigzag32(u: Column) -> Column:
    u = u.cast("long")
    return wrap32(F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1)))))


def bit_width(v: Column) -> Column:
    """Bits of an unsigned value; 0 has none."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def little_endian(data: Column, start: Column | int, size: int) -> Column:
    """The unsigned value of `size` bytes from a place counted from 0; substring's reverse() would be text's."""
    start = F.lit(start) if isinstance(start, int) else start
    digits = [F.hex(F.substring(data, (start + k + 1).cast("int"), F.lit(1))) for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def compress_bound(n: Column) -> Column:
    """Bytes that an encoding of n bytes never exceeds: header, records and a margin."""
    return n + 32 + 2 * F.floor((n + 255) / 256) + 16


def ratio_percent(coded: Column, orig: Column) -> Column:
    return F.when(orig == 0, F.lit(0.0)).otherwise(F.lit(100.0) * coded / orig)


def whole_percent(coded: Column, orig: Column) -> Column:
    """The command line's percentage, which truncates."""
    return F.when(orig == 0, F.lit(0).cast("long")).otherwise(F.floor(coded.cast("long") * 100 / orig))


def frontend_flag(frontend: Column) -> Column:
    pairs = [F.lit(x) for pair in FRONTEND_FLAGS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), frontend)


def frontend_is_i16(frontend: Column) -> Column:
    return frontend.isin(1, 3, 4)


def frontend_is_valid(frontend: Column) -> Column:
    return frontend.between(0, 4)


def frontend_by_alias(name: Column) -> Column:
    pairs = [F.lit(x) for pair in ALIASES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def error_text(code: Column) -> Column:
    pairs = [F.lit(x) for pair in ERRORS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("unknown error"))
