"""Identifiers as Column expressions: the base-64 node id codec, references, names, uuids, paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: The digits of node ids, from 0 to 63.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz$_ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The digits of base 64 by the standard, from 0 to 63.
STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
U64 = "decimal(20,0)"


def encode_node_id(n: Column) -> Column:
    """A number from 0 to 2**64 - 1, as number or text, to a node id; other text, and larger numbers, pass through.

    Nine bytes are twelve digits of the standard's base 64, which are then written as our own.
    """
    text = n.cast("string")
    number = text.rlike("^[0-9]+$") & ((F.length(text) < 20) | (text.try_cast("decimal(38,0)") < F.lit(str(1 << 64)).cast("decimal(38,0)")))
    twelve = F.base64(F.unhex(F.lpad(F.conv(text, 10, 16), 18, "0")))
    bare = F.ltrim(F.translate(twelve, STANDARD, DIGITS), F.lit("0"))
    return F.when(F.coalesce(number, F.lit(False)), F.when(bare == "", F.lit("0")).otherwise(bare)).otherwise(text)


def decode_node_id(s: Column, strict: bool = False) -> Column:
    """A node id to its number as text; the empty id is empty, one with other characters or beyond eleven digits null or, if strict, an error."""
    digits = F.lpad(F.ltrim(s, F.lit("0")), 12, "0")
    raw = F.hex(F.unbase64(F.translate(digits, DIGITS, STANDARD)))
    top, low = F.conv(F.substring(raw, 1, 3), 16, 10), F.conv(F.substring(raw, 4, 15), 16, 10)  # bits above and below the sixtieth
    large = (top.cast(U64) * F.lit(1 << 60).cast(U64) + low.cast(U64)).cast("decimal(38,0)").cast("string")
    number = F.when(F.startswith(raw, F.lit("000")), low).otherwise(large)
    out = F.when(s == "", F.lit("")).when(s.rlike(r"^0*[0-9a-zA-Z$_]{1,11}$"), number)
    if strict:
        out = F.when(s.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("not a node id: "), s)).cast("string")).otherwise(out)
    return out


def model_ref(ref: Column) -> tuple[Column, Column]:
    """id and name of "id(name)"."""
    return F.regexp_extract(ref, r"^([^(]*)\((.*)\)$", 1), F.regexp_extract(ref, r"^([^(]*)\((.*)\)$", 2)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def enum_name(value: Column) -> Column:
    """NAME of "memberId/NAME"."""
    return F.substring_index(value, "/", -1)


def uuid_of(high: Column, low: Column) -> Column:
    """Two longs, taken as unsigned, as 8-4-4-4-12."""
    h, l = F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(l, 1, 4), F.substring(l, 5, 12))


def ancestor_dirs(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
