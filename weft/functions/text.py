"""Text columns: recognisers, JSON parts, printed arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number or a truth value in typed attributes.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN = r"^(true|false)$"


def looks_like_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def looks_like_bool(c: Column) -> Column:
    return c.rlike(BOOLEAN)


def json_string(c: Column) -> Column:
    """Quoted and escaped; control characters without a short form as \\u00xx."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(1, 32):
        short = {10: "\\n", 13: "\\r", 9: "\\t"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_value(kind: Column, value: Column) -> Column:
    """A bare number or truth value where kind and text agree, else a string."""
    bare = ((kind == "number") & looks_like_number(value)) | ((kind == "boolean") & looks_like_bool(value))
    return F.when(F.coalesce(bare, F.lit(False)), value).otherwise(json_string(value))


def print_array(c: Column) -> Column:
    """Debug text of an array: ``[ a, b,  ]``."""
    return F.concat(F.lit("[ "), F.concat_ws("", F.transform(c, lambda x: F.concat(x.cast("string"), F.lit(", ")))), F.lit(" ]"))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))
    mask = F.lit(0xFFFFFFFF)

    def step(acc, x):
        """(acc xor x) times the prime, 2**40 + 0x1B3, in halves of 32 bits that never overflow."""
        y = acc.bitwiseXOR(x)
        low, high = y.bitwiseAND(mask), F.shiftrightunsigned(y, 32)
        t = low * 0x1B3
        top = (high * 0x1B3 + F.shiftright(t, 32) + F.shiftleft(low, 8).bitwiseAND(mask)).bitwiseAND(mask)
        return F.shiftleft(top, 32).bitwiseOR(t.bitwiseAND(mask))

    start = F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long")
    return F.when(F.length(text) == 0, start).otherwise(F.aggregate(codes, start, step))
