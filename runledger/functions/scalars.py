"""Scalar expressions: text, numbers, paths, bits. All are Column expressions, none is a UDF."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary prefixes, each 1024 times the one before.
SUFFIXES = ("K", "M", "G", "T")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def alternation(patterns: Sequence[str]) -> str:
    """One regular expression that matches what any of the patterns matches."""
    return "|".join(f"(?:{p})" for p in patterns)


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def bytes_to_text(n: Column) -> Column:
    """1536 -> 1.5KiB; whole numbers without a fraction, below 1024 as they are."""
    power = F.when(n < 1024, 0).otherwise(F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(len(SUFFIXES)))).cast("int")
    value = n / F.pow(F.lit(1024.0), power)
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.round(value, 2).cast("string"))
    unit = F.element_at(F.array(F.lit(""), *[F.lit(f"{s}iB") for s in SUFFIXES]), power + 1)
    return F.concat(shown, unit)


def text_to_bytes(text: Column) -> Column:
    """4k, 4K, 4KiB, 4kb -> 4096; an unknown unit raises when the row is read."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)\s*$", 1))
    factors = {"": 1, "b": 1} | {s.lower() + end: 1024 ** (k + 1) for k, s in enumerate(SUFFIXES) for end in ("", "b", "ib")}
    factor = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])[unit]
    bad = F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long")
    return F.when(text.isNull(), None).when((number == "") | factor.isNull(), bad).otherwise((number.cast("double") * factor).cast("long"))


def hex_to_decimal(text: Column) -> Column:
    """Hexadecimal text, with or without 0x, to DECIMAL(20, 0): addresses exceed BIGINT."""
    return F.conv(F.regexp_replace(F.trim(text), "^0[xX]", ""), 16, 10).cast("decimal(20,0)")


#: Fixed value: half of the addresses of 64 bits.
HALF = 1 << 63


def ordered_address(text: Column) -> Column:
    """Hexadecimal digits to a BIGINT in the order of unsigned addresses: the address less 2^63."""
    return F.conv(text, 16, -10).cast("bigint").bitwiseXOR(F.lit(-HALF))


def ordered_decimal(n: Column) -> Column:
    """As ordered_address, of a DECIMAL address; later ones count as the last, 2^64 - 1, where no instruction of four bytes begins."""
    return F.least(n - F.lit(Decimal(HALF)), F.lit(Decimal(HALF - 1))).cast("bigint")


def ordered_to_hex(n: Column) -> Column:
    """Lower-case digits of an address that ordered_address gives."""
    return F.lower(F.hex(n.bitwiseXOR(F.lit(-HALF))))


def decimal_to_hex(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(n.cast("string"), 10, 16)))


def significant(x: Column, digits: int = 3) -> Column:
    """Text with so many significant digits and no trailing zeros; NaN and null become empty."""
    place = digits - 1 - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), place)
    rounded = F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"0+$", ""), r"\.$", "")
    return F.when(x.isNull() | F.isnan(x), "").otherwise(shown)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """Without empty, . and .. parts, as far as the path goes back inside itself."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(seen: Column, part: Column) -> Column:
        inside = (F.size(seen) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), seen), -1) != "..")
        return F.when((part == "..") & inside, F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, part))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    rooted = path.startswith("/")
    return F.when(rooted, F.concat(F.lit("/"), F.regexp_replace(joined, r"^(\.\./?)+", ""))).when(joined == "", ".").otherwise(joined)


def lowest_bit(n: Column) -> Column:
    """The lowest set bit of a whole number, as a number; 0 for 0."""
    return n.bitwiseAND(-n)


def has_bit(n: Column, bit: int) -> Column:
    return n.bitwiseAND(F.lit(1 << bit)) != 0


def required_precision(base: Column, top: Column) -> Column:
    """Bits of a mantissa that represents the range [base, top) exactly; a fraction of top counts as a whole."""
    low, high = base.cast("bigint"), F.ceil(top).cast("bigint")
    least = lambda n: F.when(n == 0, 0).otherwise(F.round(F.log2(lowest_bit(n).cast("double"))))
    most = F.when(high == low, 0).otherwise(F.floor(F.log2((high - low).cast("double"))))
    exponent = F.when(high == 0, 0).when(low == 0, least(high)).otherwise(F.least(least(low), least(high)))
    return (most - exponent + 1).cast("int")


def platform_precision(base: Column, top: Column, mantissa: int, exponent: int = 3) -> Column:
    """Bits of precision that a capability format of so many mantissa bits has for the range [base, top)."""
    span = F.ceil(top).cast("bigint") - base.cast("bigint")
    most = F.when(span == 0, 0).otherwise(F.floor(F.log2(span.cast("double"))))
    return F.when(most + 1 <= mantissa - 2, mantissa - 2).otherwise(mantissa - 1 - exponent)


def mapped(x: Column, values: Mapping[str, str]) -> Column:
    """Values replaced where the map has them, else kept."""
    if not values:
        return x
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(table[x], x)


def first_match(x: Column, patterns: Mapping[str, str], other: str = "other") -> Column:
    """Name of the first pattern that matches."""
    out = F.lit(other)
    for name, pattern in reversed(list(patterns.items())):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return F.when(x.isNull(), other).otherwise(out)
