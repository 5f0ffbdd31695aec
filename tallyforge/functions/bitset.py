"""Bit sets as columns: arrays of 64-bit words, lowest bit first, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def _both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def bits_and(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x.bitwiseAND(y))


def bits_or(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x.bitwiseOR(y))


def bits_xor(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x.bitwiseXOR(y))


def bits_and_not(a: Column, b: Column) -> Column:
    """The bits of a that b lacks."""
    return _both(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def bits_flip(a: Column, n_bits: int) -> Column:
    """The complement among the first n_bits; bits beyond stay 0."""
    spare = -n_bits % WORD
    last = F.shiftrightunsigned(F.lit(-1).cast("long"), spare)
    return F.transform(a, lambda x, i: F.when(i == n_bits // WORD - (n_bits % WORD == 0), F.bitwise_not(x).bitwiseAND(last)).otherwise(F.bitwise_not(x)))


def bits_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def and_count(a: Column, b: Column) -> Column:
    return bits_count(bits_and(a, b))


def or_count(a: Column, b: Column) -> Column:
    return bits_count(bits_or(a, b))


def xor_count(a: Column, b: Column) -> Column:
    return bits_count(bits_xor(a, b))


def and_not_count(a: Column, b: Column) -> Column:
    return bits_count(bits_and_not(a, b))


def flip_count(a: Column, n_bits: int) -> Column:
    return F.lit(n_bits).cast("long") - bits_count(a)


def and_equals(a: Column, b: Column, c: Column) -> Column:
    return bits_and(a, b) == c


def is_subset(a: Column, b: Column) -> Column:
    return bits_and(a, b) == a


def is_superset(a: Column, b: Column) -> Column:
    return bits_and(a, b) == b


def bit_test(a: Column, i: Column | int) -> Column:
    """Whether position i is set; beyond the last word none is."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.getbit(F.get(a, F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD)).cast("int")) == 1, F.lit(False))


def bit_set(a: Column, i: int, on: bool = True) -> Column:
    """Bit i turned on or off."""
    mask = 1 << i % WORD
    mask = mask - (1 << WORD) if mask >> 63 else mask
    return F.transform(a, lambda x, k: F.when(k == i // WORD, x.bitwiseOR(F.lit(mask).cast("long")) if on else x.bitwiseAND(F.bitwise_not(F.lit(mask).cast("long")))).otherwise(x))


def bits_all(n_bits: int, on: bool = True) -> Column:
    """n_bits ones (or zeros)."""
    words = [(1 << min(WORD, n_bits - at)) - 1 if on else 0 for at in range(0, n_bits, WORD)]
    return F.array(*[F.lit(w - (1 << WORD) if w >> 63 else w).cast("long") for w in words]) if words else F.array().cast("array<long>")


def bit_positions(a: Column) -> Column:
    """The positions of the ones, ascending."""
    return F.flatten(F.transform(a, lambda x, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(x, b) == 1), lambda b: k * WORD + b)))


def find_first(a: Column) -> Column:
    """The lowest position that is set; -1 if none is."""
    return find_next(a, -1)


def find_next(a: Column, after: Column | int) -> Column:
    """The lowest set position above `after`; -1 if there is none. The lowest one of a word x is bit_count((x & -x) - 1)."""
    after = F.lit(after) if isinstance(after, int) else after
    low = F.transform(a, lambda x, k: _lowest(x, k, after))
    return F.coalesce(F.array_min(F.filter(low, lambda p: p >= 0)), F.lit(-1))


def _lowest(x: Column, k: Column, after: Column) -> Column:
    skip = F.least(F.greatest(after + 1 - k * WORD, F.lit(0)), F.lit(WORD)).cast("int")
    # shifts of a long take their distance modulo 64, so a whole word is skipped by itself
    part = F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, skip), skip)
    return F.when((skip < WORD) & (part != 0), k * WORD + F.bit_count(part.bitwiseAND(-part) - 1)).otherwise(F.lit(-1))


def bits_from_string(s: Column) -> Column:
    """From text of 0 and 1, highest position first."""
    digits = F.reverse(F.split(s, ""))
    words = F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / WORD).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(F.get(digits, w * WORD + b) == "1", F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))))


def bits_to_string(a: Column, n_bits: int) -> Column:
    """Text of 0 and 1, highest position first."""
    return F.array_join(F.transform(F.sequence(F.lit(n_bits - 1), F.lit(0)), lambda i: F.getbit(F.get(a, F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD)).cast("int")).cast("string")), "")


def bits_of(rows: DataFrame, key: str, position: str, n_bits: int) -> DataFrame:
    """(key, words): for each key the set of its positions, by one aggregation."""
    words = -(-n_bits // WORD)
    each = rows.select(key, F.floor(F.col(position) / WORD).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(WORD)).cast("int")).alias("bit"))
    packed = each.groupBy(key, "w").agg(F.bit_or("bit").alias("bits")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))
