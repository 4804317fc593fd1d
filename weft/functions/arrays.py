"""Positional lists and bit masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert_at(a: Column, index: int | Column, value: Column) -> Column:
    """value at 0-based index, the rest moved up."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.concat(F.slice(a, F.lit(1), i), F.array(value), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0))))


def delete_at(a: Column, index: int | Column) -> Column:
    i = F.lit(index) if isinstance(index, int) else index
    return F.concat(F.slice(a, F.lit(1), i), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))


def swap_delete(a: Column, index: int | Column) -> Column:
    """Without the entry at index, whose place the last entry takes."""
    i = F.lit(index) if isinstance(index, int) else index
    head = F.slice(a, F.lit(1), F.size(a) - 1)
    return F.when(i == F.size(a) - 1, head).otherwise(F.transform(head, lambda x, k: F.when(k == i, F.element_at(a, -1)).otherwise(x)))


def find_one(a: Column, value: Column) -> Column:
    """0-based place of the first equal entry, or null."""
    p = F.array_position(a, value)
    return F.when(p > 0, p - 1)


def find_and_delete(a: Column, value: Column) -> Column:
    p = F.array_position(a, value).cast("int")
    return F.when(p > 0, delete_at(a, p - 1)).otherwise(a)


def push(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def pop(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def tail(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def test_bit(mask: Column, bit: Column) -> Column:
    return F.getbit(mask, bit) == 1


def set_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseOR(F.lit(1 << bit))


def clear_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(~(1 << bit)))


def clear_range(mask: Column, low: int, high: int) -> Column:
    """Clears bits low <= b < high of a 64-bit mask."""
    ones = ((1 << (high - low)) - 1) << low
    return mask.bitwiseAND(F.lit(~ones if ~ones >= -(1 << 63) else ~ones + (1 << 64)))


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def bits_set(mask: Column, low: int = 0, high: int = 63) -> Column:
    """Set bits in ascending order, low <= b < high."""
    return F.filter(F.sequence(F.lit(low), F.lit(high - 1)), lambda b: F.getbit(mask, b) == 1)
