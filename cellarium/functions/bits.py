"""Bit arithmetic on code columns and on Python integers used as bit sets.

A bit set is an int mask on the driver. A query's cell index is one long column: bit i is the value of the query's
i-th bit, so at most 62 bits make a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(code: Column, b: int) -> Column:
    """Bit ``b`` of a code column as 0 or 1."""
    return F.shiftright(code, b).bitwiseAND(F.lit(1))


def gather(code: Column, positions: Sequence[int]) -> Column:
    """The bits at ``positions``, packed: result bit i is code bit positions[i]. A permutation when all bits are named."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(positions):
        out = out + F.shiftleft(bit(code.cast("long"), b), i)
    return out


def scatter(packed: Column, positions: Sequence[int]) -> Column:
    """The inverse: bit i of ``packed`` goes to positions[i]."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(positions):
        out = out + F.shiftleft(bit(packed.cast("long"), i), b)
    return out


def prefix(code: Column, width: int, k: int) -> Column:
    """The k most significant bits of a code of ``width`` bits."""
    if not 0 <= k <= width:
        raise ValueError(f"a prefix of {width} bits can't have {k}")
    return F.shiftright(code, width - k)


def width_of(n: int) -> int:
    """Bits for n codes."""
    return max(0, (n - 1).bit_length())


def to_mask(bits: Sequence[int]) -> int:
    out = 0
    for b in bits:
        out |= 1 << b
    return out


def to_bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def gather_int(mask: int, positions: Sequence[int]) -> int:
    return to_mask([i for i, b in enumerate(positions) if mask >> b & 1])


def scatter_int(packed: int, positions: Sequence[int]) -> int:
    return to_mask([b for i, b in enumerate(positions) if packed >> i & 1])


def subsets(mask: int) -> Iterator[int]:
    """All subsets of a set in ascending order."""
    sub = 0
    while True:
        yield sub
        if sub == mask:
            return
        sub = (sub - mask) & mask


def group_values(kept: Sequence[int], n_bits: int) -> list[list[int]]:
    """For each value of the ``kept`` bits of an n-bit code, the codes that have it, ascending."""
    rest = to_mask([b for b in range(n_bits) if b not in set(kept)])
    return [[scatter_int(v, kept) | s for s in subsets(rest)] for v in range(1 << len(kept))]


def reorder(values: Sequence, given: Sequence[int]) -> list:
    """A dense array over the sorted bits, read in the order in which the bits were ``given``."""
    order = sorted(given)
    at = [order.index(b) for b in given]
    return [values[scatter_int(i, at)] for i in range(len(values))]
