"""A bitmap of hashes, of a size that is bounded whatever the data: a cheap first filter.

A row whose hash isn't in the bitmap is certainly not in the set; a row that is may be,
and what follows decides.  Beyond the bound the bitmap lets more rows through and
nothing else changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28
BITS_FOR_EACH = 16


def bitmap(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """Bits of the set's hashes as 64-bit words: 2 to the power of 28 bits (32 MB) at most."""
    power = min(MOST_BITS, max(LEAST_BITS, int(max(1, count * BITS_FOR_EACH) - 1).bit_length()))
    bit = F.shiftrightunsigned(F.col(column), 64 - power)
    words = hashes.select(F.shiftright(bit, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros((1 << power) // 64, dtype=np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A mask of the hashes that may be in the set."""
    power = int(len(words) * 64).bit_length() - 1
    bit = hashes >> np.uint64(64 - power)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
