"""A filter of hashed ids in a bitmap of fixed size: what is not in it need not be shuffled to a join.

It holds every id that made it and, the more ids there are, others as well; the join behind it decides. So
its size bounds what is sent to the tasks, not which rows are right.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map (4 MB, whatever the number of ids), and those of them in one row of the aggregate.
BITS, ROW_BITS = 1 << 25, 1 << 15


def id_bits(ids: DataFrame) -> np.ndarray:
    """The map (bytes) of a DataFrame (id) of 64-bit hashes; at most BITS / ROW_BITS rows of 4 KB reach the driver."""
    at = F.pmod(F.shiftrightunsigned("id", 20), F.lit(BITS)) + 1  # Spark counts these from 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = np.zeros((BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for row, part in rows:
        out[row - 1] = np.frombuffer(bytes(part), np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id (int64) may be among those that made the map."""
    at = (ids.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
