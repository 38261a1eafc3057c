"""A Bloom filter of fixed size over integer ids: built by an aggregate, looked up in numpy.

It lets rows that can't be in a set pass by a shuffle; those that may be are decided by a join. So it only saves work:
however full it is, results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB: two bits an id keep errors under a twentieth up to about eight million ids; more make it useless, not wrong.
BITS = 1 << 26


def hashes(key: Column) -> list[Column]:
    """What a look-up needs of an id."""
    return [F.xxhash64(key).alias("b1"), F.xxhash64(key, F.lit(1)).alias("b2")]


def build(ids: DataFrame, key: str = "id") -> np.ndarray:
    """The filter's words; at most BITS / 64 of them come to the driver."""
    at = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*[F.pmod(h, F.lit(BITS)) for h in hashes(F.col(key))])).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(BITS >> 6, np.int64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def maybe(words: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Whether the ids of the batch's rows, by their columns b1 and b2, may be in the filter."""
    out = np.ones(batch.num_rows, bool)
    for name in ("b1", "b2"):
        p = batch[name].to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITS - 1)
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out
