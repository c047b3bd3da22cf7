"""FNV-1a of ids, for files that need it; joins go by the id itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(raw: bytes) -> int:
    """64 bits, as a signed number."""
    h = OFFSET
    for b in raw:
        h = (h ^ b) * PRIME & MASK
    return h - (1 << 64) if h >> 63 else h


def fnv1a64(column):
    return F.pandas_udf(lambda s: s.map(lambda x: fnv1a(x.encode()), na_action="ignore").astype(pd.Int64Dtype()), "long")(column)
