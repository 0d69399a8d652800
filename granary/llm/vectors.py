"""Reading vectors, drawing equal ones together and packing them into blocks, for the nearest-neighbour operators.

Rows without an id or whose vector is null, empty or holds null or non-finite components take no part. Rows that repeat
an id with an equal vector count once. Vectors of different lengths are never compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block int, width int, keys binary, ids array<array<bigint>>, vectors binary"


def usable(vector: str = "embedding") -> Column:
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))


def distinct_vectors(rows: DataFrame, kept: int) -> DataFrame:
    """vector, ids (its `kept` smallest, sorted) and key for each different vector of rows (vec_id, vector).

    Equal vectors score alike and ties go to the smaller id, so no more ids of one vector can be among the nearest. The
    limit is taken before rows are shuffled, too, so that a vector which many rows share is not gathered in one task.
    """
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_rank", first).filter(F.col("_rank") <= kept)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("key", F.xxhash64("vector"))


def packed(frame: pd.DataFrame, keys: str, ids: bool = True) -> pd.DataFrame:
    """One row that holds the vectors of a block, whose columns are block, width, vector, ids and an 8-byte key."""
    vectors = np.array(frame["vector"].tolist(), dtype=np.float64)
    return pd.DataFrame(
        {
            "block": [frame["block"].iloc[0]],
            "width": [vectors.shape[1]],
            "keys": [frame[keys].to_numpy(np.int64).tobytes()],
            "ids": [[list(map(int, x)) for x in frame["ids"]] if ids else []],
            "vectors": [vectors.tobytes()],
        }
    )


def matrix(packed_vectors: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed_vectors, np.float64).reshape(-1, width)
