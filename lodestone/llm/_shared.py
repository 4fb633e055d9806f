"""What the operators share: tables in the folder that all executors see, and batches of bounded size."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import discard, fresh_path, shared_dir, written

__all__ = ["bound_batches", "discard", "fresh_path", "hash_bitmap", "in_bitmap", "shared_dir", "written"]

#: Bytes of a batch that a Python worker gets; rows alone don't bound it, as texts may be long.
BATCH_BYTES = 4 << 20
#: Address bits of the largest bitmap of hashes (16 MiB).
MAX_BITS = 27


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def hash_bitmap(hashes: DataFrame) -> np.ndarray:
    """Words of a bitmap that holds the leading bits of the one column of ``hashes`` (long); never above 16 MiB.

    About 32 cells for each hash as long as there is room; then more of what is asked for seems to be there.
    """
    hashes = hashes.toDF("h")
    bits = int(min(MAX_BITS, max(12, np.ceil(np.log2(32 * max(hashes.count(), 1))))))
    cells = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("cell"))
    got = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # at most 2 ** (MAX_BITS - 6) rows
    filled = np.zeros(1 << (bits - 6), dtype=np.uint64)
    filled[got.column("cell").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return filled


def in_bitmap(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) the bitmap may hold: none that it holds is missed."""
    bits = (64 * len(filled)).bit_length() - 1
    at = h.view(np.uint64) >> np.uint64(64 - bits)
    return (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
