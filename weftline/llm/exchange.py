"""Counting keys over a whole corpus without one shuffled row per key.

Texts are dealt into *blocks* (a few MB each, by a hash of the row). A task
turns a block into its sorted distinct 64-bit keys and sends them, packed, to
*buckets*; a bucket sees every block's keys of one hash range, answers each
packed row with an array in the same order, and the answers meet the texts of
their block again. A key costs 8 bytes on the wire however often a block
holds it, so a very frequent key costs at most one entry per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "block int, bucket int, keys binary, extra binary"
ANSWER = "block int, bucket int, answer binary"


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; where none is named, set one on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            named = warehouse.rstrip("/") + "_checkpoints"
        sc.setCheckpointDir(named)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder, for rows that are read back from it."""
    checkpoint_dir(spark)
    _SCRATCH.append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def scratch_folders() -> list[str]:
    return list(_SCRATCH)


def drop_scratch(spark: SparkSession, keep: list[str]) -> None:
    """Delete the folders of ``scratch`` that nothing reads any more, all but ``keep``."""
    for path in [x for x in _SCRATCH if x not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def dealt(docs: DataFrame, columns: list[str], total: int, block_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """``columns`` of docs with the number of the block each row goes to.

    Rows are dealt by a hash of all their columns, so that null or repeated
    ids don't meet in one block unless the whole rows are the same."""
    spark = docs.sparkSession
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    return docs.select(F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias("block"), *columns), n


def bucket_count(spark: SparkSession, keys: int, per_bucket: int = 1 << 20) -> int:
    return int(min(1 << 30, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // per_bucket))))


def bucket_order(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by bucket, then key."""
    order = np.argsort(key)
    small = bucket.astype(np.uint16) if len(bucket) == 0 or int(bucket.max()) < 65536 else bucket
    return order[np.argsort(small[order], kind="stable")]


def distinct(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, key) of the distinct pairs in order, and for each input its place among them."""
    order = bucket_order(bucket, key)
    b, k = bucket[order], key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return b[new], k[new], place


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on: what Spark's
    compression of shuffled rows makes small where high bytes are alike."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def planes_of_steps(ascending: np.ndarray) -> bytes:
    """``planes`` of the differences of ascending keys."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def from_planes_of_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def packed(block: int, bucket: np.ndarray, key: np.ndarray, extra: np.ndarray | None = None, write_keys: Callable[[np.ndarray], bytes] = np.ndarray.tobytes, write_extra: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> pa.Table:
    """One row for each bucket; ``bucket`` and ``key`` as ``distinct`` returns them."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table(
        {
            "block": pa.array([block] * len(spans), pa.int32()),
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            "keys": pa.array([write_keys(key[a:b]) for a, b in spans], pa.binary()),
            "extra": pa.array([b"" if extra is None else write_extra(extra[a:b]) for a, b in spans], pa.binary()),
        }
    )


def unpacked(table: pa.Table, column: str, dtype=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=dtype) for x in table.column(column).to_pylist()]


def answers(table: pa.Table, parts: list[bytes]) -> pa.Table:
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array(parts, pa.binary())})


def joined(table: pa.Table, dtype) -> np.ndarray:
    """The answers of a block in the order of its packed keys."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(x, dtype=dtype) for _, x in rows]) if rows else np.zeros(0, dtype)


def repeated_bits(table: pa.Table) -> pa.Table:
    """Answer of a bucket: for each packed row, the bits of keys that another block holds too."""
    keys = unpacked(table, "keys")
    _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = (count > 1)[place]
    return answers(table, [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(k) for k in keys])[:-1])])


def joined_bits(table: pa.Table, bucket: np.ndarray) -> np.ndarray:
    """The bits of ``repeated_bits`` for all keys of a block; ``bucket`` of its distinct keys."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True))
    sizes = np.unique(bucket, return_counts=True)[1]
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for (_, x), n in zip(rows, sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def by_block(texts: DataFrame, pack: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """pack: a block's texts to packed rows; answer: a bucket's packed rows to
    their answers; finish: a block's texts and answers to the rows returned."""
    replies = texts.groupBy("block").applyInArrow(pack, PACKED).groupBy("bucket").applyInArrow(answer, ANSWER)
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
