"""Best-fit packing by hierarchical residual packing.

Pieces are dealt over partitions by hash, so that each sees the whole mix of lengths whatever the
order of the files. Each partition packs its pieces best-fit in decreasing order and emits the bins that are nearly
full. Underfull bins go on as items to fewer partitions, where they are packed again, up the tree;
the higher the level, the less full an emitted bin may be, so after a few levels every bin is emitted.
A task takes a bounded number of items at every level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, stage
from .tokens import END_ID, encode_column

CAPACITY = 1024
#: Items that one task packs at a time.
TASK_ITEMS = 200_000
#: Items that a partition of the first level has at least (on average), so that its mix is the whole's.
MIX_ITEMS = 2000
#: How many partitions of a level meet in one of the next.
FAN_IN = 4
#: Free tokens that an emitted bin may have on the first level; four times as many on each further one.
SLACK = 4

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each size, by best fit in decreasing order; ties go to the earlier item."""
    out = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0  # open_: a bit for each amount of space that some bin has left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                open_ ^= 1 << space
        else:
            space, b, bins = capacity, bins, bins + 1
        out[i] = b
        if space > size:
            free[space - size].append(b)
            open_ |= 1 << (space - size)
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: all but the first have ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, ids, counts in encode_column(batch.column(1), tokenizer, end_id):
                raw, at = memoryview(ids.tobytes()), 0
                row, piece, start, length, crc = [], [], [], [], []
                for d, n in enumerate(counts.tolist()):
                    begin, stop = 0, n % capacity or capacity
                    k = 0
                    while begin < n:
                        row.append(i + d)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(raw[4 * (at + begin) : 4 * (at + stop)]))
                        begin, stop, k = stop, stop + capacity, k + 1
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(bins: DataFrame, capacity: int) -> DataFrame:
    """Bins (``fill, members``) made of the given ones, within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            fill = table.column(0).to_numpy()
            own = best_fit(fill, capacity)
            order = np.argsort(own, kind="stable")
            members = table.column(1).combine_chunks()
            if isinstance(members, pa.ChunkedArray):
                members = members.chunk(0)
            sizes = np.diff(members.offsets.to_numpy())
            taken = members.take(pa.array(order))
            ends = np.cumsum(np.bincount(own, weights=sizes).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), taken.flatten())
            return pa.RecordBatch.from_arrays([pa.array(np.bincount(own, weights=fill).astype(np.int64)), lists], ["fill", "members"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= TASK_ITEMS:
                yield close()
                held, n = [], 0
        if held and n:
            yield close()

    return bins.select("fill", "members").mapInArrow(run, f"fill long, members array<{MEMBER}>")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text holds the end id alone. Rows that repeat an id are packed one by one, and
    rows with a null id too; other columns are ignored. An empty table gives no rows.
    """
    cut = stage(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    one = F.struct("doc_id", "piece", "start", "length", "ids_crc32").cast(MEMBER)
    single = cut.select(F.col("length").alias("fill"), F.array(one).alias("members"))
    done = [single.where(F.col("fill") == capacity)]
    rest = single.where(F.col("fill") < capacity)
    n = rest.count()
    parts, slack, first = max(1, -(-n // TASK_ITEMS), min(shuffle_partitions(cut.sparkSession), n // MIX_ITEMS)), SLACK, True
    # the checksum spreads pieces whose ids are null or repeated
    rest = rest.repartition(parts, F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.col("members")[0]["ids_crc32"]))
    while True:
        level = stage(_packed(rest if first else rest.repartition(parts), capacity), "packed")
        left = level.where(F.col("fill") < capacity - slack)
        n = left.count()
        if n == 0 or (parts == 1 and not first):
            done.append(level)
            break
        done.append(level.where(F.col("fill") >= capacity - slack))
        rest, first, slack = left, False, 4 * slack
        parts = max(1, -(-n // TASK_ITEMS), parts // FAN_IN) if n > TASK_ITEMS // 16 else 1
    bins = stage(reduce(DataFrame.unionByName, done), "bins").withColumn("sequence_id", F.monotonically_increasing_id())
    return _placed(bins)


def _placed(bins: DataFrame) -> DataFrame:
    """The members of each bin, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            counts = np.diff(members.offsets.to_numpy())
            each = members.flatten()
            columns = [each.field(k) for k in range(5)]
            before = np.concatenate([[0], np.cumsum(columns[3].to_numpy())])
            first = before[np.cumsum(counts) - counts]
            offset = before[:-1] - np.repeat(first, counts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(offset.astype(np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.select("sequence_id", "members").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
