"""Best-fit packing by minimum bin slack.

Documents are tokenised on the executors and only those longer than a sequence are cut.  What decides a packing is the
histogram of piece lengths, at most ``limit`` rows whatever the corpus holds, so the minimum-bin-slack search runs on that:
for each bin the largest length left is fixed, a bitset subset-sum over the other available lengths finds the fullest
feasible combination, and the combination is removed as often as the counts allow (repeating it is what the search would
choose again while all its lengths last).  The outcome is a bounded table of rank ranges; every piece finds its place from
its exact rank among the pieces of equal length, which is counted in hash buckets: as many a length as its own count asks for,
so that a very common length is never one task's work and a rare one is a single bucket.

Defined results: a null text is an empty text and gives one piece with only the end id; a null doc_id is kept as null;
repeated rows are packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import id_and_text, materialize, rows_per_bucket, with_prefix_counts, word_ids

LIMIT = 4096
END_ID = 1
#: About so many pieces of one length are ranked in one bucket.
BUCKET_ROWS = 2_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Tokenise every text, append ``end_id`` and cut what is longer than ``limit`` into pieces."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer_file)
        for batch in batches:
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to ``room``, as (length, copies).

    Bit s of ``reach`` says that s can be made; ``steps`` keeps what could be made before each added copy.
    """
    reach, full, mask = 1, 1 << room, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach & full:
                break
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        if total and not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + 1
            total -= length
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Minimum bin slack over a histogram of lengths.

    Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy): from that rank on, pieces of
    the length fill the sequences one after the other.
    """
    counts = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    plan: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        bin_ = dict(fullest(counts, lengths, limit - largest))
        counts[largest] += 1
        bin_[largest] = bin_.get(largest, 0) + 1
        times = min(counts[length] // copies for length, copies in bin_.items())
        offset = 0
        for length, copies in sorted(bin_.items(), reverse=True):
            plan.append((length, used[length], sequence, copies, offset))
            offset += length * copies
            used[length] += copies * times
            counts[length] -= copies * times
        sequence += times
        lengths = [length for length in lengths if counts[length]]
    return plan


def pack(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Place all documents in as few sequences of at most ``limit`` ids as the search finds."""
    cut = materialize(pieces(docs, tokenizer_file, limit, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    ways = docs.sparkSession.createDataFrame([(length, rows_per_bucket(n, BUCKET_ROWS)) for length, n in histogram.items()], "length bigint, ways bigint")
    cut = cut.join(F.broadcast(ways), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("ways"))).drop("ways")
    cells = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    cells = materialize(with_prefix_counts(cells, ["length"], "bucket", "n", "before"), "cells")

    plan = np.array(sorted(plan_bins(histogram, limit)) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    starts = (plan[:, 0] << 44) + plan[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((starts, plan))  # a few rows for each of at most `limit` lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, plan = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = plan[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("nth", nth).join(cells.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
