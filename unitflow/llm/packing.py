"""Best-fit packing: documents into sequences of a fixed number of tokens.

Best-fit decreasing: longest first, each into the open sequence with the least room that still holds it. A
segment tree over the remaining capacities counts the open sequences of each, so a document takes logarithmic
time. Pieces are dealt by hash into groups of about GROUP pieces, each packed by one task; a group of thousands
leaves at most about one sequence half empty, so the loss against one global packing is below 1 in 1000.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import map_rows, text_bytes, written
from unitflow.llm.tokens import library_encoder, vocabulary

GROUP = 16_384


class Capacities:
    """Counts of open sequences by room left, 0 to most, in a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need of an open sequence, or -1."""
        count, node = self.count, need + self.size
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths are non-increasing, 1 to most."""
    tree, open_by_room, n = Capacities(most), [[] for _ in range(most + 1)], 0
    places, offsets = [], []
    for length in lengths:
        room = tree.tightest(length)
        if room < 0:
            place, room, n = n, most, n + 1
        else:
            place = open_by_room[room].pop()
            tree.add(room, -1)
        places.append(place)
        offsets.append(most - room)
        if room > length:
            open_by_room[room - length].append(place)
            tree.add(room - length, 1)
    return places, offsets


def pieces(docs: DataFrame, vocab_path: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece of at most `most` ids: doc_id, piece, start, length, ids_crc32, and row, a number of its own for every piece."""
    from pyspark import TaskContext

    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def work(batches):
        encode, end = library_encoder("word", vocab.value), end_id.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], work, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(table: DataFrame, most: int = 2048, group: int = GROUP) -> DataFrame:
    """The rows of a written table (with doc_id, piece, length, ids_crc32, row) with sequence_id and offset, without row. Groups are
    dealt by row, so that equal pieces don't meet in one."""
    n_groups = max(1, -(-table.count() // group))
    grouped = table.withColumn("pack_group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        places, offsets = best_fit(part.column("length").to_pylist(), most)
        number = part.column("pack_group")[0].as_py() << 32
        part = part.drop_columns(["pack_group", "row"])
        return part.append_column("sequence_id", pa.array(np.asarray(places, np.int64) + number)).append_column("offset", pa.array(offsets, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "row")
    return grouped.groupBy("pack_group").applyInArrow(work, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_path: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only longer ones than `most` are cut. A null or empty text is the end
    id alone. Rows that repeat a doc_id are packed each; a null doc_id stays null; an empty table gives none.
    Other columns are ignored."""
    return pack(written(pieces(docs, vocab_path, most, end_id), "pieces"), most)


def op4_packing(docs: DataFrame, vocab_path: str) -> DataFrame:
    return pack_documents(docs, vocab_path)
