"""Token-id output: length-delimited binary records with masked checksums, and an index of offsets for shuffled reads.

A record is: length of the payload (u64), masked crc32 of those 8 bytes (u32), payload, masked crc32 of the payload
(u32), all little-endian. The payload is one byte (0 if doc_id is null), doc_id (i64), the ids' width in bytes (u8: 2 if
every id of the vocabulary fits, else 4) and the ids. Each shard has an index file beside it: per record its offset, its
number of ids, and the ids before it in the shard, u64 each. Files go to any file system that Arrow knows, the shared
folder by default; a shard is written under a name of its own and then renamed, so a task that runs again after
a lost executor, or twice at once, leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm.common import map_rows, shared_dir, text_bytes, written
from unitflow.llm.tokens import library_encoder, plain_tokenizer, vocabulary

HEAD, FOOT, INDEX = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<QQQ")
KEY = struct.Struct("<BqB")
FRAME = HEAD.size + FOOT.size


def masked(data: bytes) -> int:
    """A checksum that may be stored beside the data it covers: rotated by 15 bits, plus a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, FOOT.pack(masked(length)), payload, FOOT.pack(masked(payload))))


def serialise(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return KEY.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = KEY.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=KEY.size).astype("<u4")


def index_entry(at: int, n_ids: int, before: int) -> bytes:
    return INDEX.pack(at, n_ids, before)


def read_record(stream) -> bytes | None:
    """The next payload, or None at the end. Raises ValueError where lengths or checksums don't hold."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a record's head is cut off")
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length fails its checksum")
    payload, foot = stream.read(length), stream.read(FOOT.size)
    if len(payload) < length or len(foot) < FOOT.size or FOOT.unpack(foot)[0] != masked(payload):
        raise ValueError("a record's payload fails its checksum")
    return payload


def files(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def index_entries(data: bytes) -> list[tuple[int, int, int]]:
    """Per record: its offset, its number of ids, and the ids before it in the shard. Raises ValueError where they don't fit."""
    if len(data) % INDEX.size:
        raise ValueError("an index entry is cut off")
    entries, total = list(INDEX.iter_unpack(data)), 0
    for _, n_ids, before in entries:
        if before != total:
            raise ValueError("the index's counts of ids don't add up")
        total += n_ids
    return entries


def ids_in(index) -> int:
    """The number of ids of a shard, by the last entry of its open index file."""
    if index.size() < INDEX.size:
        raise ValueError("an index entry is cut off")
    _, n_ids, before = INDEX.unpack(index.read_at(INDEX.size, index.size() - INDEX.size))
    return before + n_ids


def read_at(uri: str, shard: int, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard by its index: for reads in any order."""
    system, root = files(uri)
    with system.open_input_file(f"{root}/{shard:06d}.idx") as f:
        offset = INDEX.unpack(f.read_at(INDEX.size, k * INDEX.size))[0]
    with system.open_input_file(f"{root}/{shard:06d}.rec") as f:
        f.seek(offset)
        return parse(read_record(f))


def write_records(docs: DataFrame, vocab_path: str, uri: str, end_id: int = 0) -> DataFrame:
    """Writes all documents in ascending doc_id order (null first, then by text) and returns per shard that has rows:
    shard (ascending like the ids), n_records, n_ids."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(vocab_path))
    width = 2 if plain_tokenizer(vocab.value).get_vocab_size() <= 1 << 16 else 4
    system, root = files(uri)
    system.create_dir(root, recursive=True)

    def work(batches):
        from pyspark import TaskContext

        encode, shard = library_encoder("byte", vocab.value), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        system, root = files(uri)
        mark, out, n, total, at = uuid.uuid4().hex, None, 0, 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    out, index = (system.open_output_stream(f"{root}/.{shard:06d}-{mark}.{kind}") for kind in ("rec", "idx"))
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                record = frame(serialise(doc_id, ids, width))
                out.write(record)
                index.write(index_entry(at, len(ids), total))
                n, total, at = n + 1, total + len(ids), at + len(record)
        if out is not None:
            for stream, kind in ((out, "rec"), (index, "idx")):
                stream.close()
                system.move(f"{root}/.{shard:06d}-{mark}.{kind}", f"{root}/{shard:06d}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [n], "n_ids": [total]}, pa.schema([("shard", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return written(ordered.mapInArrow(work, "shard int, n_records long, n_ids long"), "shards")


def read_records(spark: SparkSession, uri: str) -> DataFrame:
    """Per record of the shards at uri: doc_id, start (ids of all records before it), n_tokens, ids_crc32, as read from the files.

    The index files say where records start and how many ids stand before them; every record is held against its entry. Only
    the totals come to the driver, a row a shard."""
    from pyarrow import fs

    system, root = files(uri)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    shards = sorted(int(n.removesuffix(".idx")) for n in names if n.endswith(".idx") and not n.startswith("."))
    listed = spark.createDataFrame([(k,) for k in shards], "shard int").repartition(max(1, len(shards)), "shard")

    def totals(batches):
        system, root = files(uri)
        for batch in batches:
            ends = []
            for shard in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{shard:06d}.idx") as f:
                    ends.append((shard, ids_in(f)))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), (pa.int32(), pa.int64()))], ["shard", "n_ids"])

    starts, total = [], 0
    for shard, n_ids in sorted(listed.mapInArrow(totals, "shard int, n_ids long").collect()):
        starts.append((shard, total))
        total += n_ids

    def work(batches):
        system, root = files(uri)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_stream(f"{root}/{shard:06d}.idx") as stream:
                    entries = index_entries(stream.read())
                with system.open_input_stream(f"{root}/{shard:06d}.rec") as stream:
                    out, place = [], 0
                    for offset, n_ids, before in entries:
                        payload = read_record(stream) if place == offset else None
                        if payload is None:
                            raise ValueError(f"shard {shard} has no record where its index has one")
                        place += FRAME + len(payload)
                        doc_id, ids = parse(payload)
                        if len(ids) != n_ids:
                            raise ValueError(f"shard {shard} has a record of another length than its index says")
                        out.append((doc_id, start + before, n_ids, zlib.crc32(ids.tobytes())))
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out = []
                    if read_record(stream) is not None:
                        raise ValueError(f"shard {shard} has more records than its index")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    table = spark.createDataFrame(starts, "shard int, start long").repartition(max(1, len(starts)), "shard")
    return table.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocab_path: str, uri: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the records and returns what the files hold, per document.

    A null or empty text is the end id alone. Rows that repeat a doc_id each have a record, ordered by text; a null
    doc_id comes first and stays null. An empty table writes no shard and gives an empty table. Other columns are ignored."""
    uri = uri or f"{shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    write_records(docs, vocab_path, uri, end_id)
    return read_records(docs.sparkSession, uri)


def op9_token_output(docs: DataFrame, vocab_path: str) -> DataFrame:
    return token_output(docs, vocab_path)
