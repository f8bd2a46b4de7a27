"""Substring dedup by difference-cover anchors.

A window of WINDOW words that occurs twice, at any two positions, also has an inner window of ANCHOR words that
starts at a cover position (modulo PERIOD) in both places, at the same distance: for every difference modulo
PERIOD the cover has two members that far apart. So

1. only windows at cover positions are hashed and counted (4 of 13 positions);
2. around anchors that occur twice, all full windows are hashed, and the first occurrence of each is found;
3. the words that other occurrences cover are removed.

Hashes travel as packed arrays, by buckets of their value, after each task has merged the equal ones of its own
slice: a passage that a third of all documents hold costs a bucket one entry a slice, not one a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import map_rows, map_whole_rows, quoted, slices, text_bytes, unused, written
from unitflow.llm.hashing import hash_words, join, mix, step, windows

WINDOW = 20
#: Fixed: the differences of these, modulo 13, are all of 0 to 12.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Repeated anchors (8 bytes each) are broadcast up to this size; beyond it they are joined by a shuffle.
ANCHOR_BYTES = 48 << 20
#: Bytes of packed entries that a bucket of hash values should hold; the buckets' number follows the input.
BUCKET_BYTES = 32 << 20
NO_ID = -(1 << 63)


class Slice:
    """Documents laid end to end: hashes of their words, and where each document starts."""

    def __init__(self, texts: list[bytes]):
        words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = hash_words([w for ws in words for w in ws])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(len(self.words)) - self.starts[self.doc]

    def inside(self, width: int) -> np.ndarray:
        """Whether a window of this width that starts here ends in the same document; for each start that has a window."""
        n = max(0, len(self.words) - width + 1)
        return self.at[:n] + width <= self.sizes[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes at cover positions, and where they start in the slice."""
        at = np.flatnonzero(self.inside(ANCHOR) & np.isin(self.at[: max(0, len(self.words) - ANCHOR + 1)] % PERIOD, COVER))
        return windows(self.words, ANCHOR)[at], at

    def near(self, repeated_at: np.ndarray) -> np.ndarray:
        """Starts of full windows that hold one of these anchors."""
        starts = (repeated_at[:, None] - np.arange(PERIOD)[None, :]).ravel()
        starts = np.unique(starts[starts >= 0])
        fits = self.inside(WINDOW)
        starts = starts[starts < len(fits)]
        return starts[fits[starts]]


def _docs(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))


def _bounds(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hash values starts in the sorted hashes."""
    return np.searchsorted(hashes, np.array([(k << 64) // n for k in range(n)], np.uint64))


def repeated_anchors(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of (n, packed sorted hashes): the anchors that occur twice or more."""

    def local(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = np.unique(Slice(part.column(0).to_pylist()).anchors()[0], return_counts=True)
                hashes = np.repeat(hashes, np.minimum(counts, 2))
                cut = [*_bounds(hashes, n_buckets), len(hashes)]
                full = [k for k in range(n_buckets) if cut[k] < cut[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([hashes[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "hashes"])

    def merged(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64).copy()
        hashes.sort()
        twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        return pa.table({"n": pa.array([len(twice)], pa.int64()), "hashes": pa.array([twice.tobytes()], pa.binary())})

    found = map_rows(_docs(docs), [text_bytes()], local, "bucket int, hashes binary").groupBy("bucket").applyInArrow(merged, "n long, hashes binary")
    return written(found, "anchors")


def _entries(part: Slice, starts: np.ndarray, ids: np.ndarray, ofs: np.ndarray, n_buckets: int, own: int):
    """Rows (bucket, kind, docs, doc, at, hash): kind 0 has, per bucket of hash values, the first occurrences of this slice's
    windows; kind 1 the others, which are repeats already."""
    every = windows(part.words, WINDOW)
    h, g = every[starts], mix(windows(part.words[::-1] ^ step(3), WINDOW)[::-1][starts]).astype(np.uint32)
    doc, at = part.doc[starts], part.at[starts]
    order = np.lexsort((at, ids[doc], g, h))
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    first = (ids[doc] == ids[doc[head]]) & (at == at[head])
    docs = np.stack((ids, ofs), axis=1)

    def row(bucket, kind, pick):
        used, doc_of = np.unique(doc[pick], return_inverse=True)
        data = np.concatenate((h[pick].view(np.uint32).reshape(-1, 2), g[pick][:, None]), axis=1) if kind == 0 else np.zeros(0, np.uint32)
        return bucket, kind, docs[used].tobytes(), doc_of.astype(np.uint32).tobytes(), at[pick].astype(np.uint32).tobytes(), data.tobytes()

    rows = []
    if (~first).any():
        rows.append(row(own % n_buckets, 1, np.flatnonzero(~first)))
    keep = np.flatnonzero(first)
    cut = [*_bounds(h[keep], n_buckets), len(keep)]
    rows += [row(k, 0, keep[cut[k] : cut[k + 1]]) for k in range(n_buckets) if cut[k] < cut[k + 1]]
    return rows


ENTRY = "bucket int, kind int, docs binary, doc binary, at binary, hash binary"


def _batch(rows: list[tuple], schema: str):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*((n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


def _repeats(entries: DataFrame, n_out: int) -> DataFrame:
    """Per row of docs that has any: id, of, and the packed sorted starts of its windows that also start earlier."""

    def later(table: pa.Table) -> pa.Table:
        parts = {0: [], 1: []}
        for kind, docs, doc, at, data in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "doc", "at", "hash"))):
            docs = np.frombuffer(docs, np.int64).reshape(-1, 2)[np.frombuffer(doc, np.uint32)]
            parts[kind].append((docs, np.frombuffer(at, np.uint32), np.frombuffer(data, np.uint32).reshape(-1, 3)))
        docs, at = np.zeros((0, 2), np.int64), np.zeros(0, np.uint32)
        if parts[1]:
            docs, at, _ = (np.concatenate(c) for c in zip(*parts[1]))
        if parts[0]:
            d, a, x = (np.concatenate(c) for c in zip(*parts[0]))
            order = np.lexsort((a, d[:, 0], x[:, 2], x[:, 1], x[:, 0]))
            d, a, x = d[order], a[order], x[order]
            new = np.ones(len(a), bool)
            new[1:] = (x[1:] != x[:-1]).any(axis=1)
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (d[:, 0] != d[head, 0]) | (a != a[head])
            docs, at = np.concatenate((docs, d[late])), np.concatenate((at, a[late]))
        order = np.lexsort((at, docs[:, 1], docs[:, 0]))
        docs, at = docs[order], at[order]
        out = (mix(docs[:, 0].astype(np.uint64)) % np.uint64(n_out)).astype(np.int64)
        rows = []
        for k in np.unique(out):
            pick = out == k
            used, doc = np.unique(docs[pick], axis=0, return_inverse=True)
            rows.append((int(k), used.tobytes(), doc.ravel().astype(np.uint32).tobytes(), at[pick].astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_batch(rows, "out int, docs binary, doc binary, at binary")])

    def by_doc(table: pa.Table) -> pa.Table:
        docs, at = [], []
        for d, i, a in zip(*(table.column(c).to_pylist() for c in ("docs", "doc", "at"))):
            docs.append(np.frombuffer(d, np.int64).reshape(-1, 2)[np.frombuffer(i, np.uint32)])
            at.append(np.frombuffer(a, np.uint32))
        docs, at = np.concatenate(docs), np.concatenate(at)
        order = np.lexsort((at, docs[:, 1], docs[:, 0]))
        docs, at = docs[order], at[order]
        cut = [*np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]).any(axis=1)))), len(at)]
        rows = [(int(docs[i, 0]), int(docs[i, 1]), at[i:j].tobytes()) for i, j in zip(cut, cut[1:])]
        return pa.Table.from_batches([_batch(rows, "id long, of long, at binary")])

    found = entries.groupBy("bucket").applyInArrow(later, "out int, docs binary, doc binary, at binary")
    return found.groupBy("out").applyInArrow(by_doc, "id long, of long, at binary")


def bucket_count(docs: DataFrame) -> int:
    """Two buckets a shuffle partition, or as many as keep one at about BUCKET_BYTES: a window's entry takes 20 bytes, and texts have
    no more words than half their bytes; most have a sixth."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(2 * partitions, -(-(size // 6 * 20) // BUCKET_BYTES))


def repeated_windows(docs: DataFrame, broadcast_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Per (id, of) with any: the packed starts of windows of WINDOW words that also start earlier."""
    spark = docs.sparkSession
    n_buckets = bucket_count(docs)
    anchors = repeated_anchors(docs, n_buckets)
    total = anchors.agg(F.sum("n")).first()[0] or 0
    base = _docs(docs)
    if 8 * total <= broadcast_bytes:
        known = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r[0] for r in anchors.select("hashes").collect()), np.uint64)))

        def work(batches):
            for batch in batches:
                for piece in slices(batch, most=2 << 20):
                    part = Slice(piece.column(2).to_pylist())
                    hashes, at = part.anchors()
                    twice = known.value
                    found = np.minimum(np.searchsorted(twice, hashes), max(0, len(twice) - 1))
                    starts = part.near(at[twice[found] == hashes]) if len(twice) else at[:0]
                    ids, ofs = (np.asarray(piece.column(c).to_numpy()) for c in (0, 1))
                    rows = _entries(part, starts, ids, ofs, n_buckets, int(ids[0]) % 1_000_003)
                    if rows:
                        yield _batch(rows, ENTRY)

        entries = map_rows(base, ["id", "of", text_bytes()], work, ENTRY)
    else:
        entries = _joined_entries(base, anchors, n_buckets)
    return _repeats(entries, n_buckets)


def _joined_entries(base: DataFrame, anchors: DataFrame, n_buckets: int) -> DataFrame:
    """The same entries without a broadcast: anchors with their places meet the repeated ones by hash, and the places
    found go back to their texts."""

    def places(batches):
        for batch in batches:
            for piece in slices(batch):
                part = Slice(piece.column(2).to_pylist())
                hashes, at = part.anchors()
                ids, ofs = (np.asarray(piece.column(c).to_numpy()) for c in (0, 1))
                doc = part.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(ofs[doc], pa.int64()), pa.array(part.at[at].astype(np.int32))], ["h", "id", "of", "at"])

    def unpacked(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64))], ["h"])

    twice = anchors.select("hashes").mapInArrow(unpacked, "h long")
    held = map_rows(base, ["id", "of", text_bytes()], places, "h long, id long, of long, at int").join(twice, "h")
    # equal rows of docs share their places, so each place is wanted once
    where = held.groupBy("id", "of").agg(F.array_sort(F.collect_set("at")).alias("at"))

    def work(batches):
        for batch in batches:
            for piece in slices(batch, most=2 << 20):
                part = Slice(piece.column(2).to_pylist())
                at = np.concatenate([np.asarray(a, np.int64) + s for a, s in zip(piece.column(3).to_pylist(), part.starts)])
                ids, ofs = (np.asarray(piece.column(c).to_numpy()) for c in (0, 1))
                rows = _entries(part, part.near(at), ids, ofs, n_buckets, int(ids[0]) % 1_000_003)
                if rows:
                    yield _batch(rows, ENTRY)

    return map_rows(base.join(where, ["id", "of"]), ["id", "of", text_bytes(), "at"], work, ENTRY)


def substring_dedup(docs: DataFrame, broadcast_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept_text (kept words joined by one space); columns of these names are replaced.

    A word goes if a window of WINDOW words over it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Null or empty texts have no words. Rows that repeat a doc_id are texts of one document, each with
    positions of its own; equal rows get equal results, and equal places in them don't count as earlier. A null doc_id is
    smaller than all others. An empty table gives an empty table."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    repeats = repeated_windows(docs, broadcast_bytes)
    found, own_text, places = unused([*docs.columns, "n_words", "n_removed", "kept_text"], "found", "own_text", "places")
    repeats = repeats.select(F.struct("id", "of", "at").alias(found))
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(f"{found}.id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(f"{found}.of"))
    names, types = docs.columns, {"n_words": "long", "n_removed": "long", "kept_text": "string"}

    def work(batches):
        for batch in batches:
            text, at, out = batch.column(own_text), batch.column(places), []
            for t, a in zip(text.to_pylist(), at.to_pylist()):
                words = t.split()
                n, gone = len(words), 0
                if a:
                    edge = np.zeros(n + 1, np.int64)
                    starts = np.frombuffer(a, np.uint32).astype(np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WINDOW, -1)
                    keep = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                    gone = n - len(keep)
                    words = [words[i] for i in keep.tolist()]
                out.append((n, gone, b" ".join(words).decode("utf-8", "replace")))
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array(c, k) for c, k in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *types])

    full = docs.join(repeats, own, "left").select(*quoted(names), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(own_text), F.col(f"{found}.at").alias(places))
    fields = [*((f.name, f.dataType.simpleString()) for f in docs.schema), *types.items()]
    return map_whole_rows(full, work, fields)


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
