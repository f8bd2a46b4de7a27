"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

Texts with equal shingle sets are one class; only class representatives go on. A bucket of a band is not
expanded into pairs: first every member is verified against one centre of the bucket; what is linked so needs
no further pair. Buckets that then still hold several components are taken further: small ones are paired between members in
different components, large ones have more centres tried. The members of large ones that hold several components even then are
dealt anew, exactly, by their rarest shingles (prefix filter), with the places they stand at, and paired where components still
differ. So a group of copies costs about its size, and no link is lost that a shared band can show. At likeness 0.8 a pair
shares no band with a probability below 1e-7. Components are worked out once; later links only join components that exist.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import drop_written, join_small, map_rows, slices, text_bytes, written
from unitflow.llm.components import components, joined
from unitflow.llm.hashing import GOLDEN, hash_words, join, mix, step, windows

BANDS, ROWS = 32, 4
#: Buckets of so many members are paired directly: a bounded number of pairs a member.
SMALL = 16
#: Centres that a large bucket is verified against before any pairing; more leave fewer pairs, and none decides a result.
STARS = 3


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than width count as one shingle, no words as none."""
    words = hash_words(text.lower().split())
    if not len(words):
        return words
    if len(words) < width:
        return mix(windows(words, len(words)) + step(len(words)))
    return np.unique(windows(words, width))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of non-empty sets. Step j gives every element the j-th place of its own random permutation of the m
    components and the value j + r there, r uniform; a component keeps the least value. A set is done when
    all its components are at most j + 1, since no later step can lower them: large sets need one to three steps."""
    out = np.full((len(sets), m), np.inf)
    flat = out.reshape(-1)
    items, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places, rows = None, None
    for j in range(m):
        x = mix(items + step(j + 1))
        pick = j + (mix(x) % np.uint64(m - j)).astype(np.int64)
        value = j + (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        if places is None:
            place = pick
        else:
            place = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[rows, j]
        np.minimum.at(flat, of * m + place, value)
        live = out.max(axis=1) > j + 1
        keep = live[of]
        if j == 0:
            items, of, pick = items[keep], of[keep], pick[keep]
            places, rows = np.tile(np.arange(m, dtype=np.uint8), (len(items), 1)), np.arange(len(items))
            places[rows, pick] = 0
        elif keep.sum() < 0.7 * len(keep):
            items, of, places = items[keep], of[keep], places[keep]
            rows = np.arange(len(items))
        if not len(items):
            break
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    n, m = signatures.shape
    bits = signatures.view(np.uint64).reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * GOLDEN, (n, bands))
    for k in range(m // bands):
        key = join(key, bits[:, :, k])
    return key.view(np.int64)


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), bands."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(superminhash(full, bands * rows), bands).tolist()) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return map_rows(docs, [F.col("doc_id").cast("long").alias("doc_id"), text_bytes()], work, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "items"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return map_rows(chosen, ["id", text_bytes()], work, "id long, items binary")


#: Sizes of sets are classed by powers of this.
RATIO = 1.05
#: Cells of the table of counts that orders items: a byte each.
CELLS = 1 << 20
#: Rows of a key that one task pairs with the rest of the key.
CHUNK = 4096
#: Longs of a set's parity bitmap, and the columns that hold them.
BITS = 9
PARITY = [f"s{k}" for k in range((1 << BITS) // 64)]


def parity(items: np.ndarray) -> np.ndarray:
    """A bitmap in which every item flips one bit: two sets' bitmaps differ in at most as many bits as the sets in items."""
    odd = np.bincount((items >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(RATIO)).astype(np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def work(batches):
        for batch in batches:
            a, b, keep, last, x = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], None, None
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                if a[i] != last:
                    last, x = a[i], np.frombuffer(p.as_buffer(), np.uint64)
                y = np.frombuffer(q.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("set_a")), "a")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, id) with their component's label, and n, of buckets that still hold several components."""
    now = written(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "labelled")
    several = now.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key", "n")
    several = written(several, "several")
    found = written(join_small(now, several, ["key"], 16, ["id"]), "open-buckets")
    drop_written(now)
    drop_written(several)
    return found


def _stars(members: DataFrame, turns: range) -> DataFrame:
    """For each turn one centre a bucket, by a hash of its id and the turn, paired with the members of other components."""
    by = lambda turn: F.xxhash64(F.lit(turn), F.col("id"))
    centres = members.groupBy("key").agg(F.array(*[F.min_by(F.struct("id", "label"), by(t)) for t in turns]).alias("cs"))
    centres = written(centres.select("key", F.explode(F.array_distinct("cs")).alias("c")), "centres")
    return join_small(members, centres, ["key"], 32, ["id"]).filter("id <> c.id and label <> c.label").select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """The pairs of a bucket that are in different components."""
    return members.alias("x").join(members.alias("y"), "key").filter("x.label < y.label").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def rarity(sets: DataFrame) -> bytes:
    """How often items occur, by cell of their hash: a byte each, 0 for never, 1 for once, then 8 a doubling. One size at any input;
    the sums are made by cell over all tasks, and one row of CELLS bytes comes to the driver."""

    def counted(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            items = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)] or [np.zeros(0, np.uint64)])
            total += np.bincount((items % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(total)
        for k in range(0, len(cells), 100_000):
            some = cells[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    def packed(table: pa.Table) -> pa.Table:
        out = np.zeros(CELLS, np.uint8)
        out[table.column("cell").to_numpy()] = np.minimum(255, 1 + 8 * np.log2(table.column("n").to_numpy())).astype(np.uint8)
        return pa.table({"counts": pa.array([out.tobytes()], pa.binary())})

    cells = sets.select("items").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(packed, "counts binary").first()
    return found[0] if found else bytes(CELLS)


def _rare(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets in different components that a prefix filter with places leaves; no linked pair is lost.

    All items stand in one order, rarest first. Linked sets x and y, x not the smaller, share at least
    need = ceil(percent * (|x| + |y|) / (100 + percent)) items, so their first shared item stands at most at |x| - need in x
    and |y| - need in y. Each set is dealt by the items of its first places: once by its own size's class, and, as
    the larger one, to each class of smaller sizes for which that place still suffices. Documents that all hold one
    passage, or copies that differ from each other in more than a link allows, have items of their own in these
    places and don't meet. Where one component has most of a bucket, only the others are paired with it. Linked sets differ in
    at most (100 - percent) * (|x| + |y|) / (100 + percent) items, so a pair whose parity bitmaps differ in more bits is none."""

    # the order: by the count of an item's cell among CELLS, then by item. Any order is exact; this one is nearly by rarity
    held = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def dealt(batches):
        need = lambda m: -(-percent * m // (100 + percent))
        cells = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            listed, maps = [], []
            for i, items, label in zip(*(batch.column(c).to_pylist() for c in ("id", "items", "label"))):
                x = np.frombuffer(items, np.uint64)
                often = cells[x % np.uint64(CELLS)]
                first = np.lexsort((x, often))[: len(x) - -(-percent * len(x) // 100) + 1]
                at = np.flatnonzero(often[first] > 1)  # an item alone in its cell is in no other set
                listed.append((np.full(len(at), i), np.full(len(at), label), np.full(len(at), len(x)), at, x[first[at]].view(np.int64), np.full(len(at), len(maps))))
                maps.append(parity(x))
            if not listed:
                continue
            i, label, n, at, item, row = (np.concatenate(c) for c in zip(*listed))
            maps = np.stack(maps)
            own = size_class(n)
            out = []
            for below in range(0, 2 + int(size_class(np.array([100 * 100]))[0] - size_class(np.array([100 * percent]))[0])):
                low = np.maximum(np.floor(RATIO ** (own - below)).astype(np.int64) - 1, -(-percent * n // 100))
                pick = np.flatnonzero(at <= n - need(n + low))
                out.append((pick, own[pick] - below, 1))
            pick = np.flatnonzero(at <= n - need(2 * n))
            out.append((pick, own[pick], 0))
            for pick, cls, larger in out:
                if len(pick):
                    key = join(item[pick].view(np.uint64), cls.astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(i[pick]), pa.array(label[pick]), pa.array(n[pick]), pa.array(at[pick].astype(np.int64)), pa.array(np.full(len(pick), larger, np.int64)), *[pa.array(maps[row[pick], k]) for k in range(len(PARITY))]], ["key", "id", "label", "n", "place", "larger", *PARITY])

    labelled = sets.join(labels, "id", "left").select("id", "items", F.coalesce("label", "id").alias("label"))
    rows = labelled.mapInArrow(dealt, "key long, id long, label long, n long, place long, larger long, " + ", ".join(f"{c} long" for c in PARITY))
    rows = written(rows, "rare-items")
    held.destroy()
    per_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.max("larger").alias("hi"), F.min("larger").alias("lo"))
    mixed = per_label.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("k"), F.max("hi").alias("hi"), F.min("lo").alias("lo")).filter("labels > 1 and lo = 0 and hi = 1")
    mixed = written(mixed.select("key", "most", F.ceil(F.col("k") / CHUNK).cast("int").alias("parts")), "rare-keys")
    kept = written(join_small(rows, mixed, ["key"], 24, ["id"]), "rare-buckets")
    drop_written(rows)
    drop_written(mixed)
    # a hot key's larger sets are split into parts, and each part meets all its smaller ones
    x = kept.filter("larger = 1").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("x")
    y = kept.filter("larger = 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    fits = f"x.label <> y.label and y.n <= x.n and 100 * y.n >= {percent} * x.n and {100 + percent} * (1 + least(x.n - 1 - x.place, y.n - 1 - y.place)) >= {percent} * (x.n + y.n)"
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in PARITY)
    fits += f" and {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    others = x.join(y.filter("label <> most"), same & F.expr(fits)).select(*pair)
    with_most = x.filter("label <> most").join(y.filter("label = most"), same & F.expr(fits)).select(*pair)
    return others.unionByName(with_most).distinct()


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Words are maximal runs of non-white-space (ASCII), A-Z lower-cased; a document's set has its distinct shingles of
    `width` words, its whole sequence if it has fewer, nothing without words. Documents are linked where 100 *
    intersection >= percent * union; component_id is the smallest doc_id reachable. Documents without shingles
    are linked with nothing. Rows that repeat a doc_id are one document with several texts: linked if any of them is. A null
    doc_id is linked with nothing, its component_id null and kept true. An empty table gives an empty table;
    other columns are ignored."""
    signed = written(_signed(docs, width, bands, rows), "signatures")
    known = signed.filter("doc_id is not null and set_key is not null")
    classes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("id", F.explode("bands").alias("key"))
    shared = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-keys")
    members = written(join_small(buckets, shared, ["key"], 8, ["id"]), "buckets")
    sets = written(_sets(docs.filter("doc_id is not null"), members.select("id").distinct(), width), "sets")

    # a doc_id with texts of several classes ties these together
    several = known.withColumn("h", F.xxhash64("set_key")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("doc_id")
    ties = known.select("doc_id", "set_key").join(several, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key")
    ties = ties.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    links = written(_linked(_stars(members.withColumn("label", F.col("id")), range(1)), sets, percent).unionByName(ties), "links")
    labels = components(links)
    left = _open(members, labels)
    small, large = left.filter(F.col("n") <= SMALL), left.filter(F.col("n") > SMALL)
    if not left.isEmpty():
        pairs = _pairs(small)
        if STARS > 1:
            pairs = pairs.unionByName(_stars(large, range(1, STARS))).distinct()
        labels = joined(labels, written(_linked(pairs, sets, percent), "links"))
        large = _open(large.select("key", "id"), labels)
        if not large.isEmpty():
            labels = joined(labels, written(_linked(_rare(sets.join(large.select("id").distinct(), "id", "left_semi"), labels, percent), sets, percent), "links"))

    ids = known.select("set_key", "doc_id").distinct().join(classes.select("set_key", "id"), "set_key").join(labels, "id", "left")
    joined_ids = ids.select("doc_id", F.coalesce("label", "id").alias("label"))
    joined_ids = written(joined_ids.groupBy("doc_id").agg(F.min("label").alias("component_id")).withColumnRenamed("doc_id", "known_id"), "component-ids")
    for table in (classes, shared, members, sets, links, left, labels):
        drop_written(table)
    return (
        signed.select("doc_id", "n_shingles")
        .join(joined_ids, F.col("doc_id") == F.col("known_id"), "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def op5_near_dedup(docs: DataFrame) -> DataFrame:
    return near_components(docs, width=2, percent=80)
