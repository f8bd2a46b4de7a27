"""Token counts of whole texts without their ids: pieces are counted once per distinct pre-token and joined to how often each
document holds it.

A slice of documents (about 16 MB of text) is a block: it numbers its distinct pre-tokens and keeps, per document, their numbers and
frequencies. Only the blocks' vocabularies are shuffled by pre-token, so that the most frequent word has one row a block, not one an
occurrence. Equal pre-tokens then follow each other and are encoded once; the counts go back by block, packed, and are joined there to
the frequencies.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import map_rows, slices, text_bytes, written
from unitflow.llm.tokens import BYTE_SPLIT, CHUNK, WIDE_SPACE, WORD_SPLIT, Plain, plain_tokenizer, vocabulary

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK = 16 << 20
LIMIT = 2048


class PreTokens:
    """Cuts a text into parts whose token counts add up to the text's: the tokenizer's own pre-tokens where the text is of ASCII and
    Latin letters, else what white space separates (for byte-level vocabularies the whole text where even that could matter)."""

    def __init__(self, vocab: str):
        told = json.loads(vocab)
        special = [t["content"] for t in told["added_tokens"]]
        self.by_word = bool(told["model"].get("end_of_word_suffix"))
        self.plain, self.apart = Plain(special), re.compile("|".join([WIDE_SPACE.pattern, *map(re.escape, special)]))

    def __call__(self, text: bytes) -> list[bytes]:
        if self.by_word:
            return WORD_SPLIT.findall(text.lower()) if self.plain(text) else text.split()
        if self.plain(text):
            return BYTE_SPLIT.findall(text)
        return [text] if self.apart.search(text.decode("utf-8", "replace")) else CHUNK.findall(text)


class Numbers(dict):
    """Numbers new keys from 0 in the order they are asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _pressed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.uint32).tobytes())


def _unpressed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint32)


def _blocks(docs: DataFrame, vocab) -> DataFrame:
    """One row a block: doc_ids, sizes in bytes, where each document's entries end, the entries (steps between the sorted numbers of a
    document, which are small, and frequencies), the pre-tokens by number."""

    def work(batches):
        cut = PreTokens(vocab.value)
        for batch in batches:
            for part in slices(batch, most=BLOCK):
                number, held = Numbers(), []
                texts = part.column(1)
                for text in texts:
                    found = np.fromiter(map(number.__getitem__, cut(text.as_py())), np.uint32)
                    held.append(np.unique(found, return_counts=True))
                ends = np.cumsum([len(n) for n, _ in held], dtype=np.uint32)
                steps = np.diff(np.concatenate([n for n, _ in held]), prepend=np.uint32(0))
                sizes = np.fromiter((len(t.as_buffer()) for t in texts), np.int64, len(held))
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), [sizes.tobytes()], [_pressed(ends)], [_pressed(steps)], [_pressed(np.concatenate([f for _, f in held]))], pa.array([list(number)], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], ["doc_ids", "sizes", "ends", "steps", "freqs", "pieces"])

    rows = map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], work, "doc_ids array<bigint>, sizes binary, ends binary, steps binary, freqs binary, pieces array<binary>")
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "token-blocks")


def _counted(pieces: DataFrame, vocab, most: int = 1 << 20) -> DataFrame:
    """pieces (block, number, piece), in order of pieces within partitions, to packed rows (of: a block, steps, counts): a piece is
    encoded once for all blocks that hold it, which follow each other."""

    def packed(blocks: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((numbers, blocks))
        blocks, numbers, counts = blocks[order], numbers[order], counts[order]
        used, starts = np.unique(blocks, return_index=True)
        ends = [*starts[1:], len(blocks)]
        rows = [(_pressed(np.diff(numbers[i:j], prepend=np.uint32(0))), _pressed(counts[i:j])) for i, j in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["of", "steps", "counts"])

    def work(batches):
        tokenizer = plain_tokenizer(vocab.value)
        last, n, held = None, 0, []
        for batch in batches:
            told = batch.column(2).dictionary_encode()
            each = []
            for piece in told.dictionary.to_pylist():
                if piece != last:
                    last, n = piece, len(tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False))
                each.append(n)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32), np.array(each, np.uint32)[told.indices.to_numpy()]))
            if sum(len(h[0]) for h in held) >= most:
                yield packed(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return map_rows(pieces.repartition("piece").sortWithinPartitions("piece"), ["block", "number", "piece"], work, "of long, steps binary, counts binary")


def _summed(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the sums of frequency times count."""
    block = blocks.to_pylist()[0]
    parts = [(np.cumsum(_unpressed(steps), dtype=np.uint32), _unpressed(n)) for steps, n in zip(counts.column("steps").to_pylist(), counts.column("counts").to_pylist())]
    n = np.zeros(sum(len(numbers) for numbers, _ in parts), np.int64)
    for numbers, of in parts:
        n[numbers] = of
    numbers = np.cumsum(_unpressed(block["steps"]), dtype=np.uint32)  # wraps where a document begins, as the steps do
    total = np.concatenate(([0], np.cumsum(n[numbers] * _unpressed(block["freqs"]))))
    each = np.diff(total[np.concatenate(([0], _unpressed(block["ends"])))])
    return pa.table([pa.array(block["doc_ids"], pa.int64()), pa.array(np.frombuffer(block["sizes"], np.int64)), pa.array(each, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8) and n_tokens of its whole text, as the tokenizers library counts them for the JSON file
    at vocab_path without added special tokens.

    A null or empty text has 0 of both. Rows are independent: repeated rows give repeated results, a null doc_id stays, an empty table
    gives an empty one, other columns are ignored. A very long text is a block of its own."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    blocks = _blocks(docs, vocab)
    counts = _counted(blocks.select("block", F.posexplode("pieces").alias("number", "piece")), vocab)
    return blocks.drop("pieces").groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")


def op13_token_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    return token_counts(docs, vocab_path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
