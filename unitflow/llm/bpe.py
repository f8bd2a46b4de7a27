"""BPE encoding and decoding by dynamic programming over prefixes, with exact ids.

The ids that merging gives a prefix are those of a shorter prefix and one last token, and that last token is
unique. An automaton over the vocabulary lists the tokens that end at each position; of these the one is taken
that goes with the last token of the prefix before it, that is, where no merge would have crossed the boundary.
Back-pointers over the last tokens then give the ids.
"""

from __future__ import annotations

import hashlib
import json
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import Memo, map_rows, text_bytes
from unitflow.llm.tokens import ByteEncoder, byte_symbols, vocabulary

#: Fixed: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class PrefixBPE:
    def __init__(self, vocab: str):
        import ahocorasick
        import regex

        model = json.loads(vocab)
        ids, merges = model["model"]["vocab"], model["model"]["merges"]
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(map(to_byte.__getitem__, token))
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pair = ids[left], ids[right]
            self.rank.setdefault(pair, rank)
            self.halves.setdefault(ids[left + right], (*pair, rank))
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if self.is_own(i):
                data = self.bytes_of[i]
                self.automaton.add_word(data.decode("latin-1"), (i, len(data)))
        self.automaton.make_automaton()
        # a byte that is no token has no id: the library drops it, and what stands beside it can be merged
        self.lost = bytes(b for b in range(256) if byte_symbols()[b] not in ids)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = Memo(self.word, 50_000)
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def _spine(self, token: int, side: int, memo: dict[int, list]) -> list[tuple[int, float]]:
        """From the outermost byte of a token up to the token: each part, and the rank at which it is merged into the next."""
        if token not in memo:
            if token in self.halves:
                *pair, rank = self.halves[token]
                below = self._spine(pair[side], side, memo)
                memo[token] = [*below[:-1], (below[-1][0], rank), (token, inf)]
            else:
                memo[token] = [(token, inf)]
        return memo[token]

    def crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The first merge across the boundary between two tokens while each is merged from its bytes, if there is one.

        Ranks rise towards the whole token, so the parts next to the boundary change in order of rank. A merge
        across it happens if its rank comes before the next change on either side; at the same rank the leftmost goes first."""
        a, b = self._spine(left, 1, self._right), self._spine(right, 0, self._left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                return x, y
            if x_ends <= y_ends:
                if x_ends == inf:
                    return None
                i += 1
            else:
                j += 1

    def is_own(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if token not in self.halves:
            return len(self.bytes_of[token]) == 1
        left, right, _ = self.halves[token]
        return self.is_own(left) and self.is_own(right) and self.crossing(left, right) == (left, right)

    def word(self, data: bytes) -> list[int]:
        data = data.translate(None, self.lost)
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        fits = self.fits
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if start:
                pair = last[start], token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= 500_000:
                        fits.clear()
                    ok = fits[pair] = self.crossing(*pair) is None
                if not ok:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.apart.finditer(text) if self.special else ():
            out += [i for w in self.split.findall(text[at : m.start()]) for i in self.words[w.encode()]]
            out.append(self.special[m[0]])
            at = m.end()
        for w in self.split.findall(text[at:] if at else text):
            out += self.words[w.encode()]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict = {}


def coder(vocab: str) -> tuple[PrefixBPE, ByteEncoder]:
    if hash(vocab) not in _coders:
        bpe = PrefixBPE(vocab)
        _coders[hash(vocab)] = bpe, ByteEncoder(bpe.word, bpe.encode, list(bpe.special))
    return _coders[hash(vocab)]


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per row of docs: doc_id, ids (packed little-endian unsigned 32-bit integers) and decoded text, as bytes.

    A null or empty text has no ids. Rows are independent: repeated rows give repeated results, a null doc_id
    stays, an empty table gives an empty table, other columns are ignored."""
    return _coded(docs, vocab_path, "doc_id long, ids binary, decoded binary", lambda doc_id, ids, text: (doc_id, ids, text))


def _coded(docs: DataFrame, vocab_path: str, schema: str, row) -> DataFrame:
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*((n, kinds[k]) for n, k in map(str.split, schema.split(","))))

    def work(batches):
        bpe, encode = coder(vocab.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = encode(text.as_py())
                    rows.append(row(doc_id, ids, bpe.decode(np.frombuffer(ids, "<u4").tolist()).encode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

    return map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], work, schema)


def op6_bpe(docs: DataFrame, vocab_path: str) -> DataFrame:
    digest = lambda doc_id, ids, text: (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
    return _coded(docs, vocab_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
