"""Token ids of the two vocabularies, as packed little-endian unsigned 32-bit integers.

Texts are cut where the tokenizers never merge across, and the ids of each chunk are kept in a bounded memo:
what a chunk's ids are is always asked of the encoder itself.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from unitflow.llm.common import Memo

#: White space beyond ASCII by the Unicode property: chunks that hold any can depend on their neighbours.
WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word with one space before it; all but the last of a run of white space; one white-space character.
CHUNK = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")


#: Text of ASCII and Latin letters. The dotted capital I is no such letter: its lower case has a combining mark.
LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
#: Fixed: how the two tokenizers split such a text before merging (the word tokenizer's is lower-cased by then).
BYTE_SPLIT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^ \t-\rA-Za-z\x80-\xff0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
WORD_SPLIT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^ \t-\ra-z\x80-\xff0-9]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


SYMBOLS = dict(enumerate(byte_symbols()))


def symbols(data: bytes) -> str:
    return data.decode("latin-1").translate(SYMBOLS)


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def plain_tokenizer(vocab: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocab)
    t.no_truncation()
    t.no_padding()
    return t


class Plain:
    """Whether a text is of ASCII and Latin letters, without a special token's string: then words are split by a pattern on bytes."""

    def __init__(self, special: list[str]):
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in special) or b"(?!)")

    def __call__(self, text: bytes) -> bool:
        return bool(text.isascii() or LATIN.fullmatch(text.decode("utf-8", "replace"))) and not self.special.search(text)


class WordEncoder:
    """For a tokenizer that lower-cases, drops white space and never merges across it. Other texts than plain ones are
    encoded by what white space separates."""

    def __init__(self, vocab: str):
        tokenizer = plain_tokenizer(vocab)
        model, self.plain = tokenizer.model, Plain([t.content for t in tokenizer.get_added_tokens_decoder().values()])
        self.words = Memo(lambda word: packed([t.id for t in model.tokenize(symbols(word.decode().lower().encode()))]), 200_000)
        self.chunks = Memo(lambda chunk: packed(tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids), 50_000)

    def __call__(self, text: bytes) -> bytes:
        if self.plain(text):
            return b"".join(map(self.words.__getitem__, WORD_SPLIT.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.split()))


class ByteEncoder:
    """For a byte-level tokenizer whose words take one space before them. word gives the ids of one split word, whole those
    of any text; other texts than plain ones are encoded by chunks, and as they are if a chunk depends on its neighbours."""

    def __init__(self, word: Callable[[bytes], list[int]], whole: Callable[[str], list[int]], special: list[str]):
        self.whole, self.plain = whole, Plain(special)
        apart = re.compile("|".join([WIDE_SPACE.pattern, *map(re.escape, special)]))

        def ids(chunk: bytes) -> bytes | None:
            text = chunk.decode("utf-8", "replace")
            return None if apart.search(text) else packed(whole(text))

        self.words, self.chunks = Memo(lambda w: packed(word(w)), 200_000), Memo(ids, 50_000)

    def __call__(self, text: bytes) -> bytes:
        if self.plain(text):
            return b"".join(map(self.words.__getitem__, BYTE_SPLIT.findall(text)))
        try:
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        except TypeError:  # a chunk without ids of its own
            return packed(self.whole(text.decode("utf-8", "replace")))


_encoders: dict = {}


def library_encoder(kind: str, vocab: str):
    """One encoder per Python worker and vocabulary; kind is word or byte."""
    key = (kind, hash(vocab))
    if key not in _encoders:
        if kind == "word":
            _encoders[key] = WordEncoder(vocab)
        else:
            tokenizer = plain_tokenizer(vocab)
            special, model = [t.content for t in tokenizer.get_added_tokens_decoder().values()], tokenizer.model
            word = lambda part: [t.id for t in model.tokenize(symbols(part))]
            _encoders[key] = ByteEncoder(word, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, special)
    return _encoders[key]
