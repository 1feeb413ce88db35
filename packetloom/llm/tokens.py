"""Token ids of whole texts through a public tokenizer file, fast enough for a whole corpus.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its white-space words
one after another. It also never joins letters, digits and other characters. Pieces (or, in texts with unusual characters,
words) are looked up in a table that each Python worker keeps (two generations of at most ``MEMO`` entries; the older one
goes when the younger is full); only unknown ones reach the library. Most unknown words are letters between ASCII punctuation; their
letters go to the library's BPE model directly, everything else through its full encoding.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MEMO = 150_000
BATCH_CHARS = 8_000_000
# In a lower-cased text: what the fast way does not know, and the pieces that the tokenizer cuts everything else into.
_UNKNOWN = re.compile(r"[^\t-\r\x20-\x26\x28-\x7eß-öø-ňŋ-ɏ]")
_PIECES = re.compile(r"[a-zß-öø-ňŋ-ɏ]+|[0-9]|[^\sa-z0-9ß-öø-ňŋ-ɏ]+")
# Python's split() also cuts at these four, which the tokenizer keeps.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Lower-case letters that neither normalise nor change case further, between plain punctuation.
_PLAIN = re.compile(r"([^\w\s'’<>|]*)([a-zß-öø-ňŋ-ɏ]+)([^\w\s'’<>|]*)", re.ASCII)
_PUNCTUATION = frozenset("!\"#$%&()*+,-./:;=?@[\\]^`{}~")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed rule of that format)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """key -> value by ``make``; frequent keys survive when a generation is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words:
    """word -> its ids as little-endian uint16 bytes."""

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.as_bytes = _byte_letters()
        self.pieces, self.letters, self.words = (_Memo(make, memo) for make in (self._piece, self._letters, self._word))

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._letters(piece) if piece[0].isalpha() else self.encode(piece)

    def _letters(self, letters: str) -> bytes:
        plain = letters if letters.isascii() else "".join(map(self.as_bytes.__getitem__, letters.encode()))
        return array("H", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()

    def _word(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word.lower()) if len(word) < 100 else None
        if m and _PUNCTUATION.issuperset(m[1]) and _PUNCTUATION.issuperset(m[3]):
            return (self.words[m[1]] if m[1] else b"") + self.letters[m[2]] + (self.words[m[3]] if m[3] else b"")
        return self.encode(word)


def _kept() -> dict:
    """What a Python worker keeps from task to task; functions travel by value, so module globals do not stay."""
    name = "packetloom_worker_tables"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    return module.__dict__.setdefault("tables", {})


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, memo: int = MEMO):
    """text -> uint16 ids without the end id; one word table per worker and path."""
    kept = _kept()
    if (path, memo) not in kept:
        kept.clear()
        kept[path, memo] = _Words(path, memo)
    table = kept[path, memo]

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u2")
        lower = text.lower()
        if "<|" not in text and not _UNKNOWN.search(lower):
            return np.frombuffer(b"".join(map(table.pieces.__getitem__, _PIECES.findall(lower))), "<u2")
        if _SEPARATORS.search(text):
            return np.frombuffer(table.encode(text), "<u2")
        return np.frombuffer(b"".join(map(table.words.__getitem__, text.split())), "<u2")

    return ids


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def batch_encoder(path: str, memo: int = MEMO, chars: int = BATCH_CHARS):
    """texts -> their uint16 ids, like :func:`encoder` for many texts at once.

    The white-space words of about ``chars`` characters are cut and numbered by Arrow; each different word is looked up once, piece by
    piece, and the ids are laid out by numbers.
    """
    single = encoder(path, memo)
    pieces = _kept()[path, memo].pieces

    def together(lowers: list[str]) -> list[np.ndarray]:
        cut = pc.ascii_split_whitespace(pa.array(lowers, pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        words = [b"".join(map(pieces.__getitem__, _PIECES.findall(w))) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) >> 1
        ids = np.frombuffer(b"".join(words), "<u2")
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[at]
        every = ids[_ranges((np.cumsum(sizes) - sizes)[at], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = upto[np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]
        return np.split(every, ends[:-1])

    def encode(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        texts = list(texts)
        at = 0
        while at < len(texts):
            own, lowers, size = [], [], 0
            while at < len(texts) and (size < chars or not own):
                text = texts[at] or ""
                lower = text.lower()
                plain = text and "<|" not in text and not _UNKNOWN.search(lower)
                own.append(None if plain else single(text))
                if plain:
                    lowers.append(lower)
                size += len(text)
                at += 1
            found = iter(together(lowers) if lowers else ())
            yield from (next(found) if ids is None else ids for ids in own)

    return encode


def with_end(ids: np.ndarray, end_id: int = END_ID) -> np.ndarray:
    return np.append(ids, np.uint16(end_id))
