"""Tokenizing by distinct chunks of white space plus word.

The pre-tokenizer patterns used here never let a match run from a non-space into white space, nor from
a letter into ASCII punctuation other than the apostrophe. So a text may be cut in front of every run of
white space, and a chunk may be cut once more between its word and such punctuation; each unit is
tokenized alone. A batch of texts is split and its distinct chunks are found by Arrow; a chunk seen before
costs one dictionary lookup per batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_CHUNK, _WORD = regex.compile(r"\s*\S+|\s+"), regex.compile(r"\S+")
#: White space other than single spaces and newlines between words.
_IRREGULAR = r"[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n"
#: ASCII punctuation but the apostrophe, which may begin a contraction.
_TAIL = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Characters of texts that are split together.
_GROUP = 1 << 23


def are_regular(texts: list[str]) -> list[bool]:
    """Whether white space is single spaces and newlines only, so that splitting at these gives the chunks."""
    return pc.invert(pc.match_substring_regex(pa.array(texts, pa.string()), _IRREGULAR)).to_numpy(zero_copy_only=False).tolist()


def split_keys(texts: list[str]) -> pa.ListArray:
    """One key per chunk: the word alone after a single space, else the chunk itself behind a carriage return or newline."""
    plain = pa.array(["\r" + t for t in texts], pa.string())
    return pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")


def split_words(texts: list[str]) -> pa.ListArray:
    """The words of regular texts, empty ones included."""
    return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")


def is_letters(word: str) -> bool:
    """Whether a word is letters only, in lower case and composed too: some letters become a letter and a mark, which joins the punctuation behind it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha())


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == "\r" else key if key[:1] == "\n" else " " + key


class ChunkCache:
    """Values of chunks (bytes or numbers, joined by +), computed once per distinct unit and worker while they are in use.

    ``compute`` maps a list of distinct units, the empty one included, to their values. The store has two
    generations of ``limit`` entries: when the young one is full the old one is dropped, so memory is bounded
    and frequent chunks stay. Results do not depend on it. ``spaceless`` says that values do not depend on white space
    in front of a word, so that words share one entry wherever they stand.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 300_000, spaceless: bool = False):
        self.compute, self.limit, self.spaceless = compute, limit, spaceless
        # without meaning of white space, a key is the word alone
        self.start, self.chunk = ("", str) if spaceless else ("\r", chunk_of)
        self.young: dict = {}
        self.old: dict = {}

    def _known(self, keys: list[str]) -> list:
        """Values of keys, None where unknown; what the old generation knows moves to the young one."""
        values = list(map(self.young.get, keys))
        for i, value in enumerate(values):
            if value is None and (older := self.old.get(keys[i])) is not None:
                values[i] = self.young[keys[i]] = older
        return values

    def _learn(self, missing: list[str]) -> None:
        young = self.young
        words = [k.rstrip(_TAIL) for k in missing]
        # (key, word, tail) where the chunk is letters and punctuation; other chunks are units
        cut = [len(w) < len(k) and is_letters(w) for k, w in zip(missing, words, strict=True)]
        pairs = [(k, w, self.start + k[len(w):]) for k, w, c in zip(missing, words, cut, strict=True) if c]
        parts = list({u for _, w, t in pairs for u in (w, t)})
        new = {u for u, v in zip(parts, self._known(parts), strict=True) if v is None}
        new.update(k for k, c in zip(missing, cut, strict=True) if not c)
        new = list(new)
        young.update(zip(new, self.compute(list(map(self.chunk, new))), strict=True))
        for key, word, tail in pairs:
            young[key] = young[word] + young[tail]

    def _values(self, keys: pa.StringArray) -> tuple[list, np.ndarray]:
        """Values of the distinct keys, and for every key the number of its value."""
        coded = keys.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        values = self._known(distinct)
        missing = [k for k, v in zip(distinct, values, strict=True) if v is None]
        if missing:
            self._learn(missing)
            values = list(map(self.young.__getitem__, distinct))
        return values, coded.indices.to_numpy()

    def _groups(self, texts: list[str]) -> Iterator[tuple[list[int], list, np.ndarray, np.ndarray]]:
        """Numbers of some texts, values of their distinct chunks, number of each chunk's value, chunks per text."""
        kinds = are_regular(texts)
        for regular in (True, False):
            numbers, held = [], 0
            chosen = [i for i, kind in enumerate(kinds) if kind == regular]
            for i in [*chosen, -1]:
                if numbers and (i < 0 or held > _GROUP):
                    if regular:
                        lists = (split_words if self.spaceless else split_keys)([texts[n] for n in numbers])
                        keys, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
                    else:
                        cut = [_WORD.findall(texts[n]) if self.spaceless else ["\r" + c for c in _CHUNK.findall(texts[n])] for n in numbers]
                        keys, counts = pa.array([k for c in cut for k in c], pa.string()), np.array([len(c) for c in cut])
                    yield numbers, *self._values(keys), counts
                    numbers, held = [], 0
                numbers.append(i)
                held += len(texts[i]) if i >= 0 else 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, where values are little-endian unsigned 32-bit ids."""
        out: list = [None] * len(texts)
        for numbers, values, which, chunks in self._groups(texts):
            flat = np.frombuffer(b"".join(values), "<u4")
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            starts = np.cumsum(sizes) - sizes
            size = sizes[which]
            ends = np.cumsum(size)
            ids = flat[np.repeat(starts[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(chunks)])]
            for n, a, b in zip(numbers, bounds[:-1].tolist(), bounds[1:].tolist()):
                out[n] = ids[a:b]
        return out

    def sums(self, texts: list[str]) -> list[int]:
        """Sum over each text's chunks, where values are numbers."""
        out = [0] * len(texts)
        for numbers, values, which, chunks in self._groups(texts):
            total = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[which])])
            bounds = total[np.concatenate([[0], np.cumsum(chunks)])]
            for n, value in zip(numbers, np.diff(bounds).tolist()):
                out[n] = value
        return out
