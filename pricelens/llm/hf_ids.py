"""Ids of a tokenizers file, chunk by chunk."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from pricelens.llm.chunks import ChunkCache

#: Capitals that compose with nothing: what follows them is ASCII or the end.
_PLAIN_CAPITALS = re.compile(r"[A-Z]+(?=[\x00-\x7f]|\Z)")
#: Units that the library encodes in one call.
UNITS = 4096


class FileTokenizer:
    """Whole texts to unsigned 32-bit ids, as the tokenizers library gives them without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Lowercase

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        normalizer = self.tokenizer.normalizer
        # a vocabulary that lower-cases gives equal ids to lower-cased text, so fewer distinct chunks
        self.lowers = normalizer is not None and any(isinstance(n, Lowercase) for n in (normalizer if hasattr(normalizer, "__len__") else [normalizer]))
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a pre-tokenizer that throws white space away gives a word equal ids wherever it stands
        probe = [self.tokenizer.encode(f"{a}b{c}", add_special_tokens=False).ids for a in ("", " ", "\n", " \n\t ", "\x85", "\u3000") for c in ("", " ", "\n")]
        blank = [self.tokenizer.encode(a, add_special_tokens=False).ids for a in (" ", "\n", " \n\t ", "\x85", "\u3000")]
        self.cache = ChunkCache(self._encode_units, spaceless=all(p == probe[0] for p in probe) and not any(blank))

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _encode_units(self, units: list[str]) -> list[bytes]:
        # the library's results are some hundred bytes a unit beside the ids, so few are held at a time
        blocks = (units[a : a + UNITS] for a in range(0, len(units), UNITS))
        return [array("I", e.ids).tobytes() for block in blocks for e in self.tokenizer.encode_batch_fast(block, add_special_tokens=False)]

    def _fold(self, text: str) -> str:
        """ASCII capitals in lower case where that changes no id: not before what they may compose with, nor where a special string could arise."""
        lower = text.lower()
        if any(s in lower for s in self.special):
            return text
        return lower if text.isascii() else _PLAIN_CAPITALS.sub(lambda m: m[0].lower(), text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.lowers:
            texts = list(map(self._fold, texts))
        return self.cache.ids(texts)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> FileTokenizer:
    """One tokenizer per worker process, kept from task to task."""
    return FileTokenizer(path)
