"""Operator 1: byte-level BPE encoding and decoding through a sentencepiece model.

The rank vocabulary is written directly as a sentencepiece BPE model: each byte sequence becomes a
piece of one character per byte, its score is the negative rank, and normalisation is the identity.
Merging the best-scored adjacent pair, leftmost first, is then merging by rank. Pre-tokens are encoded
one by one; a pre-token that is itself in the vocabulary is its own id. Decoding maps ids back to pieces
and their characters back to bytes.

Null and empty texts have no ids. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.chunks import ChunkCache
from pricelens.llm.common import map_batches, text_list

#: Byte b is written as the character FIRST + b: letters that no normaliser or white-space rule touches.
FIRST = 0x100
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64(bytes) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def to_piece(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8) + np.uint16(FIRST)).tobytes().decode("utf-16-le")


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protocol-buffer field: varint, length-delimited or 32-bit float by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece model; piece i + 1 is the i-th lowest rank."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)]
    pieces += [_field(1, to_piece(token).encode()) + _field(2, float(-rank)) + _field(3, _NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, _BPE) + _field(4, len(pieces)) + _field(40, 0)
    no_id = (1 << 64) - 1  # -1: the model has no begin, end or padding piece
    trainer += b"".join(_field(n, no_id) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.rank_of_piece = np.array([0, *sorted(self.ranks.values())], "<u4")
        self.bytes_of_rank = {int(self.rank_of_piece[i]): to_bytes(self.model.IdToPiece(i)) for i in range(1, self.model.GetPieceSize())}
        self.split = regex.compile(pattern).findall
        self.cache = ChunkCache(self._encode_units)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        tokens = [[u] if u[:1] == " " and u[1:].isalpha() else self.split(u) for u in units]
        distinct = {t for found in tokens for t in found}
        known: dict[str, bytes] = {}
        rest = []
        for token in distinct:
            rank = self.ranks.get(token.encode())
            if rank is None:
                rest.append(token)
            else:
                known[token] = struct.pack("<I", rank)
        encoded = self.model.EncodeAsIds([to_piece(t.encode()) for t in rest], num_threads=1) if rest else []
        flat = self.rank_of_piece[np.fromiter(chain.from_iterable(encoded), np.int64)].tobytes()
        ends = list(accumulate(4 * len(e) for e in encoded))
        known.update((t, flat[a:b]) for t, a, b in zip(rest, [0, *ends], ends))
        return [known[t[0]] if len(t) == 1 else b"".join(map(known.__getitem__, t)) for t in tokens]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        return self.cache.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of_rank.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str) -> ByteBpe:
    """One codec per worker process, kept from task to task."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``with_ids`` the ids and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            ids = codec.encode(text_list(batch))
            decoded = [codec.decode(i) for i in ids]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([i.astype("i4") for i in ids], pa.list_(pa.int32()))
                columns["decoded"] = pa.array(decoded, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
