"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Every byte sequence of the rank file becomes one piece: each byte is shown as a fixed
letter, and the score is the negative rank, so sentencepiece's best-score-first merging is
the lowest-rank-first merging of byte BPE.  The model names identity normalisation and
neither adds a prefix nor escapes white space.  Piece order is rank order, so piece ids are
ranks; decoding is the inverse mapping.

Defined cases: null and empty text give no ids; any Unicode text round-trips; rows keep
their count and order within a partition; extra columns are kept unless named like the result.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycat.llm.common import quoted

from skycat.llm.word_tokens import _Cache

#: Entries of each of a worker's two caches before they are emptied, and rows turned into Python objects at once.
CACHE_ENTRIES = 200_000
BATCH_ROWS = 500
#: The letter that stands for byte 0; byte b is shown as the b-th letter after it (CJK, free of white space).
FIRST_LETTER = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """Byte sequences by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    return [ranks[r] for r in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTER)


_LETTER = {b: chr(FIRST_LETTER + b) for b in range(256)}


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """A serialised model in the public sentencepiece_model.proto layout."""
    pieces = [_field(1, _field(1, letters(t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(vocabulary)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary))  # model_type BPE, vocab_size, unk_id
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file, for one worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = vocabulary(path)
        self.rank = {t: r for r, t in enumerate(self.vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.vocabulary))
        self.split = regex.compile(pattern).findall
        self.uneven = regex.compile(r"[\s\x1c-\x1f][\s\x1c-\x1f]|[^\S \n]|[\x00\x1c-\x1f]|^\s|\s$").search
        self.tokens = _Cache(self._token)
        self.chunks = _Cache(self._chunk)

    def _token(self, token: str) -> bytes:
        from array import array

        data = token.encode("utf-8")
        whole = self.rank.get(data)
        ids = [whole] if whole is not None else self.model.encode(letters(data))
        return array("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.tokens[t] for t in self.split(chunk)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32 bytes.

        No match of the pattern starts at a non-space and reaches over a single blank or
        line feed, so texts without longer white-space runs are encoded chunk by chunk.
        """
        if not text:
            return b""
        if self.uneven(text):
            return b"".join([self.tokens[t] for t in self.split(text)])
        cut = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return b"".join(map(self.chunks.__getitem__, cut))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def trim(self) -> None:
        for cache in (self.tokens, self.chunks):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()


_OPEN: dict[tuple[str, str], ByteBpe] = {}
_VOCABULARIES: dict[str, list[bytes]] = {}


def vocabulary(path: str) -> list[bytes]:
    """The rank file, read once per worker; decoding needs no model."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = read_ranks(path)
    return _VOCABULARIES[path]


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS):
    """The batch in parts, so that only one part's values are held as Python objects."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def _plain(kept, out, kind):
    """Names without dots for these fields, and the schema with them and one more column."""
    plain = [f"c{i}" for i in range(len(kept))]
    return plain, T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, kept)), T.StructField(out, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``out`` array<int>, the ids of each whole text, in place of the text; other columns stay."""
    kept = [f for f in docs.schema.fields if f.name not in (out, text)]
    # Arrow functions look columns up by name, where a dot would mean a field
    plain, schema = _plain(kept, "ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        import numpy as np

        bpe = byte_bpe(path, pattern)
        for batch in (part for whole in batches for part in slices(whole)):
            raw = [bpe.encode(t) for t in batch.column("_text").to_pylist()]
            bpe.trim()
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), ids], names=schema.names)

    return docs.select(*(F.col(quoted(f.name)).alias(c) for f, c in zip(kept, plain)), F.col(text).alias("_text")).mapInArrow(run, schema).toDF(*(f.name for f in kept), out)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` binary, the bytes that the ids stand for; null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != out]
    plain, schema = _plain(kept, "decoded", T.BinaryType())
    source = plain[[f.name for f in kept].index(ids)]

    def run(batches):
        pieces = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole)):
            lists = batch.column(source)
            data = [b"".join(map(pieces.__getitem__, lists[i].values.to_numpy(zero_copy_only=False).tolist())) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(data, pa.binary())], names=schema.names)

    return encoded.select(*(F.col(quoted(f.name)).alias(c) for f, c in zip(kept, plain))).mapInArrow(run, schema).toDF(*(f.name for f in kept), out)


def digests(decoded: DataFrame, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        from hashlib import sha256

        import numpy as np

        for batch in (part for whole in batches for part in slices(whole)):
            lists = batch.column(ids)
            arrays = [np.asarray(lists[i].values.to_numpy(zero_copy_only=False), "<u4") if lists[i].is_valid else np.empty(0, "<u4") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64()), pa.array([sha256(a.tobytes()).hexdigest() for a in arrays]), pa.array([sha256(b or b"").hexdigest() for b in batch.column(data).to_pylist()])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return decoded.select("doc_id", ids, data).mapInArrow(run, schema)
