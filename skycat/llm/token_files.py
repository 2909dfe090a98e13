"""Token ids in seekable zstandard files.

One file per range of documents, one independent frame per document (so a reader
decompresses only the documents asked for), then a skippable frame with the document ids
and a trailing seek table in the public zstd seekable layout, with a checksum per frame.

Writers hold one document at a time; they name each file afresh and report it in their result rows; a lost or repeated task
leaves an unlisted file behind, never a wrong one.

Defined cases: null text stores the end id alone; null doc_id sorts first; rows with equal
doc_id stay separate, in an order fixed by a digest of their text; no rows give no files.
"""

from __future__ import annotations

import struct
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.llm.common import shared_folder, written

INDEX_MAGIC = 0x184D2A50  # skippable frame with document ids
TABLE_MAGIC = 0x184D2A5E  # skippable frame with the seek table
SEEKABLE_MAGIC = 0x8F92EAB1
END_ID = 2
FILE_BYTES = 32 << 20  # text of one file, about
NULL_ID = -(1 << 63)


class TokenWriter:
    """Writes frame after frame to an open file object; holds only 20 bytes a document until the end."""

    def __init__(self, handle, level: int = 3):
        import zstandard

        self.handle, self.compress = handle, zstandard.ZstdCompressor(level=level).compress
        self.doc_ids, self.entries = array("q"), array("I")

    def add(self, doc_id: int, payload: bytes) -> None:
        import xxhash

        frame = self.compress(payload)
        self.handle.write(frame)
        self.doc_ids.append(doc_id)
        self.entries.extend((len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))

    def finish(self) -> None:
        """The document index, then the seek table."""
        index = struct.pack(f"<{len(self.doc_ids)}q", *self.doc_ids)
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        self.entries.extend((len(index), 0, 0))
        table = struct.pack(f"<{len(self.entries)}I", *self.entries) + struct.pack("<IBI", len(self.entries) // 3, 0x80, SEEKABLE_MAGIC)
        self.handle.write(index + struct.pack("<II", TABLE_MAGIC, len(table)) + table)


def pack_file(doc_ids: list[int], payloads: list[bytes], level: int = 3) -> bytes:
    """The bytes of one file: frames, document index, seek table."""
    import io

    out = io.BytesIO()
    writer = TokenWriter(out, level)
    for doc_id, payload in zip(doc_ids, payloads):
        writer.add(doc_id, payload)
    writer.finish()
    return out.getvalue()


class TokenFile:
    """Random access to one open file object (seek and read)."""

    def __init__(self, handle):
        self.handle = handle
        end = handle.seek(0, 2)
        handle.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", handle.read(9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        handle.seek(end - 9 - 12 * n)
        raw = struct.unpack(f"<{3 * n}I", handle.read(12 * n))
        self.entries, at = [], 0
        for i in range(0, 3 * n, 3):
            self.entries.append((at, *raw[i : i + 3]))
            at += raw[i]
        at, size, *_ = self.entries.pop()
        handle.seek(at + 8)
        self.doc_ids = struct.unpack(f"<{(size - 8) // 8}q", handle.read(size - 8))

    def payload(self, i: int) -> bytes:
        import xxhash
        import zstandard

        at, size, length, check = self.entries[i]
        self.handle.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.handle.read(size), max_output_size=max(1, length))
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {i} does not match")
        return data


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest.

    Documents are encoded, compressed and written one at a time.  The number of files goes
    by the bytes of text; many rows of one doc_id are cut by a digest of their text.

    Manifest: file, part, first_id, n_docs, n_tokens, width; one row per file.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if files is None:
        size = wanted.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(size // FILE_BYTES, spark.sparkContext.defaultParallelism) + 1
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    ordered = wanted.withColumn("digest", F.xxhash64("text")).repartitionByRange(int(files), *order).sortWithinPartitions(*order, "text")

    def run(batches):
        import uuid

        from pyspark import TaskContext

        from skycat.llm.word_tokens import word_tokens

        words, writer, out, n = word_tokens(tokenizer), None, None, 0
        end, part = int(end_id).to_bytes(words.width, "little"), TaskContext.get().partitionId()
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                if writer is None:
                    out = _open(name, "w")
                    writer = TokenWriter(out)
                raw = words.ids(text) + end
                writer.add(NULL_ID if pd.isna(doc_id) else int(doc_id), raw)
                n += len(raw) // words.width
            words.trim()
        if writer is not None:
            writer.finish()
            out.close()
            yield pd.DataFrame([(name, part, writer.doc_ids[0], len(writer.doc_ids), n, words.width)], columns=["file", "part", "first_id", "n_docs", "n_tokens", "width"])

    return written(ordered.mapInPandas(run, "file string, part long, first_id long, n_docs long, n_tokens long, width long"), "token-manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids binary little-endian of `width` bytes, width, n_tokens), decompressing only what is wanted."""
    # one row per file: this window is as small as the list of files
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = manifest.withColumn("before", before).repartition(files, "file")
    chosen = None if wanted is None else frozenset(wanted)

    def run(batches):
        for pdf in batches:
            for name, start, width in zip(pdf.file, pdf.before, pdf.width):
                rows = []
                with _open(name, "r") as handle:
                    tokens = TokenFile(handle)
                    for i, doc_id in enumerate(tokens.doc_ids):
                        n = tokens.entries[i][2] // width
                        if chosen is None or doc_id in chosen:
                            rows.append((None if doc_id == NULL_ID else doc_id, start, tokens.payload(i), width, n))
                        start += n
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return listed.select("file", "before", "width").mapInPandas(run, "doc_id long, start long, ids binary, width long, n_tokens long")


def _frame(rows):
    out = pd.DataFrame(rows, columns=["doc_id", "start", "ids", "width", "n_tokens"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 of the ids as little-endian uint32)."""

    def run(batches):
        import zlib

        import numpy as np

        for pdf in batches:
            crc = [zlib.crc32(np.frombuffer(b, f"<u{w}").astype("<u4").tobytes()) for b, w in zip(pdf.ids, pdf.width)]
            yield pdf[["doc_id", "start", "n_tokens"]].assign(ids_crc32=crc)

    return read.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
