"""Media columns: Netpbm and BMP to numpy, integral-image resize, NPY tiles, difference hash.

Defined cases: null bytes decode to null results; a broken header, samples that are missing
or too large, and images of no width or height raise an error in ``decode_image`` and give
null features in ``media_features``; 16-bit samples are scaled to 8 bits for the tile; equal
bytes give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 64


def decode_netpbm(data: bytes):
    """P1 to P6; samples as stored, in 8 or 16 bits; bitmaps give 0 for a one (black) and 255 for a zero."""
    import numpy as np

    kind, fields, at = data[:2], [], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image of a kind from P1 to P6")
    bitmap, plain, bands = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3"), 3 if kind in (b"P3", b"P6") else 1
    while len(fields) < (2 if bitmap else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("the header ends early")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = *fields[:2], 1 if bitmap else fields[2]
    if not 0 < top < 65536 or not width * height:
        raise ValueError("an image without samples, or with an impossible largest sample")
    n, stored = width * height * bands, np.dtype(np.uint8 if top < 256 else ">u2")
    shape = (height, width, bands)[: 2 + (bands > 1)]
    if plain:
        body = b"\n".join(line.partition(b"#")[0] for line in data[at:].split(b"\n"))
        found = [c - 48 for c in body if not bytes([c]).isspace()][:n] if bitmap else [int(v) for v in body.split()[:n]]
        if len(found) < n or min(found) < 0 or max(found) > top:
            raise ValueError("too few samples, or one beyond the largest")
        flat = np.array(found, stored.newbyteorder("="))
    elif bitmap:
        stride = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, stored, n, at + 1)
    return ((1 - flat) * 255 if bitmap else flat).reshape(shape)


def decode_bmp(data: bytes):
    """Uncompressed 8-bit (through its palette) and 24-bit bitmaps."""
    import numpy as np

    start, header, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (8, 24) or packed:
        raise ValueError("no plain 8- or 24-bit BMP")
    if width <= 0 or not height:
        raise ValueError("an image without samples")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    if rows.max() >= len(palette):
        raise ValueError("a sample beyond the palette")
    image = palette[rows]
    return image[:, :, 0] if (palette[:, :1] == palette).all() else image


def decode_image(data: bytes):
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def area_resize(image, height: int, width: int):
    """Mean over each target cell, with fractional borders, from one integral image."""
    import numpy as np

    gray = image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64).mean(axis=2)
    integral = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    integral[1:, 1:] = gray.cumsum(0).cumsum(1)

    def at(edges, axis, table):
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        share = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return table.take(low, axis) * (1 - share) + table.take(low + 1, axis) * share

    y, x = np.linspace(0, gray.shape[0], height + 1), np.linspace(0, gray.shape[1], width + 1)
    sums = np.diff(np.diff(at(x, 1, at(y, 0, integral)), axis=0), axis=1)
    return sums / (np.diff(y)[:, None] * np.diff(x)[None, :])


def difference_hash(image) -> str:
    """64 bits: whether each of 9 x 8 cells is darker than its right neighbour, as hex."""
    import numpy as np

    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image, side: int = 16) -> bytes:
    """A side x side tile as the bytes of an NPY file."""
    import numpy as np

    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_media(docs: DataFrame, row: int = SIDE) -> DataFrame:
    """(doc_id, n_bytes, media): UTF-8 of each text, filled to whole rows of 64 samples, as a PGM."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            n, media = [], []
            for text in pdf.text:
                raw = (text or "").encode("utf-8", "surrogatepass")
                filled = raw + bytes(row * max(1, -(-len(raw) // row)) - len(raw))
                n.append(len(raw))
                media.append(encode_pgm(np.frombuffer(filled, np.uint8).reshape(-1, row)))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_bytes": n, "media": media})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Decode ``media`` and add payload figures, the difference hash and the NPY tile."""

    def run(batches):
        import zlib
        from hashlib import sha256

        for pdf in batches:
            rows = []
            for doc_id, n, media in zip(pdf.doc_id, pdf.n_bytes, pdf.media):
                try:
                    image = decode_image(media)
                except (ValueError, IndexError, TypeError, OverflowError, struct.error):
                    rows.append((doc_id, n, None, None, None, None if media is None else len(media), None if media is None else sha256(media).hexdigest(), None, None))
                    continue
                payload, tile = image.tobytes(), image if image.dtype.itemsize == 1 else image / 257
                rows.append((doc_id, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), difference_hash(image), npy_tile(tile)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])
            for c in ("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes"):
                out[c] = out[c].astype("Int64")
            yield out

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
