"""Media columns: Netpbm and BMP images, area-resized tiles and difference hashes.

Images are decoded to numpy arrays (height x width x channels, 8 bits). Resizing
averages exact areas through an integral image, so its cost doesn't depend on
the scale. A tile is the resized image as NPY bytes; the difference hash
compares neighbouring cells of a 9 x 8 grey tile (64 bits, hexadecimal).

Any bytes can be carried by an image without loss: ``to_ppm`` makes them the
samples of an RGB image 64 pixels wide and ``from_ppm`` reads them back. Stored
texts are such images; reading back also takes them through BMP and says whether
both forms hold the same samples.

One pass, no shuffle; memory is that of a batch and a few times one image's bytes.

Nulls, ties, repeats: a null text is empty (one row of blanks). A null, damaged
or unknown image has null width, height, channels, tile and hash and keeps its row.
Equal bytes give equal values. Rows come back one for one with their id as it is
(null, repeated). Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._tables import small_batches, widened

ROW = 192  # bytes in a row of 64 RGB pixels
TILE = 16
#: Image rows that are summed at once.
STRIP = 4096


def _fields(raw: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers of a Netpbm header and where the samples begin."""
    out, at = [], 2
    while len(out) < n:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if not 0 < end - at < 10:
            raise ValueError("a number of the header is missing or too large")
        out.append(int(raw[at:end]))
        at = end
    if 0 in out:
        raise ValueError("a number of the header is 0")
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as 8-bit samples; bitmaps are 0 (black) and 255, other depths are scaled to 255.

    Sizes are held against the bytes that are there before anything is made of
    them; samples above the maximum, and a maximum above 65,535, are damage.
    """
    kind = int(raw[1:2])
    bitmap, plain, channels = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    header, at = _fields(raw, 2 if bitmap else 3)
    w, h, most = header[0], header[1], 1 if bitmap else header[2]
    count = w * h * channels
    least = count if plain else (w + 7) // 8 * h if bitmap else count * (2 if most > 255 else 1)
    if most > 65_535 or least > len(raw) - at:
        raise ValueError("fewer samples than the header says, or too high a maximum")
    if plain:
        lines = b"\n".join(x.split(b"#")[0] for x in raw[at - 1 :].split(b"\n"))
        digits = [*b"".join(lines.split())] if bitmap else None
        told = [d - 48 for d in digits[:count]] if bitmap else [int(x) if x.isdigit() and len(x) < 6 else -1 for x in lines.split()[:count]]
        values = np.array(told, np.int64)
    elif bitmap:
        stride = (w + 7) // 8
        values = np.unpackbits(np.frombuffer(raw, np.uint8, stride * h, at).reshape(h, stride), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        values = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, count, at)
    if len(values) != count or (most != 255 and (values.min() < 0 or values.max() > most)) or (plain and (values.min() < 0 or values.max() > most)):
        raise ValueError("a sample is missing or out of range")
    if bitmap:
        values = 1 - values
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    return values.astype(np.uint8).reshape(h, w, channels)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 of one channel, P6 of three."""
    h, w, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, w, h) + np.ascontiguousarray(image).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel, as RGB."""
    at, header = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if packing not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("not an uncompressed BMP of 8, 24 or 32 bits")
    if packing == 3 and (bits != 32 or struct.unpack_from("<3I", raw, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("a BMP with colour masks of its own")
    stride = (w * bits // 8 + 3) // 4 * 4
    if stride * abs(h) > len(raw) - at:
        raise ValueError("fewer rows than the header says")
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", raw, 46)[0] or 256
        if colours > 256:
            raise ValueError("more colours than 8 bits name")
        palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
        image = palette[rows]
    else:
        image = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return image[::-1] if h > 0 else image


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of an RGB image."""
    h, w, _ = image.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_image(raw: bytes | None) -> np.ndarray | None:
    """An image's samples; None if it is null, damaged or of another format."""
    try:
        if raw and raw[:2] == b"BM":
            return decode_bmp(raw)
        if raw and raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
            return decode_netpbm(raw)
    except (ValueError, IndexError, struct.error):
        return None
    return None


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area under each target cell, by an integral image."""
    h, w, channels = image.shape

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    low, part = edges(height, h)
    needed = np.unique([low, low + 1])
    # the integral image's lines at the cells' edges; the rest of it is never held
    sums = np.zeros((len(needed), w + 1, channels), np.float64)
    above = np.zeros((w, channels), np.float64)
    for a in range(0, h, STRIP):
        lines = np.cumsum(image[a : a + STRIP], 0, dtype=np.float64)
        here = (needed > a) & (needed <= a + len(lines))
        sums[here, 1:] = above + lines[needed[here] - a - 1]
        above += lines[-1]
    np.cumsum(sums, 1, out=sums)

    def cut(table: np.ndarray, low: np.ndarray, part: np.ndarray) -> np.ndarray:
        part = part.reshape(-1, *[1] * (table.ndim - 1))
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    rows = cut(sums, np.searchsorted(needed, low), part)
    cells = cut(rows.swapaxes(0, 1), *edges(width, w)).swapaxes(0, 1)
    return np.floor(cells / (h * w / (height * width)) + 0.5).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the rounded mean of the channels."""
    return image if image.shape[2] == 1 else ((image.astype(np.uint16).sum(2, keepdims=True) + image.shape[2] // 2) // image.shape[2]).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    small = grey(resize(image, 8, 9))[:, :, 0].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def to_ppm(payload: bytes) -> bytes:
    """Bytes (a positive multiple of ROW) as the samples of an RGB image 64 pixels wide."""
    return encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3))


def from_ppm(raw: bytes) -> bytes:
    return decode_netpbm(raw).tobytes()


_ADDED = {"width": "int", "height": "int", "channels": "int", "tile": "binary", "dhash": "string"}


def describe(images: DataFrame, media_col: str = "media", *, tile: int = TILE) -> DataFrame:
    """``images`` with width, height, channels, tile (NPY bytes of the resized image) and dhash."""
    small_batches(images.sparkSession)
    images, schema = widened(images, _ADDED)
    at = images.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for raw in got.column(at).to_pylist():
                image = decode_image(raw)
                rows.append((None,) * 5 if image is None or not image.size else (image.shape[1], image.shape[0], image.shape[2], npy(resize(image, tile, tile)), difference_hash(image)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*got.columns, *columns], names=schema.names)

    return images.mapInArrow(run, schema)


_CARRIED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary()), ("bmp_bytes", pa.int64()), ("forms_agree", pa.bool_())])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        rows = []
        for i, media, n in zip(*(got.column(c).to_pylist() for c in ("id", "media", "n_bytes")), strict=True):
            image = decode_netpbm(media)
            payload = image.tobytes()
            bitmap = encode_bmp(image)
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy(resize(image, TILE, TILE)), len(bitmap), np.array_equal(decode_bmp(bitmap), image)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CARRIED)], schema=_CARRIED)


_MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        texts = [t.encode() for t in got.column("text").to_pylist()]
        media = [to_ppm(t + b" " * (ROW - len(t) % ROW if len(t) % ROW or not t else 0)) for t in texts]
        yield pa.RecordBatch.from_arrays([got.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=_MEDIA)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text as the samples of a PPM image."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_store, "id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload, checksums, difference hash (feature), NPY tile, and whether BMP holds the same."""
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return media.select("id", "n_bytes", "media").mapInArrow(_carry, ", ".join(f"{f.name} {kinds[f.type]}" for f in _CARRIED))
