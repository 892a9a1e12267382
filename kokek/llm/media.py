"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kokek.llm.common import prepare

#: Bytes of one row of 64 RGB samples; payloads are padded to a multiple of it.
ROW = 192


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P6 of an (h, w, 3) array, P5 of an (h, w) one."""
    kind = "P6" if pixels.ndim == 3 else "P5"
    return f"{kind}\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode() + pixels.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 with comments; maxval up to 255 gives uint8, above it uint16 samples, as stored. Data that
    end early or have impossible headers raise ValueError."""
    if data[:1] != b"P" or data[1:2] not in b"123456" or len(data) < 3:
        raise ValueError("not a Netpbm file")
    kind, at, head = data[1] - 48, 2, []  # from here on, ``at`` stands behind the last number read
    while len(head) < (2 if kind in (1, 4) else 3):
        while at < len(data) and (data[at] in b" \t\r\n\x0b\x0c" or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        head.append(int(data[at:end]))
        at = end
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = w * h * (3 if kind in (3, 6) else 1)
    if not 0 < top < 1 << 16 or not n or n > 8 * len(data):
        raise ValueError("broken Netpbm header")
    if kind <= 3:
        body = data[at:]
        body = re.sub(rb"#[^\n]*", b"", body)
        digits = [c for c in body.decode("ascii") if c in "01"] if kind == 1 else body.split()
        out = np.array(digits[:n], dtype=np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(out) < n or kind != 1 and out.max() > top or out.min() < 0:
        raise ValueError("Netpbm data end early or exceed their maximum")
    out = (1 - out) * 255 if kind == 1 else out
    return out.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A bottom-up 24-bit BMP of an (h, w, 3) RGB array."""
    h, w, _ = pixels.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24- and 32-bit BMP as (h, w, 3) RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or depth not in (8, 24, 32) or w <= 0 or not h or w * abs(h) > len(data):
        raise ValueError("unsupported BMP")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)
        return palette[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def greatest(data: bytes) -> int:
    """The sample value that stands for white: 255, but for Netpbm files with another maximum."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        numbers = re.match(rb"P[2356](?:(?:\s|#[^\n]*\n)+(\d+)){3}", data)
        return int(numbers[1])
    return 255


#: Rows of an image whose integral image is held at once.
STRIP = 4096


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the (fractional) source area under each target cell. The integral image, made strip by
    strip, is read at the cells' corners, between which it is bilinear; four reads give a cell's sum."""
    h, w = grey.shape
    rows, cols = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    right = np.minimum(cols.astype(np.int64), w - 1)
    share = cols - right
    corner, carry = np.zeros((height + 1, width + 1)), np.zeros(w + 1)
    for top in range(0, h, STRIP):
        strip = grey[top : top + STRIP]
        image = np.zeros((len(strip) + 1, w + 1))
        np.cumsum(np.cumsum(strip, axis=0), axis=1, out=image[1:, 1:])
        image += carry
        here = np.flatnonzero((rows >= top) & (rows <= top + len(strip)))
        low = np.minimum(rows[here].astype(np.int64) - top, len(strip) - 1)
        part = (rows[here] - top - low)[:, None]
        line = image[low] * (1 - part) + image[low + 1] * part
        corner[here] = line[:, right] * (1 - share) + line[:, right + 1] * share
        carry = image[-1]
    return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) * (height * width / (h * w))


def grey_of(pixels: np.ndarray, top: int = 255) -> np.ndarray:
    """Grey values from 0 to 255 of samples from 0 to ``top``."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)
    return grey if top == 255 else grey * (255 / top)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(grey: np.ndarray, side: int = 16) -> bytes:
    """The area-resized grey tile as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(grey, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW if data else ROW), len(data)


_FIELDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _FIELDS[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > 4 << 20 or len(held) >= 512:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_MEDIA_DDL = "id long, height int, width int, samples int, feature string, tile binary, error string"


def described(data: bytes | None) -> tuple:
    """height, width, samples of a pixel, difference hash, NPY tile, error of a stored image."""
    if data is None:
        return None, None, None, None, None, "no data"
    try:
        pixels = decode(data)
        grey = grey_of(pixels, greatest(data))
    except (ValueError, IndexError, OverflowError, struct.error) as error:  # samples beyond 64 bits overflow
        return None, None, None, None, None, str(error)
    return pixels.shape[0], pixels.shape[1], pixels.shape[2] if pixels.ndim == 3 else 1, difference_hash(grey), npy_tile(grey), None


def media_columns(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """id, height, width, samples (of a pixel), feature (difference hash), tile (NPY bytes), error of each
    row's stored image (Netpbm or BMP) in a binary ``column``.

    Nulls and files that cannot be decoded have an error and nulls else. One image is held at a time.
    Repeated rows and null ids stay; other columns are not read; an empty table gives an empty one.
    """
    prepare(media.sparkSession)
    schema = _schema(_MEDIA_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((b.column(0)[i].as_py(), *described(b.column(1)[i].as_py())) for b in batches for i in range(b.num_rows)), schema)

    named = media.select(media[id_column].cast("long").alias("id"), media[column].alias("media"))
    return named.mapInArrow(run, _MEDIA_DDL)


_TEXT_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, tile binary"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each whole text as a Netpbm image and reads features back from the stored bytes.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (difference hash), media (the stored file), tile (NPY bytes). A null
    text is an empty one, whose payload is one row of blanks. Each row stands for itself:
    repeated rows, null ids, other columns and empty tables need nothing special.
    """
    prepare(docs.sparkSession)
    schema = _schema(_TEXT_DDL)

    def row(doc_id: int | None, text: str | None) -> tuple:
        payload, n = payload_of(text)
        media = encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        back = decode(media).tobytes()
        _, _, _, feature, tile, _ = described(media)
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((row(b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows)), schema)

    return docs.select("doc_id", "text").mapInArrow(run, _TEXT_DDL)


def write_tiles(media: DataFrame, path: str) -> None:
    """Writes the NPY tiles with their hashes as Parquet rows (one small file for each image would
    not survive billions of rows) of a new folder. Rows without a tile are left out."""
    media.select(media.columns[0], "feature", "tile").where("tile IS NOT NULL").write.parquet(path)
