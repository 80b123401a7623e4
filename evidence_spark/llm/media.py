"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A binary Netpbm file of (height, width, 3) samples."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A bottom-up 24-bit BMP file of (height, width, 3) red, green, blue samples."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    size = 54 + rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_header(data: bytes) -> tuple[bytes, list[int], int]:
    kind, values, at = data[:2], [], 2
    need = 2 if kind == b"P4" else 3
    while len(values) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        values.append(int(data[at:end]))
        at = end
    return kind, values, at + 1


def decode(data: bytes | None) -> np.ndarray | None:
    """Samples of a Netpbm (P4, P5, P6, 8 bits) or BMP (24 or 32 bits) file: (height, width, channels); null if it is none."""
    try:
        if data[:2] in (b"P4", b"P5", b"P6"):
            kind, values, at = _netpbm_header(data)
            w, h = values[:2]
            if kind == b"P4":
                bits = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
                return (1 - np.unpackbits(bits, axis=1)[:, :w, None]) * np.uint8(255)
            if values[2] > 255:
                return None
            c = 3 if kind == b"P6" else 1
            return np.frombuffer(data, np.uint8, h * w * c, at).reshape(h, w, c)
        if data[:2] == b"BM":
            (at,) = struct.unpack_from("<I", data, 10)
            w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
            if bits not in (24, 32) or packed not in (0, 3) or w <= 0 or h == 0:
                return None
            c, stride = bits // 8, (w * bits + 31) // 32 * 4
            rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * c].reshape(abs(h), w, c)
            return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[:, :, 2::-1])
    except (ValueError, TypeError, struct.error):
        return None
    return None


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's area, by an integral image; a cell's edge may cut through a sample."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(table: np.ndarray, n: int, cells: int) -> np.ndarray:
        place = np.arange(cells + 1) * n / cells
        low = np.minimum(place.astype(int), n - 1) if n else np.zeros(cells + 1, int)
        return table[low] + (table[low + 1] - table[low]) * (place - low)[:, None]

    cut = at(at(total, h, height).T, w, width).T
    return (cut[1:, 1:] - cut[:-1, 1:] - cut[1:, :-1] + cut[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(tile: np.ndarray) -> str:
    """Hex digits of the signs between neighbours in the rows of an (n, n + 1) tile."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def text_media(text: str | None, width: int = 64) -> bytes:
    """A text's UTF-8 bytes, padded with spaces to whole rows, as an image: BMP for an even number of rows, else PPM."""
    data = (text or "").encode("utf-8", "replace")
    row = 3 * width
    n = max(1, -(-len(data) // row))
    pixels = np.frombuffer(data.ljust(n * row), np.uint8).reshape(n, width, 3)
    return encode_ppm(pixels) if n % 2 else encode_bmp(pixels)


def store_texts(docs: DataFrame, width: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): whole texts kept losslessly as images. Null texts are empty; an empty text is one row of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(k).slice(lo, 256) for k in (0, 1))
                texts = texts.to_pylist()
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array([text_media(t, width) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.selectExpr(f"cast({id_col} as long)", f"cast({text_col} as string)").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def media_features(media: DataFrame, side: int = 8, media_col: str = "media") -> DataFrame:
    """Reads stored images back: adds payload figures, the NPY tile and its difference hash to the other columns.

    The samples are grayed (mean of channels), area-resized to (side, side + 1) and kept as an NPY file of
    float32. Null or damaged media give nulls. Equal media give equal values. Columns of the names that are added are replaced.
    """
    added = StructType.fromDDL(FEATURES)
    kept = [f for f in media.schema.fields if f.name != media_col and f.name not in added.names]
    schema = StructType([*kept, *added.fields])

    def features(data: bytes | None) -> tuple:
        pixels = decode(data)
        if pixels is None or not pixels.size:
            return None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None
        payload = pixels.tobytes()
        tile = area_resize(pixels.mean(axis=2), side, side + 1).astype(np.float32)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), npy(tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in schema.fields])

    # plain names on the way in, as names with dots can't be passed
    plain = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate([*(f.name for f in kept), media_col])]
    return media.select(*plain).mapInArrow(run, schema)
