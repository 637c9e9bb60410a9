"""Media columns: losslessly stored PNG images in binary columns, and perceptual hashes of them.

A PNG is the eight-byte signature and a row of chunks (length, type, data, CRC-32); the image data
are one zlib stream of rows, each led by the number of its filter. ``write_png`` and ``read_png``
do this with ``zlib`` and numpy; reading tests the signature, every chunk's checksum and the size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: An image row of a text payload: 64 pixels of 3 samples.
ROW_BYTES = 192
PAD = b" "


class BadImage(ValueError):
    """Not a PNG of the kind read here, or damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) array as PNG. Rows are stored unfiltered, or by the
    Up filter where that makes the sum of their samples (taken as signed) smaller over the image."""
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    up = np.vstack([rows[:1], rows[1:] - rows[:-1]])
    use_up = np.abs(up.view(np.int8), dtype=np.int16).sum() < np.abs(rows.view(np.int8), dtype=np.int16).sum()
    lines = np.empty((h, rows.shape[1] + 1), np.uint8)
    lines[:, 0] = 2 if use_up else 0
    lines[:, 1:] = up if use_up else rows
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadImage("torn chunk")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png) or zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise BadImage(f"checksum of {kind!r} does not hold")
        yield kind, data
        at += 12 + n


def _predicted(lines: np.ndarray, kinds: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of Average and Paeth rows. A sample needs those to its left, above, and above left, so all
    samples on a diagonal are worked out together, from the top left to the bottom right."""
    h, w = lines.shape[0], lines.shape[1] // bpp
    raw = lines.reshape(h, w, bpp).astype(np.int16)
    out = np.zeros((h + 1, w + 1, bpp), np.int16)
    out[0, 1:] = above.reshape(w, bpp)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (raw[y, x] + np.where(kinds[y, None] == 3, (left + up) // 2, paeth)) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples from filtered rows (h, 1 + stride). Runs of rows of a kind are done at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise BadImage(f"filter {kinds.max()}")
    group = np.where(kinds == 4, 3, kinds)  # Average and Paeth rows may alternate
    y = 0
    while y < len(out):
        end = y + 1
        while end < len(out) and group[end] == group[y]:
            end += 1
        if group[y] == 1:
            for c in range(bpp):
                out[y:end, c::bpp] = np.cumsum(out[y:end, c::bpp], axis=1, dtype=np.uint8)
        elif group[y] == 2:
            if y:
                out[y] += out[y - 1]
            out[y:end] = np.cumsum(out[y:end], axis=0, dtype=np.uint8)
        elif group[y] == 3:
            out[y:end] = _predicted(out[y:end], kinds[y:end], out[y - 1] if y else np.zeros_like(out[0]), bpp)
        y = end
    return out


def read_png(png: bytes) -> np.ndarray:
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise BadImage("not an 8-bit grey or RGB image without interlace")
    w, h, bpp = head[0], head[1], 3 if head[3] == 2 else 1
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != h * (w * bpp + 1):
        raise BadImage("image data of another size")
    out = unfilter(np.frombuffer(raw, np.uint8).reshape(h, -1), bpp)
    return out.reshape((h, w, 3) if bpp == 3 else (h, w))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


def _shrink(grey: np.ndarray, n: int) -> np.ndarray:
    """Mean over an n x n grid of cells of near-equal size; small images repeat rows or columns."""
    for axis in (0, 1):
        size = grey.shape[axis]
        if size < n:
            grey = np.take(grey, np.arange(n) * size // n, axis)
        else:
            edges = np.arange(n) * size // n
            counts = np.diff(np.append(edges, size))
            grey = np.add.reduceat(grey, edges, axis) / (counts[:, None] if axis == 0 else counts)
    return grey


_DCT = _cosines(32, 8)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 grey image
    exceed their median (the constant one is left out of the median)."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(float)
    low = np.round(_DCT @ _shrink(grey, 32) @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(data: bytes) -> bytes:
    """The bytes with spaces appended, up to a positive multiple of ``ROW_BYTES``."""
    return data + PAD * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def text_to_png(text: str) -> bytes:
    return write_png(np.frombuffer(payload_of(text.encode()), np.uint8).reshape(-1, 64, 3))


IMAGE_SCHEMA = "doc_id long, n_bytes long, png binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """One PNG per row: ``doc_id, n_bytes, png``. Null texts count as empty, and an empty text is one row of
    spaces; equal texts give equal images, repeated rows stay, an empty table gives an empty one. A text of
    any length is one image, three bytes a pixel; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, 64, 3)) for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "png"],
            )

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, IMAGE_SCHEMA)


FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, width int, height int"
)


def image_features(images: DataFrame) -> DataFrame:
    """Features of stored images, every one computed from the bytes read back from ``png``.

    A null image has null features, a damaged one fails. Equal images have equal features; repeated rows
    stay; an empty table gives an empty one. Coefficients equal to their median are bits of 0.
    """

    def one(png: bytes | None) -> tuple:
        if png is None:
            return (None,) * 8
        pixels = read_png(png)
        back = pixels.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels), pixels.shape[1], pixels.shape[0]

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(p) for p in b.column("png").to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=names)

    return images.select("doc_id", "n_bytes", "png").mapInArrow(run, FEATURE_SCHEMA)
