"""Lossless media columns: byte payloads as greyscale PNG, read back with every check, and
low-frequency cosine-transform hashes.

Encoding and decoding use zlib and numpy only. Each chunk's checksum, the order of chunks, the length
of the pixel data and its Adler sum are tested; the five row filters are undone in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, utf8_rows, with_row_key

WIDTH, LEVEL, CHUNK = 64, 6, 1 << 20
HASH = 8
#: Fixed values of the format: its signature, and samples per pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


class MediaError(ValueError):
    """The stored bytes fail a check."""


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data and bytes 0 up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _entropy(x: np.ndarray) -> float:
    n = np.bincount(x.ravel(), minlength=256)
    p = n[n > 0] / x.size
    return float(-(p * np.log2(p)).sum())


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """payload, a positive multiple of width long, as an 8-bit greyscale image. Of the filters none,
    sub and up, the one that leaves the least entropy is used for all rows."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    kind = min(range(3), key=lambda i: _entropy((image, sub, up)[i]))
    raw = np.empty((len(image), width + 1), dtype=np.uint8)
    raw[:, 0], raw[:, 1:] = kind, (image, sub, up)[kind]
    packed = zlib.compress(raw.tobytes(), level)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *[chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)], chunk(b"IEND", b"")])


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """raw: rows of a filter byte and samples; step: bytes in a pixel."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        kind = kinds[a]
        if kind == 1:
            for s in range(step):
                out[a:b, s::step] = np.cumsum(out[a:b, s::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(np.int64) if y else np.zeros(out.shape[1], dtype=np.int64)
                row = out[y].astype(np.int64)
                for x in range(0, len(row), step):
                    left = row[x - step : x] if x else np.zeros(step, dtype=np.int64)
                    over = above[x : x + step]
                    if kind == 3:
                        guess = (left + over) // 2
                    else:
                        corner = above[x - step : x] if x else np.zeros(step, dtype=np.int64)
                        far = np.abs(np.stack([over - corner, left - corner, left + over - 2 * corner]))
                        guess = np.choose(far.argmin(axis=0), [left, over, corner])
                    row[x : x + step] = (row[x : x + step] + guess) % 256
                out[y] = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit image that isn't interlaced."""
    if data[:8] != SIGNATURE:
        raise MediaError("no signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut chunk")
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or at + 12 + n > len(data) or struct.pack(">I", zlib.crc32(name + part)) != data[at + 8 + n : at + 12 + n]:
            raise MediaError(f"checksum of {name!r}")
        at += 12 + n
        if (name == b"IHDR") != (head is None):
            raise MediaError("IHDR isn't the first chunk, once")
        if name == b"IHDR":
            if n != 13:
                raise MediaError("IHDR length")
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            ended = True
        elif not name[0] & 32:
            raise MediaError(f"unknown critical chunk {name!r}")
    if head is None or not ended or at != len(data):
        raise MediaError("chunks are missing or follow the end")
    width, height, depth, colour, compression, kind, interlace = head
    if not width or not height or depth != 8 or colour not in SAMPLES or compression or kind or interlace:
        raise MediaError("not an 8-bit image of a known kind")
    step = SAMPLES[colour]
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), height * (width * step + 1) + 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * step + 1) or not inflate.eof or inflate.unused_data:
        raise MediaError("length of the pixel data")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, -1), step)


def _cosines(n: int, a: int, b: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(HASH), np.arange(a, b) + 0.5))


_kept_cosines = lru_cache(maxsize=512)(_cosines)


def _waves(n: int, a: int, b: int) -> np.ndarray:
    """The HASH lowest cosines over n samples, at samples a to b. Short ones are kept, 16 MB at most."""
    return (_kept_cosines if b - a <= 512 else _cosines)(n, a, b)


def cosine_hash(image: np.ndarray, block: int = 16384) -> bytes:
    """8 bytes: which of the 8 x 8 lowest cosine coefficients exceed their median (the constant one
    is left out of it). Images of any height are summed in blocks."""
    h, w = image.shape
    low = np.zeros((HASH, w))
    for y in range(0, h, block):
        low += _waves(h, y, min(h, y + block)) @ image[y : y + block].astype(np.float64)
    c = (low @ _waves(w, 0, w).T).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes()


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, key, n_bytes (unpadded) and media, a binary column with a PNG of each text's UTF-8 bytes.
    Null is the empty text, which is 64 zero bytes. Repeated rows are kept, also with null keys; very long
    texts are images of many rows; an empty table gives no rows; other columns are ignored."""
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = [], []
            for t in utf8_rows(b.column("_text")):
                sizes.append(len(t))
                out.append(encode_png(padded(t)))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("_key"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["rid", "_key", "n_bytes", "media"])

    kind = rows.schema["_key"].dataType.simpleString()
    return mapped(rows, run, f"rid long, _key {kind}, n_bytes long, media binary").withColumnRenamed("_key", key)


def media_features(media: DataFrame, column: str = "media", payload: bool = False) -> DataFrame:
    """media with payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, hash (8 bytes), error, and payload if asked for. Where a check fails, error says
    which and the columns read from the payload are null; a null column is an error too."""
    kept = [c for c in media.columns if c != column]
    made = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "hash": pa.binary(), "error": pa.string(), "payload": pa.binary()}
    names = list(made)[: 7 + payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for data in utf8_rows(b.column(column)):
                row = dict.fromkeys(names)
                row["media_bytes"], row["media_sha256"] = len(data), hashlib.sha256(data).hexdigest()
                try:
                    image = decode_png(data)
                    got = image.tobytes()
                    row |= {"payload_bytes": len(got), "payload_sha256": hashlib.sha256(got).hexdigest(), "tail_crc32": zlib.crc32(got[-64:]), "hash": cosine_hash(image)}
                    if payload:
                        row["payload"] = got
                except MediaError as e:
                    row["error"] = str(e)
                for n in names:
                    out[n].append(row[n])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(out[n], made[n]) for n in names]], [*kept, *names])

    schema = media.select(kept).schema
    for n in names:
        schema = schema.add(n, {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}[made[n]])
    return mapped(media, run, schema)


def media_round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The texts stored as media in the shared folder, read back and described."""
    return media_features(stored(to_media(docs, text, key), "media"))
