"""Audio, image and array files: byte decoders, and readers over `binaryFile`, which any Hadoop store serves."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.image import IMAGE_DDL, _PIXELS, pack
from ..session import prepare


class MediaError(ValueError):
    """Bytes that cannot be decoded."""


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples, rate) of a RIFF file: integers over 2 ** (bits - 1), floats as they are, channels averaged."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise MediaError("not a RIFF WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if form is None or body is None or len(form) < 16:
        raise MediaError("no format or no samples")
    kind, channels, rate, _, width, bits = struct.unpack_from("<HHIIHH", form)
    if kind == 0xFFFE and len(form) >= 26:
        kind = struct.unpack_from("<H", form, 24)[0]
    step = width // channels if channels else 0
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(body[: len(body) // step * step], f"<f{step}").astype(np.float32)
    elif kind == 1 and step in (1, 2, 3, 4):
        raw = np.frombuffer(body[: len(body) // step * step], np.uint8).reshape(-1, step)
        if step == 1:
            whole = raw[:, 0].astype(np.int64) - 128
        else:
            whole = sum(raw[:, i].astype(np.int64) << (8 * i) for i in range(step))
            whole = np.where(whole >= 1 << (8 * step - 1), whole - (1 << (8 * step)), whole)
        x = whole.astype(np.float32) / np.float32(1 << (bits - 1))
    else:
        raise MediaError(f"sample format {kind} with {bits} bits")
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels)
        total = x[:, 0].copy()
        for c in range(1, channels):
            total += x[:, c]
        x = total / np.float32(channels)
    return x, rate


#: Bytes of a pixel's channels by PNG colour type, and the first position and step (x, y) of each pass of an interlaced file (fixed values).
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _nearest(a: int, b: int, c: int) -> int:
    """The Paeth predictor: of left, above and above left the one nearest to left + above - above left."""
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def _unfiltered(raw: bytes, at: int, line: int, rows: int, step: int) -> np.ndarray:
    """(rows, line) bytes of a PNG's filtered rows. Rows whose filter looks to the left are undone by sums or on plain integers."""
    out = np.zeros((rows, line), np.uint8)
    above = np.zeros(line, np.uint8)
    for y in range(rows):
        kind, at = raw[at], at + 1
        row = np.frombuffer(raw, np.uint8, line, at).copy()
        at += line
        if kind == 1:
            for i in range(step):
                row[i::step] = np.cumsum(row[i::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            up, left = above.tolist(), [0] * step
            done = left + row.tolist()
            corner = left + up
            for i in range(line):
                guess = (done[i] + up[i]) // 2 if kind == 3 else _nearest(done[i], up[i], corner[i])
                done[i + step] = (done[i + step] + guess) & 255
            row = np.array(done[step:], np.uint8)
        elif kind:
            raise MediaError(f"PNG filter {kind}")
        out[y] = above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """A PNG of 1 to 16 bits, gray, RGB or palette, with or without alpha, interlaced or not; 16 bits keep the high byte."""
    at, chunks = 8, {}
    idat = b""
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            idat += body
        else:
            chunks[name] = body
        at += 12 + size
    if b"IHDR" not in chunks:
        raise MediaError("no PNG header")
    w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    n = PNG_CHANNELS.get(color)
    if n is None:
        raise MediaError(f"PNG colour type {color}")
    try:
        raw = zlib.decompress(idat)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    x = np.zeros((h, w, n), np.uint8)
    start = 0
    for x0, y0, dx, dy in PNG_PASSES if interlace else ((0, 0, 1, 1),):
        cols, rows = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if cols <= 0 or rows <= 0:
            continue
        line = (cols * n * depth + 7) // 8
        if len(raw) < start + rows * (line + 1):
            raise MediaError("the image data is cut short")
        out = _unfiltered(raw, start, line, rows, max(1, n * depth // 8))
        start += rows * (line + 1)
        if depth == 16:
            out = out.reshape(rows, cols * n, 2)[..., 0]
        elif depth < 8:
            bits = np.unpackbits(out, axis=1)[:, : cols * n * depth].reshape(rows, cols * n, depth)
            out = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
            if color != 3:
                out = (out.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        x[y0::dy, x0::dx] = out.reshape(rows, cols, n)
    if color == 3:
        return np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[x[..., 0]]
    return x


def decode_pnm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM of 8 bits."""
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    w, h, top = words
    n = 3 if data[:2] == b"P6" else 1
    if top != 255 or len(data) < at + 1 + w * h * n:
        raise MediaError("not an 8-bit image of its size")
    return np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape(h, w, n)


def decode_image(data: bytes) -> np.ndarray:
    """An image by its content, height x width x channels. PNG and PNM; other formats go through `read_images_jvm`."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        return decode_pnm(data)
    raise MediaError("unknown image format")


def _decoded(files: DataFrame, f, kind, ddl: str, tolerant: bool) -> DataFrame:
    prepare(files.sparkSession)

    def run(batches):
        for b in batches:
            made, errors = [], []
            for data in b.column(1).to_pylist():
                try:
                    made.append(f(data))
                    errors.append(None)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    if not tolerant:
                        raise
                    made.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, kind), pa.array(errors, pa.string())], ["path", "value", "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, value {ddl}, error string")


def decode_wavs(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """(path, sample_rate, samples, error) of WAV files (path, content); tolerant: a bad file gives nulls and its error."""
    kind = pa.struct([("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32()))])

    def one(data):
        x, rate = decode_wav(data)
        return {"sample_rate": rate, "samples": x}

    rows = _decoded(files, one, kind, "struct<sample_rate:int,samples:array<float>>", tolerant)
    return rows.select("path", "value.sample_rate", "value.samples", "error")


def read_wav(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """As `decode_wavs`, of files in any Hadoop store."""
    return decode_wavs(spark.read.format("binaryFile").load(path), tolerant)


def decode_images(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """(path, image, error) of PNG and PNM files (path, content)."""
    return _decoded(files, lambda d: pack(decode_image(d)), _PIXELS, IMAGE_DDL, tolerant).withColumnRenamed("value", "image")


def read_images(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """As `decode_images`, of files in any Hadoop store."""
    return decode_images(spark.read.format("binaryFile").load(path), tolerant)


def read_images_jvm(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, error) of whatever the JVM decodes (JPEG, PNG, GIF, BMP), as interleaved RGB without alpha. A file that it cannot
    decode has a null image and an error."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    prepare(spark)

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                if v["height"] <= 0 or v["nChannels"] <= 0:
                    out.append(None)
                    continue
                x = np.frombuffer(v["data"], np.uint8).reshape(v["height"], v["width"], v["nChannels"])
                x = np.repeat(x, 3, 2) if x.shape[2] == 1 else x[..., 2::-1]
                out.append(pack(np.ascontiguousarray(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _PIXELS)], ["path", "image"])

    done = rows.select(F.col("image.origin").alias("path"), "image").mapInArrow(run, f"path string, image {IMAGE_DDL}")
    return done.withColumn("error", F.when(F.col("image").isNull(), F.lit("cannot be decoded")))


def read_npy(data: bytes) -> np.ndarray:
    """An `.npy` array of u1, i8 or f4 in C order, as doubles."""
    import io

    x = np.load(io.BytesIO(data), allow_pickle=False)
    if x.dtype.str[1:] not in ("u1", "i8", "f4"):
        raise MediaError(f"array of {x.dtype}")
    return x.astype(np.float64)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file."""
    body = np.clip(np.round(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def encode_png(x: np.ndarray, filters: tuple[int, ...] = (0,), interlaced: bool = False) -> bytes:
    """An 8-bit gray, RGB or RGBA file; rows take the filters in turn."""
    h, w = x.shape[:2]
    n = x.shape[2] if x.ndim == 3 else 1
    x = x.reshape(h, w, n)
    body = bytearray()
    for x0, y0, dx, dy in PNG_PASSES if interlaced else ((0, 0, 1, 1),):
        part = x[y0::dy, x0::dx].reshape(len(x[y0::dy]), -1).astype(np.int64)
        if not part.size:
            continue
        up, left = np.zeros_like(part), np.zeros_like(part)
        up[1:], left[:, n:] = part[:-1], part[:, :-n]
        corner = np.zeros_like(part)
        corner[1:, n:] = part[:-1, :-n]
        p = left + up - corner
        far = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(far.argmin(0), [left, up, corner])
        guess = [np.zeros_like(part), left, up, (left + up) // 2, paeth]
        for y in range(len(part)):
            kind = filters[y % len(filters)]
            body += bytes([kind]) + (part[y] - guess[kind][y]).astype(np.uint8).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    color = {1: 0, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, interlaced)) + chunk(b"IDAT", zlib.compress(bytes(body))) + chunk(b"IEND", b"")
