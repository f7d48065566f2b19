"""Image files: header scan, raster ingest and resampling.

Files are spread over tasks by the ``binaryFile`` reader (or any table with
``path, content``); Python only decodes bytes, one file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_up

c = F.col
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_files(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first start-of-frame marker."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2:at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", data[at + 5:at + 9])
            return wide, high
        at += 2 + size
    return None


def scan_headers(files: DataFrame) -> DataFrame:
    """Format, size, SHA-256 and header error of each file.

    PNG headers are read by built-in functions; only JPEG files go to Python.
    """
    head = F.hex(F.substring("content", 1, 24))
    rows = files.select("path", "content", head.alias("_h"), F.sha2("content", 256).alias("sha256"))
    is_png, is_jpeg = c("_h").startswith(PNG_SIGNATURE.hex().upper()), c("_h").startswith("FFD8")
    whole = F.length("_h") >= 48
    def be(start):
        return F.when(is_png & whole, F.conv(F.substring("_h", start, 8), 16, 10).cast("bigint"))
    error = F.when(is_png & ~whole, "short PNG header").when(~is_png, "not a PNG or JPEG file")
    plain = rows.where(~is_jpeg).select("path", F.when(is_png, "png").alias("format"), be(33).alias("width"), be(41).alias("height"), "sha256", error.alias("error"))

    def jpeg(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [_jpeg_size(bytes(d)) for d in b["content"]]
            yield pd.DataFrame({"path": b["path"], "format": "jpeg", "width": pd.array([s and s[0] for s in sizes], dtype="Int64"),
                                "height": pd.array([s and s[1] for s in sizes], dtype="Int64"), "sha256": b["sha256"],
                                "error": [None if s else "no frame header" for s in sizes]})

    schema = "path string, format string, width bigint, height bigint, sha256 string, error string"
    return plain.unionByName(rows.where(is_jpeg).select("path", "content", "sha256").mapInPandas(jpeg, schema))


def decode_png(data: bytes) -> np.ndarray:
    """Non-interlaced PNG of any depth to an H x W x 3 array; 16-bit samples keep their high byte.

    Anything else raises ``ValueError``.
    """
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, wide, high, kind, table = 8, [], 0, 0, 0, None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at:at + 8])
        chunk = data[at + 8:at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            wide, high, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", chunk)
            if lace or kind not in (0, 2, 3, 4, 6) or depth not in (1, 2, 4, 8, 16):
                raise ValueError("interlaced or unknown PNG file")
        elif name == b"PLTE":
            table = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
    if not wide or not high:
        raise ValueError("no PNG header")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = max(1, samples * depth // 8)
    line = -(-wide * samples * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != high * (line + 1):
        raise ValueError("PNG data of a wrong length")
    raw = raw.reshape(high, line + 1)
    out = _unfilter(raw[:, 0], raw[:, 1:], step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        out = np.unpackbits(out, axis=1).reshape(high, -1, depth)[:, : wide * samples]
        out = out @ (1 << np.arange(depth)[::-1])
        if kind != 3:
            out = out * 255 // ((1 << depth) - 1)
    px = out.reshape(high, wide, samples).astype(np.uint8)
    if kind == 3:
        if table is None or px.max(initial=0) >= len(table):
            raise ValueError("palette entry missing")
        return table[px[..., 0]]
    return np.repeat(px[..., :1], 3, axis=2) if kind in (0, 4) else px[..., :3]


def _unfilter(modes: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of all scan lines. Lines move as one diagonal front: at front t, line y is at
    pixel t - y, so what it needs (left, above, corner) is known for all lines at once."""
    if modes.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if not modes.any():
        return lines
    high, wide = lines.shape[0], lines.shape[1] // step
    rest = lines.reshape(high, wide, step).astype(np.int32)
    out = np.zeros((high + 1, wide + 1, step), np.int32)
    for t in range(wide + high - 1):
        y = np.arange(max(0, t - wide + 1), min(high, t + 1))
        x = t - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        by_left, by_above, by_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
        mode = modes[y][:, None]
        guess = np.select([mode == 1, mode == 2, mode == 3, mode == 4], [left, above, (left + above) // 2, paeth], 0)
        out[y + 1, x + 1] = (rest[y, x] + guess) & 255
    return out[1:, 1:].reshape(high, -1).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """H x W x 3 array to PNG bytes (used to build inputs from tables)."""
    high, wide, _ = pixels.shape
    lines = np.concatenate([np.zeros((high, 1), np.uint8), pixels.astype(np.uint8).reshape(high, wide * 3)], axis=1)
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def ingest_rasters(files: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel rows ``x, y, r, g, b`` of each file, emitted band by band.

    A file that cannot be read (JPEG bytes among them: read these with ``read_images``)
    gives one row without pixel and with ``error``.
    """
    fields = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", x bigint, y bigint, r bigint, g bigint, b bigint, error string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    px = decode_png(bytes(row.content or b""))
                except (ValueError, zlib.error, struct.error) as e:
                    whole = pd.array([None], dtype="Int64")
                    yield pd.DataFrame({**{k: [getattr(row, k)] for k in keys}, **dict.fromkeys("xyrgb", whole), "error": [str(e) or "unreadable"]})
                    continue
                for top in range(0, px.shape[0], 64):
                    part = px[top:top + 64].astype(np.int64)
                    y, x = np.mgrid[top:top + part.shape[0], 0:part.shape[1]]
                    flat = part.reshape(-1, 3)
                    yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "x": x.ravel(), "y": y.ravel(),
                                        "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "error": None})

    return files.select(*keys, "content").mapInPandas(decode, schema)


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """Pixel rows ``path, x, y, r, g, b`` of image files (PNG, JPEG, BMP), decoded by Spark's image reader.

    A file that it cannot decode gives one row without pixel and with ``error``.
    """
    files = spark.read.format("image").option("dropInvalid", False).load(glob).select("image.*")
    bad = files.where(c("width") <= 0).select(c("origin").alias("path"), *[F.lit(None).cast("bigint").alias(k) for k in "xyrgb"], F.lit("unreadable").alias("error"))
    lines = files.where(c("width") > 0).select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), c("height") - 1)).alias("y"))
    spots = lines.select("origin", "width", "nChannels", "y", F.substring("data", c("y") * c("width") * c("nChannels") + 1, c("width") * c("nChannels")).alias("line"),
                         F.explode(F.sequence(F.lit(0), c("width") - 1)).alias("x"))

    def byte(k):  # channels stand in the order blue, green, red; gray files have one
        place = c("x") * c("nChannels") + F.when(c("nChannels") == 1, 0).otherwise(k) + 1
        return F.conv(F.hex(F.substring("line", place, F.lit(1))), 16, 10).cast("bigint")

    good = spots.select(c("origin").alias("path"), c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad)


def build_pngs(pixels: DataFrame, key: str = "slide") -> DataFrame:
    """PNG bytes of small rasters (scan lines are joined per image)."""
    lines = pixels.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("px"))
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", F.flatten(F.transform("px", lambda p: F.array(p["r"], p["g"], p["b"]))).alias("v")))).alias("rows"))
    flat = whole.select(key, F.size("rows").alias("high"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("v"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "content": [encode_png(np.asarray(v).reshape(h, -1, 3)) for h, v in zip(b["high"], b["v"])]})

    return flat.mapInPandas(encode, f"{key} bigint, content binary")


def lanczos_weights(sizes: DataFrame) -> DataFrame:
    """Rows ``(size_from, size_to, src, dst, weight)`` for each distinct size pair."""
    scale = c("size_from") / c("size_to")
    reach = F.greatest(scale, F.lit(1.0))
    centre = (c("dst") + 0.5) * scale
    spots = (sizes.distinct().withColumn("dst", F.explode(F.sequence(F.lit(0).cast("bigint"), c("size_to") - 1)))
             .withColumn("src", F.explode(F.sequence(F.greatest(F.floor(centre - 3 * reach), F.lit(0)), F.least(F.ceil(centre + 3 * reach), c("size_from") - 1)))))
    t = (c("src") + 0.5 - centre) / reach
    sinc = F.sin(F.pi() * t) / (F.pi() * t) * F.sin(F.pi() * t / 3) / (F.pi() * t / 3)
    raw = F.when(F.abs(t) < 1e-12, 1.0).when(F.abs(t) < 3, sinc).otherwise(0.0)
    w = W.partitionBy("size_from", "size_to", "dst")
    return spots.withColumn("raw", raw).withColumn("weight", c("raw") / F.sum("raw").over(w)).where("raw <> 0").drop("raw")


def resample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bring each raster to its target size; ``sizes``: slide, w0, h0, w1, h1.

    Horizontal pass, then vertical; each is a join with a weight table that depends
    only on the distinct size pairs, and a weighted sum with map-side combine.
    """
    def one(rows, axis, other, old, new):
        weights = lanczos_weights(sizes.select(c(old).alias("size_from"), c(new).alias("size_to"))).withColumnsRenamed(
            {"size_from": old, "size_to": new, "src": axis})
        summed = rows.join(weights, [old, new, axis]).groupBy("slide", other, "w0", "h0", "w1", "h1", "dst").agg(
            *[F.sum(c(ch) * c("weight")).alias(ch) for ch in "rgb"])
        return summed.select("slide", c("dst").alias(axis), other, "w0", "h0", "w1", "h1",
                             *[clamp(half_up(F.round(c(ch), 9)), 0, 255).alias(ch) for ch in "rgb"])

    sized = pixels.join(sizes, "slide")
    same = (c("w0") == c("w1")) & (c("h0") == c("h1"))
    moved = one(one(sized.where(~same), "x", "y", "w0", "w1"), "y", "x", "h0", "h1")
    cols = ["slide", "x", "y", "r", "g", "b"]
    return sized.where(same).select(*cols, F.lit(False).alias("resized")).unionByName(moved.select(*cols, F.lit(True).alias("resized")))
