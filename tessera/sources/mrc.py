"""Binary image stacks: header, tile records and pixels.

A file's header and extended header are read by one task; pixels by one task for some tiles, by their offsets. Numbers are
big endian where the stamp's first byte is 17.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

HEADER_BYTES = 1024
#: Bytes of values, 8 for each, that are read at once.
RANGE_BYTES = 1 << 20
#: Pixel mode: numpy type and bytes of a pixel.
MODES = {0: ("u1", 1), 1: ("i2", 2), 2: ("f4", 4), 3: ("i2", 4), 4: ("c8", 8), 6: ("u2", 2), 16: ("u1", 3)}
TILT, PIECE, STAGE, MAGNIFICATION, INTENSITY, EXPOSURE = 1, 2, 4, 8, 16, 32


def parsed_header(data: bytes) -> dict:
    """The fields of the first 1024 bytes; spacing in nanometers. Another axis order than x, y, z is an error."""
    order = ">" if data[0xD4] == 17 else "<"
    at = lambda kind, offset: struct.unpack_from(order + kind, data, offset)
    x, y, tiles, mode = at("4I", 0)
    grid, cell = at("3I", 0x1C), at("3f", 0x28)
    if at("3I", 0x40) != (1, 2, 3):
        raise ValueError("axes aren't in the order x, y, z")
    low, high, mean = at("3f", 0x4C)
    size, flags = at("2H", 0x80)
    return {"big_endian": order == ">", "width": x, "height": y, "tiles": tiles, "mode": mode, "nm_per_pixel_x": cell[0] / grid[0] / 10 if grid[0] else None, "nm_per_pixel_y": cell[1] / grid[1] / 10 if grid[1] else None, "min": low, "max": high, "mean": mean, "extended_bytes": at("I", 0x5C)[0], "tile_header_bytes": size, "tile_flags": flags, "origin_x": at("3f", 0xC4)[0], "origin_y": at("3f", 0xC4)[1]}


def parsed_tile(data: bytes, flags: int, nm_per_pixel: float | None, order: str) -> dict:
    """One tile's record: only the fields that the flags name are there, in this order."""
    out: dict[str, float | int | None] = dict.fromkeys(("tilt", "piece_x", "piece_y", "piece_z", "stage_x", "stage_y", "pixel_x", "pixel_y", "magnification", "intensity", "exposure"))
    at = 0

    def take(kind: str):
        nonlocal at
        values = struct.unpack_from(order + kind, data, at)
        at += struct.calcsize(order + kind)
        return values

    if flags & TILT:
        out["tilt"] = take("H")[0] / 100
    if flags & PIECE:
        out["piece_x"], out["piece_y"], out["piece_z"] = take("3H")
    if flags & STAGE:
        out["stage_x"], out["stage_y"] = (v / 25 for v in take("2H"))
        if nm_per_pixel:
            out["pixel_x"], out["pixel_y"] = (out[k] * 1000 / nm_per_pixel for k in ("stage_x", "stage_y"))
    if flags & MAGNIFICATION:
        out["magnification"] = take("H")[0] * 100.0
    if flags & INTENSITY:
        out["intensity"] = take("H")[0] / 25000
    if flags & EXPOSURE:
        out["exposure"] = take("f")[0]
    return out


HEADER_TYPES = "file string, big_endian boolean, width int, height int, tiles int, mode int, nm_per_pixel_x double, nm_per_pixel_y double, min double, max double, mean double, extended_bytes int, tile_header_bytes int, tile_flags int, origin_x double, origin_y double"
TILE_TYPES = "file string, tile int, tilt double, piece_x int, piece_y int, piece_z int, stage_x double, stage_y double, pixel_x double, pixel_y double, magnification double, intensity double, exposure double"


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def _read(file: str, offset: int, size: int) -> bytes:
    system, name = fs.FileSystem.from_uri(file)
    with system.open_input_file(name) as f:
        return f.read_at(size, offset)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of a path or glob. File contents aren't loaded, but for their headers."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame([{"file": x} | parsed_header(_read(x, 0, HEADER_BYTES)) for x in f["file"]])

    return _files(spark, path).mapInPandas(read, HEADER_TYPES)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tile of each file."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TILE_TYPES.split(", ")]
        for f in frames:
            for file in f["file"]:
                h = parsed_header(_read(file, 0, HEADER_BYTES))
                data, size = _read(file, HEADER_BYTES, h["extended_bytes"]), h["tile_header_bytes"]
                order = ">" if h["big_endian"] else "<"
                rows = [{"file": file, "tile": k} | parsed_tile(data[k * size : (k + 1) * size], h["tile_flags"], h["nm_per_pixel_x"], order) for k in range(h["tiles"])]
                if rows:
                    out = pd.DataFrame(rows, columns=names)
                    for n in ("piece_x", "piece_y", "piece_z"):
                        out[n] = out[n].astype("Int32")
                    for n in names[2:]:
                        if not n.startswith("piece"):
                            out[n] = out[n].astype(float)
                    yield out

    return _files(spark, path).mapInPandas(read, TILE_TYPES)


def pixels(spark: SparkSession, path: str, camera_bits: int | None = None) -> DataFrame:
    """(file, tile, width, height, values): row-major values of each tile, read by its offset, as many tiles at once as
    RANGE_BYTES hold; values beyond the camera's bits wrapped around. Modes of one number a pixel only."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, first, count in zip(f["file"], f["first"], f["count"]):
                h = parsed_header(_read(file, 0, HEADER_BYTES))
                kind, size = MODES[h["mode"]]
                if size != np.dtype(kind).itemsize or kind == "c8":
                    raise ValueError(f"pixel mode {h['mode']} has several numbers a pixel")
                n = h["width"] * h["height"]
                v = np.frombuffer(_read(file, HEADER_BYTES + h["extended_bytes"] + first * n * size, count * n * size), (">" if h["big_endian"] else "<") + kind).astype(float)
                if camera_bits:
                    m = (1 << camera_bits) - 1
                    v = np.where(v > m, v - m, v)
                yield pd.DataFrame({"file": file, "tile": np.arange(first, first + count), "width": h["width"], "height": h["height"], "values": list(v.reshape(count, n))})

    found = headers(spark, path).where("tiles > 0")
    several = F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / (8 * F.col("width") * F.col("height")))).cast("int")
    each = found.select("file", "tiles", several.alias("several")).select("file", "tiles", "several", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1, F.col("several"))).alias("first"))
    each = each.select("file", "first", F.least(F.col("several"), F.col("tiles") - F.col("first")).alias("count"))
    return each.repartition("file", "first").mapInPandas(read, "file string, tile int, width int, height int, values array<double>")


def mosaic_positions(rows: DataFrame) -> DataFrame:
    """Tile positions by stage, moved to the stack's origin."""
    from tessera.operators.aggregates import to_zero_origin

    return to_zero_origin(rows.select("file", "tile", F.col("pixel_x").alias("x"), F.col("pixel_y").alias("y")), ["file"])


def grid_positions(rows: DataFrame, columns: str, width: str, height: str, overlap: float) -> DataFrame:
    """Positions of tiles counted along a montage grid of `columns`: (n div columns, n mod columns), each apart by its size
    less the overlap."""
    n = F.col("tile")
    return rows.withColumn("x", F.floor(n / F.col(columns)) * F.col(width) * (1 - overlap)).withColumn("y", (n % F.col(columns)) * F.col(height) * (1 - overlap))


def packed(width: int, height: int, values: np.ndarray, pieces: np.ndarray, nm_per_pixel: float = 1.0) -> bytes:
    """A stack of 4-byte floats, tile by tile, with the tiles' piece coordinates (x, y, z)."""
    head = bytearray(HEADER_BYTES)
    n = len(values)
    struct.pack_into("<4I", head, 0, width, height, n, 2)
    struct.pack_into("<3I3f", head, 0x1C, width, height, max(1, n), width * nm_per_pixel * 10, height * nm_per_pixel * 10, 1.0)
    struct.pack_into("<3I", head, 0x40, 1, 2, 3)
    if n:
        struct.pack_into("<3f", head, 0x4C, values.min(), values.max(), values.mean())
    struct.pack_into("<I", head, 0x5C, 6 * n)
    struct.pack_into("<2H", head, 0x80, 6, PIECE)
    head[0xD4] = 68
    return bytes(head) + pieces.astype("<u2").tobytes() + values.astype("<f4").tobytes()


def written(tiles: DataFrame, folder: str) -> DataFrame:
    """(file, tiles) of stacks written to folder/(stack).mrc from tiles (stack, tile, width, height, values, piece_x, piece_y),
    one task a stack, each file replaced as a whole. Tiles are in order of their number."""
    ship(tiles.sparkSession)

    def write(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("tile")
        pieces = np.stack((f["piece_x"], f["piece_y"], np.zeros(len(f))), 1)
        uri = f"{folder.rstrip('/')}/{f['stack'].iloc[0]}.mrc"
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(packed(int(f["width"].iloc[0]), int(f["height"].iloc[0]), np.array([np.asarray(v, np.float32) for v in f["values"]]), pieces))
        return pd.DataFrame({"file": [uri], "tiles": [len(f)]})

    return tiles.groupBy("stack").applyInPandas(write, "file string, tiles long")
