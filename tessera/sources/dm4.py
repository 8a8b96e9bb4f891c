"""Tagged image files of the version 4 layout: a tree of typed tags, flattened to paths.

Names and sizes are big endian; values have the byte order that the header names. Arrays of more than `limit` numbers (the
pixels) are not read with the tags but kept as an offset, and read by the tasks that need them.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Codes of simple types.
SIMPLE = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "i1", 9: "i1", 10: "i1", 11: "i8", 12: "u8"}
#: Codes of pixel types.
PIXELS = {1: "i2", 2: "f4", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8"}


class _Reader:
    def __init__(self, f, limit: int) -> None:
        self.f, self.limit, self.tags = f, limit, {}

    def big(self, kind: str):
        return struct.unpack(">" + kind, self.f.read(struct.calcsize(">" + kind)))

    def read(self) -> dict[str, object]:
        version, _, little = self.big("iqi")
        if version != 4:
            raise ValueError(f"version {version} isn't 4")
        self.order = "<" if little else ">"
        self.folder("")
        return self.tags

    def folder(self, path: str) -> None:
        _, _, n = self.big("bbq")
        for k in range(n):
            kind, size = self.big("BH")
            name = self.f.read(size).decode("latin-1") or f"[{k}]"
            (total,) = self.big("q")
            begin = self.f.tell()
            here = f"{path}/{name}" if path else name
            if kind == 20:
                self.folder(here)
            elif kind == 21:
                self.value(here)
            else:
                raise ValueError(f"tag {here} has the kind {kind}")
            self.f.seek(begin + total)

    def value(self, path: str) -> None:
        if self.f.read(4) != b"%%%%":
            raise ValueError(f"tag {path} has no value mark")
        (n,) = self.big("q")
        info = self.big(f"{n}q")
        self.tags[path] = self.typed(list(info), path)

    def typed(self, info: list[int], path: str):
        kind = info[0]
        if kind in SIMPLE:
            t = np.dtype(self.order + SIMPLE[kind])
            return np.frombuffer(self.f.read(t.itemsize), t)[0].item()
        if kind == 15:
            return [self.typed([info[4 + 2 * k]], path) for k in range(info[2])]
        if kind == 18:
            return self.f.read(2 * info[1]).decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace")
        if kind == 20 and info[1] in SIMPLE:
            t, n = np.dtype(self.order + SIMPLE[info[1]]), info[-1]
            if n > self.limit:
                self.tags[path + "@offset"], self.tags[path + "@count"] = self.f.tell(), n
                return None
            v = np.frombuffer(self.f.read(n * t.itemsize), t)
            return v.astype(self.order + "u2").tobytes().decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace") if info[1] == 4 and n else v.tolist()
        if kind == 20 and info[1] == 15:
            return [self.typed([15, *info[2:-1]], path) for _ in range(min(info[-1], self.limit))]
        raise ValueError(f"tag {path} has the type {kind}")


def tags_of(data: bytes, limit: int = 4096) -> dict[str, object]:
    """Tag paths, "/" between names, "[k]" for unnamed ones, to values."""
    return _Reader(io.BytesIO(data), limit).read()


def _open(file: str):
    system, name = fs.FileSystem.from_uri(file)
    return system.open_input_file(name)


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(file, tags): all tags of each file as text; pixels are left where they are."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file in f["file"]:
                with _open(file) as g:
                    found = _Reader(g, 4096).read()
                yield pd.DataFrame({"file": [file], "tags": [{k: str(v) for k, v in found.items() if v is not None}]})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.mapInPandas(read, "file string, tags map<string,string>")


IMAGE = "ImageList/[1]/ImageData"


def images(rows: DataFrame, image: str = IMAGE) -> DataFrame:
    """(file, width, height, pixel_type, bits, scale_x, scale_y, unit, grid_x, grid_y, overlap) of tag rows: typed lookups."""
    t = lambda p: F.try_element_at("tags", F.lit(p))
    montage = "ImageList/[1]/ImageTags/Montage/Acquisition"
    return rows.select(
        "file",
        t(f"{image}/Dimensions/[0]").try_cast("int").alias("width"),
        t(f"{image}/Dimensions/[1]").try_cast("int").alias("height"),
        t(f"{image}/DataType").try_cast("int").alias("pixel_type"),
        (t(f"{image}/PixelDepth").try_cast("int") * 8).alias("bits"),
        t(f"{image}/Calibrations/Dimension/[0]/Scale").try_cast("double").alias("scale_x"),
        t(f"{image}/Calibrations/Dimension/[1]/Scale").try_cast("double").alias("scale_y"),
        t(f"{image}/Calibrations/Dimension/[0]/Units").alias("unit"),
        t(f"{montage}/Number of X Steps").try_cast("int").alias("grid_x"),
        t(f"{montage}/Number of Y Steps").try_cast("int").alias("grid_y"),
        (t(f"{montage}/Overlap between images (%)").try_cast("double") / 100).alias("overlap"),
    )


def pixels(spark: SparkSession, path: str, image: str = IMAGE) -> DataFrame:
    """(file, width, height, values): row-major values of each file's image."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file in f["file"]:
                with _open(file) as g:
                    reader = _Reader(g, 0)
                    found = reader.read()
                    w, h = found[f"{image}/Dimensions/[0]"], found[f"{image}/Dimensions/[1]"]
                    kind = np.dtype(reader.order + PIXELS[found[f"{image}/DataType"]])
                    v = np.frombuffer(g.read_at(w * h * kind.itemsize, found[f"{image}/Data@offset"]), kind)
                yield pd.DataFrame({"file": [file], "width": [w], "height": [h], "values": [v.astype(float).tolist()]})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.mapInPandas(read, "file string, width int, height int, values array<double>")
