"""Images and viewer documents as files that other programs read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import tile_name
from tessera.shipping import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(values: np.ndarray) -> bytes:
    """A grey image of 8 or 16 bits as a PNG file."""
    bits = 8 * values.dtype.itemsize
    rows = np.ascontiguousarray(values.astype(f">u{bits // 8}")).view(np.uint8).reshape(len(values), -1)
    body = np.hstack((np.zeros((len(rows), 1), np.uint8), rows)).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", values.shape[1], len(values), bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 1)) + chunk(b"IEND", b"")


def parsed_png(data: bytes) -> np.ndarray:
    """The values of a grey image as `png` writes it."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, parts, width, height, bits = len(SIGNATURE), [], 0, 0, 8
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum doesn't match")
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">2I5B", body)
            if colour or interlaced or bits not in (8, 16):
                raise ValueError("not a plain grey image of 8 or 16 bits")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, -1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(rows[:, 1:]).view(f">u{bits // 8}").reshape(height, width).astype(f"u{bits // 8}")


def contrasted(v: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    """Values over `high` are taken for overflow and halved; then `low` is taken off if it's over 0, and `high` scaled to the
    most that the bits hold. What falls outside is put at the nearest end."""
    top = (1 << bits) - 1
    v = np.where(v > high, v / 2, v) - max(low, 0.0)
    return np.clip(np.round(v * (top / high)), 0, top)


def exported_images(tiles: DataFrame, folder: str, bits: int = 16, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(file, tile, path) of the tiles (file, tile, width, height, values) written as grey PNG files to folder/(name of the
    file)/(number of the tile).png by the tasks that hold them. Without `high` values are written as they are. An existing
    image is replaced as a whole, so a repeated task does no harm."""
    ship(tiles.sparkSession)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for f in frames:
            for path, width, values in zip(f["path"], f["width"], f["values"]):
                v = np.asarray(values, float).reshape(-1, width)
                v = np.clip(v, 0, (1 << bits) - 1) if high is None else contrasted(v, low, high, bits)
                name = f"{root}/{path}"
                if (above := name.rsplit("/", 1)[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(name) as out:
                    out.write(png(v.astype(f"u{bits // 8}")))
            yield pd.DataFrame({"file": f["file"], "tile": f["tile"], "path": folder.rstrip("/") + "/" + f["path"]})

    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = tiles.select("file", "tile", "width", "values", F.concat_ws("/", stem, tile_name("tile")).alias("path"))
    return named.mapInPandas(write, "file string, tile int, path string")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, values) of grey PNG files."""
    ship(spark)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            images = [parsed_png(bytes(x)) for x in f["content"]]
            yield pd.DataFrame({"path": f["path"], "width": [x.shape[1] for x in images], "height": [len(x) for x in images], "values": [x.reshape(-1).tolist() for x in images]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, width int, height int, values array<int>")


def images_at(files: DataFrame) -> DataFrame:
    """(path, width, height, values) of the grey PNG files named by `path`, opened by the tasks that hold the names: no folder is listed."""
    ship(files.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            images = []
            for path in f["path"]:
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as found:
                    images.append(parsed_png(found.read()))
            yield pd.DataFrame({"path": f["path"], "width": [x.shape[1] for x in images], "height": [len(x) for x in images], "values": [x.reshape(-1).tolist() for x in images]})

    return files.select("path").mapInPandas(read, "path string, width int, height int, values array<int>")


def viewer_sections(elements: DataFrame, images: DataFrame) -> DataFrame:
    """(number, document): what a viewer needs of each section, as XML: its transforms, pyramids, tilesets and notes, with
    paths that start at the section.

    images: (id, image), the first tile's file name of each transform; a transform without one is left out. One section is
    put together by one task.
    """
    from tessera.plans.paths import nearest_ancestor

    ship(elements.sparkSession)
    sections = elements.where("tag = 'Section'")
    blocks = elements.select(F.col("id").alias("parent"), F.coalesce(F.try_element_at("attrs", F.lit("Path")), F.lit("")).alias("block"))
    inside = nearest_ancestor(elements, "Section").withColumnRenamed("ancestor", "section").unionByName(sections.select("id", F.col("id").alias("section")))
    rows = elements.join(inside, "id").join(images, "id", "left").join(blocks, "parent", "left").select("section", "id", "parent", "ord", "tag", "attrs", "text", "image", "block")

    def document(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ord")
        attrs = {i: dict(a) if a is not None else {} for i, a in zip(f["id"], f["attrs"])}
        text, image, tag = (dict(zip(f["id"], f[x])) for x in ("text", "image", "tag"))
        below: dict[str, list[str]] = {}
        for i, p in zip(f["id"], f["parent"]):
            below.setdefault(p, []).append(i)
        of = lambda parent, name: [i for i in below.get(parent, []) if tag[i] == name]
        join = lambda *parts: "/".join(x for x in parts if x)
        root = f["section"].iloc[0]
        mine = attrs[root]
        out = ElementTree.Element("Section", {"Number": mine.get("Number", ""), "Path": join(f.loc[f["id"] == root, "block"].iloc[0], mine.get("Path")), "Name": mine.get("Name", "")})

        def note(i: str) -> None:
            ElementTree.SubElement(out, "Notes").text = text[i]

        for channel in of(root, "Channel"):
            at = attrs[channel]
            scales = [attrs[x] for s in of(channel, "Scale") for x in of(s, "X")]
            for t in of(channel, "Transform"):
                if not isinstance(image[t], str):
                    continue
                parts = image[t].split(".")
                name = attrs[t].get("Name", "")
                ElementTree.SubElement(out, "Transform", {"Name": name, "Path": join(at.get("Path"), attrs[t].get("Path")), "FilePrefix": parts[0] if len(parts) == 3 else "", "FilePostfix": parts[-1], "UseForVolume": "true" if "grid" in name.lower() else "false"})
            for filter_ in of(channel, "Filter"):
                label = f"{at.get('Name', '')}.{attrs[filter_].get('Name', '')}"
                for kind, made, first, keys, level_keys in (
                    ("TilePyramid", "Pyramid", {"Name": f"{label}.Pyramid"}, ("LevelFormat",), ()),
                    ("Tileset", "Tileset", {"name": label}, ("TileXDim", "TileYDim", "FilePrefix", "FilePostfix", "CoordFormat"), ("GridDimX", "GridDimY")),
                ):
                    path = "path" if kind == "Tileset" else "Path"
                    for i in of(filter_, kind):
                        node = ElementTree.SubElement(out, made, first | {path: join(at.get("Path"), attrs[filter_].get("Path"), attrs[i].get("Path"))} | {k: attrs[i].get(k, "") for k in keys})
                        for level in sorted(of(i, "Level"), key=lambda x: float(attrs[x].get("Downsample", 0))):
                            ElementTree.SubElement(node, "Level", {path: attrs[level].get("Path", ""), "Downsample": f"{float(attrs[level].get('Downsample', 0)):g}"} | {k: attrs[level].get(k, "") for k in level_keys})
                        for s in scales[:1]:
                            ElementTree.SubElement(ElementTree.SubElement(node, "Scale"), "X", {k: s.get(k, "") for k in ("UnitsOfMeasure", "UnitsPerPixel")})
            for i in of(channel, "Notes"):
                note(i)
        for i in of(root, "Notes"):
            note(i)
        return pd.DataFrame({"number": [int(mine["Number"]) if mine.get("Number") else None], "document": [ElementTree.tostring(out, encoding="unicode")]}).astype({"number": "Int32"})

    return rows.groupBy("section").applyInPandas(document, "number int, document string")


def viewer_document(sections: DataFrame, edges: DataFrame, name: str, checksum: str = "", host: str | None = None, units: str | None = None, per_pixel: float | None = None) -> str:
    """One document of viewer_sections and the slice-to-slice transforms (control, mapped, path, type), with their numbers.
    It is put together on the driver, as any single file is."""
    parts = [r["document"] for r in sections.orderBy("number").select("document").collect()]
    links = edges.orderBy("mapped", "control", "path").collect()
    root = ElementTree.Element("Volume", {"Name": name, "num_stos": str(len(links)), "num_sections": str(len(parts)), "InputChecksum": checksum} | ({"host": host} if host else {}))
    if units is not None:
        ElementTree.SubElement(ElementTree.SubElement(root, "Scale"), "X", {"UnitsOfMeasure": units, "UnitsPerPixel": str(per_pixel)})
    root.extend(ElementTree.fromstring(p) for p in parts)
    for r in links:
        ElementTree.SubElement(root, "stos", {"controlSection": str(r["control"]), "mappedSection": str(r["mapped"]), "path": r["path"], "type": r["type"]})
    return ElementTree.tostring(root, encoding="unicode")
