"""Metadata trees: XML documents as a table of elements, and back.

A container's file holds stubs "<Tag_Link Path=... >" for the containers below it, whose files are read with it when a
whole volume is loaded; a stub's attributes are known without its file.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

TYPES = "file string, id string, parent string, ord long, depth int, tag string, attrs map<string,string>, text string"


def parsed(texts: DataFrame) -> DataFrame:
    """(file, id, parent, ord, depth, tag, attrs, text) of XML texts (file, text), one row for each element. An id is the
    file and the element's place in it. A malformed file has no rows."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for file, text in zip(f["file"], f["text"]):
                try:
                    root = ElementTree.fromstring(text)
                except (ElementTree.ParseError, TypeError):
                    continue
                stack, n = [(root, None, 0)], 0
                while stack:
                    e, parent, depth = stack.pop()
                    me = f"{file}#{n}"
                    rows.append((file, me, parent, n, depth, e.tag, dict(e.attrib), (e.text or "").strip() or None))
                    n += 1
                    stack += [(x, me, depth + 1) for x in reversed(list(e))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TYPES.replace("map<string,string>", "map").split(", ")])

    ship(texts.sparkSession)
    return texts.select("file", "text").mapInPandas(walk, TYPES)


def load(spark: SparkSession, folder: str, name: str = "VolumeData.xml", legacy: str = "Volume.xml") -> DataFrame:
    """All elements of a volume's folder, containers' files joined at their stubs. A stub without a file goes."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{name},{legacy}}}").text(folder)
    texts = whole.select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), "^file:/+", "/").alias("file"), F.col("value").alias("text"))
    return linked(parsed(texts))


def linked(elements: DataFrame) -> DataFrame:
    """Each stub replaced by the root element of the folder that it names: the root's parent is the stub's, its place the stub's."""
    is_link = F.col("tag").endswith("_Link")
    links = elements.where(is_link).select(F.concat_ws("/", "file", F.try_element_at("attrs", F.lit("Path"))).alias("_folder"), F.col("parent").alias("_parent"), F.col("ord").alias("_ord"))
    heads = elements.where((F.col("depth") == 0) & ~is_link).join(links, F.col("file") == F.col("_folder"), "left")
    heads = heads.withColumn("parent", F.coalesce("_parent", "parent")).withColumn("ord", F.coalesce("_ord", "ord")).select(*elements.columns)
    return heads.unionByName(elements.where((F.col("depth") > 0) & ~is_link))


def unlinked(elements: DataFrame) -> DataFrame:
    """(folder, tag, path, attrs): the stub that each folder lacks for a container below it whose file is there: what a
    volume's files have lost. Of parsed elements, before they are linked; the topmost folder needs none."""
    at = F.try_element_at("attrs", F.lit("Path"))
    is_link = F.col("tag").endswith("_Link")
    known = elements.where(is_link).select(F.concat_ws("/", "file", at).alias("file"))
    heads = elements.where((F.col("depth") == 0) & ~is_link)
    above = heads.select(F.col("file").alias("folder"))
    lost = heads.join(known, "file", "left_anti").withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    return lost.join(above, "folder", "left_semi").select("folder", F.concat("tag", F.lit("_Link")).alias("tag"), F.regexp_extract("file", "([^/]*)$", 1).alias("path"), "attrs")


def sorted_elements(elements: DataFrame) -> DataFrame:
    """Siblings in their saved order: keyed classes by number or name, then links by path, then all others."""
    a = lambda n: F.try_element_at("attrs", F.lit(n))
    number = F.coalesce(a("Number").try_cast("int"), a("Downsample").try_cast("double").cast("int"))
    key = F.coalesce(F.format_string("%04d", number), a("Name"), a("Path"), F.lit(""))
    rank = F.when(number.isNotNull() | a("Name").isNotNull(), 0).when(F.col("tag").endswith("_Link"), 1).otherwise(2)
    return elements.withColumn("sort_rank", rank).withColumn("sort_key", key).orderBy("parent", "sort_rank", "tag", "sort_key", "ord")


def as_xml(elements: DataFrame) -> str:
    """A volume as one document. It is put together on the driver, as any single file is."""
    rows = elements.select("id", "parent", "ord", "tag", "attrs", "text").orderBy("ord").collect()
    made = {r["id"]: ElementTree.Element(r["tag"], dict(sorted((r["attrs"] or {}).items()))) for r in rows}
    roots = []
    for r in rows:
        made[r["id"]].text = r["text"]
        (made[r["parent"]].append if r["parent"] in made else roots.append)(made[r["id"]])
    if len(roots) != 1:
        raise ValueError(f"a document has one root, not {len(roots)}")
    return ElementTree.tostring(roots[0], encoding="unicode")


def save(elements: DataFrame, path: str, by: list[str] = []) -> None:
    """Elements as Parquet, in folders by the columns `by`, so that a reader opens only those it asks for."""
    writer = elements.write
    (writer.partitionBy(*by) if by else writer).parquet(path)


def saved(elements: DataFrame, folder: str, name: str = "VolumeData.xml") -> DataFrame:
    """(path, elements) of the files written: one for each container, in its folder, with a stub of each container below it.

    A container is an element with a Path that isn't a stub itself; the root's folder is `folder`, whatever its Path. `load`
    gives the same tree back. Files are written by the tasks that hold their containers, each replaced as a whole.
    """
    from tessera.operators.graph import to_roots
    from tessera.plans.paths import full_paths

    ship(elements.sparkSession)
    path = F.try_element_at("attrs", F.lit("Path"))
    rows = elements.select("id", "parent", "ord", "tag", "attrs", "text", (path.isNotNull() & (path != "") & ~F.col("tag").endswith("_Link") | F.col("parent").isNull()).alias("holds"), path.alias("path"))
    # the nearest container at or above each element, and each container's folder by its chain of containers
    own = rows.where("holds").select(F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"))
    owner = to_roots(own.unionByName(rows.where("not holds").select(F.col("id").alias("node"), "parent"))).select(F.col("node").alias("id"), F.col("root").alias("owner"))
    owned = rows.join(owner, "id", "left").withColumn("owner", F.coalesce("owner", "id"))
    above = owned.select(F.col("id").alias("parent"), F.col("owner").alias("inside"))
    placed = owned.join(above, "parent", "left")
    chain = placed.where("holds").select("id", "path", F.col("inside").alias("parent"))
    step = F.create_map(F.lit("Path"), F.when(F.col("parent").isNotNull(), F.col("path")).otherwise(F.lit("")))
    folders = full_paths(chain.select("id", "parent", F.lit("").alias("tag"), step.alias("attrs"))).withColumnRenamed("id", "owner")
    members = placed.select("owner", "id", "parent", "ord", "tag", "attrs", "text", F.lit(False).alias("stub"))
    stubs = placed.where("holds and inside is not null").select(F.col("inside").alias("owner"), "id", "parent", "ord", F.concat("tag", F.lit("_Link")).alias("tag"), "attrs", F.lit(None).cast("string").alias("text"), F.lit(True).alias("stub"))
    files = members.unionByName(stubs).join(folders, "owner", "left")

    def write(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ord", "stub"])
        made = {}
        for i, stub, tag, attrs, text in zip(f["id"], f["stub"], f["tag"], f["attrs"], f["text"]):
            made[i, stub] = ElementTree.Element(tag, dict(sorted(dict(attrs or {}).items())))
            made[i, stub].text = text
        for i, stub, parent in zip(f["id"], f["stub"], f["parent"]):
            if (parent, False) in made:
                made[parent, False].append(made[i, stub])
        at = f["full_path"].iloc[0]
        system, root = fs.FileSystem.from_uri("/".join(x for x in (folder.rstrip("/"), at) if isinstance(x, str) and x))
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(ElementTree.tostring(made[f["owner"].iloc[0], False], encoding="utf-8"))
        return pd.DataFrame({"path": [f"{root}/{name}"], "elements": [len(f)]})

    return files.groupBy("owner").applyInPandas(write, "path string, elements long")
