"""Text sinks, and tables as HTML."""

from __future__ import annotations

import html as _html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prune_score_lines(scores: DataFrame) -> DataFrame:
    """(value): "tile<tab>score", by tile."""
    return scores.orderBy("tile").select(F.concat_ws("\t", "tile", F.col("score").cast("string")).alias("value"))


def override_lines(overrides: DataFrame) -> DataFrame:
    """(value): "section min max gamma", by section."""
    return overrides.orderBy("section").select(F.concat_ws(" ", *[F.col(x).cast("string") for x in ("section", "min", "max", "gamma")]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in the order of the lines."""
    lines.coalesce(1).write.text(path)


def tileset_info_xml(rows: DataFrame) -> Column:
    a = lambda n, c: F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))
    return F.concat(F.lit('<?xml version="1.0"?><Level'), a("GridDimX", "grid_x"), a("GridDimY", "grid_y"), a("TileDimX", "tile_x"), a("TileDimY", "tile_y"), a("FilePrefix", "prefix"), a("FilePostfix", "postfix"), a("Downsample", "downsample"), F.lit("/>"))


def table_report(rows: DataFrame, row: str, column: str, cell: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each label and a column for each kind, cells' texts joined in order."""
    grouped = rows.groupBy(row)
    pivot = grouped.pivot(column, columns) if columns else grouped.pivot(column)
    return pivot.agg(F.array_join(F.array_sort(F.collect_list(cell)), "; "))


def html_table(header: list[str], rows: Iterable[Iterable[object]]) -> str:
    cell = lambda v: "" if v is None else _html.escape(str(v))
    head = "".join(f"<th>{cell(h)}</th>" for h in header)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_report(report: DataFrame, row: str) -> str:
    """A report as a page, rows by falling label. A report is what a person reads; it's put together on the driver."""
    rows = report.orderBy(F.desc(row)).collect()
    return f"<html><body>{html_table(report.columns, [list(r) for r in rows])}</body></html>"


def export_document(sections: DataFrame, transforms: DataFrame, tilesets: DataFrame) -> DataFrame:
    """(section, document): a JSON document for each section with its transforms and tilesets in order, and their numbers."""
    nest = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
    joined = sections.join(nest(transforms, "section", "transforms"), "section", "left").join(nest(tilesets, "section", "tilesets"), "section", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return joined.withColumn("num_transforms", size("transforms")).withColumn("num_tilesets", size("tilesets")).select("section", F.to_json(F.struct("*")).alias("document"))


def exported_edges(edges: DataFrame, transforms: DataFrame, order: list, on: tuple[str, ...] = ("control", "mapped")) -> tuple[DataFrame, DataFrame]:
    """Edges with the first transform of theirs, and those that have none. Where a transform is for all edges of one side, `on`
    names it: the first is taken before transforms meet edges, so that they're never paired with all of a section's edges."""
    from tessera.operators.select import first_match

    first = first_match(transforms, [*on], order)
    return edges.join(first, [*on]), edges.join(first, [*on], "left_anti")


def folder_index(files: DataFrame, required: list[str]) -> DataFrame:
    """(folder, files) of folders that have all required names, by falling folder."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), base.alias("name"))
    found = rows.groupBy("folder").agg(F.array_sort(F.collect_set("name")).alias("files"))
    return found.where(F.size(F.array_intersect("files", F.array(*[F.lit(r) for r in required]))) == len(required)).orderBy(F.desc("folder"))


def attribute_rows(elements: DataFrame, hidden: tuple[str, ...] = ("CreationDate", "Version", "Checksum")) -> DataFrame:
    """(id, label, value): an element's attributes as a reader's table, numbers with at most four places."""
    rows = elements.select("id", F.explode("attrs").alias("label", "value")).where(~F.col("label").isin(*hidden))
    number = F.col("value").try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", number), "0+$", ""), "[.]$", "")
    return rows.withColumn("value", F.when(number.isNotNull() & F.contains("value", F.lit(".")), short).otherwise(F.col("value")))


def anchor(path: Column, text: Column) -> Column:
    """A link to a file."""
    from tessera.functions.scalar import html_escaped

    return F.concat(F.lit('<a href="'), html_escaped(F.replace(path, F.lit(" "), F.lit("%20"))), F.lit('">'), html_escaped(text), F.lit("</a>"))


def image_tag(path: Column, width: Column, height: Column, most_width: float, most_height: float) -> Column:
    """An image within limits, linked to itself."""
    from tessera.functions.scalar import fitted, html_escaped

    size = fitted(width, height, most_width, most_height)
    src = html_escaped(F.replace(path, F.lit(" "), F.lit("%20")))
    return F.concat(F.lit('<a href="'), src, F.lit('"><img src="'), src, F.format_string('" width="%d" height="%d"/></a>', size["width"].cast("long"), size["height"].cast("long")))


def copied_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, target) of files copied into a folder by the tasks that hold their rows, under their own names. An existing
    target is replaced as a whole, so a repeated task does no harm."""
    from collections.abc import Iterator

    import pandas as pd
    from pyarrow import fs

    from tessera.shipping import ship

    ship(files.sparkSession)

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            targets = [f"{folder.rstrip('/')}/{p.rsplit('/', 1)[-1]}" for p in f["path"]]
            for source, target in zip(f["path"], targets):
                a, x = fs.FileSystem.from_uri(source)
                b, y = fs.FileSystem.from_uri(target)
                b.create_dir(y.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(x, y, source_filesystem=a, destination_filesystem=b)
            yield pd.DataFrame({"path": f["path"], "target": targets})

    return files.select("path").mapInPandas(copy, "path string, target string")
