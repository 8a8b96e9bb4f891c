"""Text inputs as tables. Files are read whole, so that a file's lines keep their order, and many files in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all files of a path or glob."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(whole.withColumnRenamed("value", "text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """The same of a table (file, text)."""
    split = F.posexplode(F.split("text", "\r?\n"))
    return texts.select("file", split.alias("line_no", "line")).select("file", "line_no", F.trim(F.replace("line", F.lit("\t"), F.lit(" "))).alias("line"))


# Capture files: header lines, then a group of lines for each [Image = name]


def idoc_entries(texts: DataFrame) -> DataFrame:
    """(file, ordinal, image, line_no, name, values): the lines "name = values" of each tile; ordinal -1 is the header.

    Only values that begin with a digit or a minus sign count.
    """
    entry = F.regexp_extract("line", r"^\[?([^=\]]*?)\s*=\s*([^=\]]*?)\s*\]?$", 1)
    value = F.regexp_extract("line", r"^\[?([^=\]]*?)\s*=\s*([^=\]]*?)\s*\]?$", 2)
    rows = lines_of(texts).where(F.contains("line", F.lit("="))).select("file", "line_no", entry.alias("name"), value.alias("value"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("ordinal", F.count_if(F.col("name") == "Image").over(w).cast("int") - 1).withColumn("image", F.last(F.when(F.col("name") == "Image", F.col("value")), True).over(w))
    return grouped.where((F.col("name") != "Image") & F.col("value").rlike("^[-0-9]")).select("file", "ordinal", "image", "line_no", "name", F.split("value", r"\s+").alias("values"))


HEADER = {"DataMode": "int", "PixelSpacing": "double", "ImageSize": "array<int>", "ImageSeries": "int", "Montage": "int"}
TILE = {"TiltAngle": "double", "PieceCoordinates": "array<int>", "StagePosition": "array<double>", "Intensity": "double", "ExposureDose": "double", "SpotSize": "int", "Defocus": "double", "ImageShift": "array<double>", "RotationAngle": "double", "ExposureTime": "double", "MinMaxMean": "array<double>", "TargetDefocus": "double", "Magnification": "double"}


def _typed(name: str, kind: str) -> Column:
    """The last value of a name in a group, typed."""
    value = F.max_by(F.when(F.col("name") == name, F.col("values")), F.when(F.col("name") == name, F.col("line_no")))
    if kind.startswith("array"):
        inner = kind[6:-1]
        return F.transform(value, lambda x: x.try_cast("double").try_cast(inner)).alias(name)
    return F.get(value, F.lit(0)).try_cast("double").try_cast(kind).alias(name)


def idoc(texts: DataFrame, camera_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Header rows and tile rows of capture texts (file, text). With camera_bits, tiles' maxima are at most 2^bits."""
    entries = idoc_entries(texts)
    header = entries.where("ordinal = -1").groupBy("file").agg(*[_typed(n, k) for n, k in HEADER.items()])
    tiles = entries.where("ordinal >= 0").groupBy("file", "ordinal", F.col("image").alias("Image")).agg(*[_typed(n, k) for n, k in TILE.items()])
    if camera_bits:
        top = F.lit(float(1 << camera_bits))
        m = F.col("MinMaxMean")
        tiles = tiles.withColumn("MinMaxMean", F.when(F.size(m) == 3, F.array(m[0], F.least(m[1], top), m[2])).otherwise(m))
    return header, tiles


def numbered_tiles(tiles: DataFrame, extension: str = "png") -> DataFrame:
    """Target names and positions: numbered from 0 in the file's order, missing inputs included."""
    from tessera.functions.scalar import tile_name

    return tiles.withColumn("target", tile_name("ordinal", extension)).withColumn("x", F.get("PieceCoordinates", F.lit(0))).withColumn("y", F.get("PieceCoordinates", F.lit(1)))


def idoc_of_mdoc(texts: DataFrame) -> DataFrame:
    """[ZValue = n] lines as [Image = n.tif]."""
    return texts.withColumn("text", F.regexp_replace("text", r"(?m)^\s*\[ZValue\s*=\s*(-?\d+)\s*\]\s*$", "[Image = $1.tif]"))


def capture_attributes(header: DataFrame, tiles: DataFrame) -> DataFrame:
    """(file, attrs): the header's single values and the first tile's, without its defocus."""
    texts = lambda names: F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    head = header.select("file", F.map_from_entries(texts([n for n, k in HEADER.items() if not k.startswith("array")])).alias("h"))
    first = tiles.where("ordinal = 0").select("file", F.map_from_entries(texts([n for n, k in TILE.items() if not k.startswith("array") and n != "Defocus"])).alias("t"))
    none = F.create_map().cast("map<string,string>")
    return head.join(first, "file", "full").select("file", F.map_concat(F.coalesce("h", none), F.coalesce("t", none)).alias("attrs"))


# Acquisition logs


def log_lines(texts: DataFrame) -> DataFrame:
    """(file, line_no, time, entry): lines with their leading "seconds:" taken off."""
    stamp = F.regexp_extract("line", r"^(\d+(?:\.\d*)?):", 1)
    return lines_of(texts).where("line <> ''").select("file", "line_no", "line", F.nullif(stamp, F.lit("")).cast("double").alias("time"), F.trim(F.regexp_replace("line", r"^\d+(?:\.\d*)?:\s*", "")).alias("entry"))


def acquisition_log(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header (version, startup, properties version, montage start and end), tiles and drift stamps of logs (file, text).

    A piece begins with each DoNextPiece line; a capture ends the piece before, whose image the next SaveImage line saves.
    The stage stopped at the last "finished stage move" of a piece; one without it, as the first is, at the autofocus's
    start. A drift stamp is the time from there to the last autofocus's start. Of pieces saved under one number the last
    counts. Without "Montage Done" a log ends with its last time.
    """
    rows = log_lines(texts)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda p: F.col("entry").startswith(p)
    header = rows.groupBy("file").agg(
        F.max_by(F.when(is_("SerialEM Version"), F.trim(F.substring("entry", 17, 1000))), F.when(is_("SerialEM Version"), F.col("line_no"))).alias("version"),
        F.max_by(F.when(is_("Started"), F.trim(F.substring("entry", 8, 1000))), F.when(is_("Started"), F.col("line_no"))).alias("startup"),
        F.max_by(F.when(is_("Last update properties file"), F.trim(F.regexp_replace("line", "^[^:]*:", ""))), F.when(is_("Last update properties file"), F.col("line_no"))).alias("properties_version"),
        F.max_by(F.when(is_("Montage Start"), F.col("time")), F.when(is_("Montage Start"), F.col("line_no"))).alias("montage_start"),
        F.coalesce(F.max_by(F.when(is_("Montage Done"), F.col("time")), F.when(is_("Montage Done"), F.col("line_no"))), F.max_by("time", F.when(F.col("time").isNotNull(), F.col("line_no")))).alias("montage_end"),
    )
    piece, capture = is_("DoNextPiece"), is_("DoNextPiece") & F.contains("entry", F.lit("capture"))
    rows = rows.withColumn("piece", F.count_if(piece).over(w)).withColumn("focus", F.last(F.when(is_("Autofocus Start"), F.col("time")), True).over(w))
    rows = rows.withColumn("acquired", F.last(F.when(capture, F.col("piece") - 1), True).over(w))
    within = Window.partitionBy("file", "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    measured, stopped = is_("Measured defocus"), F.col("entry").endswith("finished stage move")
    rows = rows.withColumn("moved", F.last(F.when(stopped, F.col("time")), True).over(within)).withColumn("first_focus", F.first(F.when(measured, F.col("focus")), True).over(within))
    drift = F.regexp_extract("entry", r"drift\s*=\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(\S+)", 1)
    stamps = rows.where(measured & (drift != "") & (F.col("piece") > 0)).select("file", "piece", "line_no", (F.col("focus") - F.coalesce("moved", "first_focus")).alias("since_stop"), drift.cast("double").alias("drift"), F.regexp_extract("entry", r"drift\s*=\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(\S+)", 2).alias("units"))
    pieces = rows.where("piece > 0").groupBy("file", "piece").agg(F.max(F.when(piece, F.col("time"))).alias("start_time"), F.max_by("moved", "line_no").alias("moved"), F.max_by("first_focus", "line_no").alias("first_focus"))
    ends = rows.where(capture & (F.col("piece") > 1)).groupBy("file", (F.col("piece") - 1).alias("piece")).agg(F.max("time").alias("end_time"))
    saving = is_("SaveImage Saving")
    number = F.regexp_extract("line", r"=\s*(-?\d+)", 1).try_cast("int")
    saves = rows.where(saving & number.isNotNull() & (F.col("acquired") > 0)).select("file", F.col("acquired").alias("piece"), "line_no", number.alias("number"), F.regexp_extract("line", r"\bat\s+(-?\d+)\s+(-?\d+)", 1).try_cast("int").alias("x"), F.regexp_extract("line", r"\bat\s+(-?\d+)\s+(-?\d+)", 2).try_cast("int").alias("y"))
    last = Window.partitionBy("file", "number").orderBy(F.desc("line_no"))
    saves = saves.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "line_no")
    units = stamps.groupBy("file", "piece").agg(F.max_by("units", "line_no").alias("drift_units"), F.max_by("drift", "line_no").alias("drift"), F.max_by("since_stop", "line_no").alias("last_stamp"))
    tiles = saves.join(pieces, ["file", "piece"]).join(ends, ["file", "piece"], "left").join(units, ["file", "piece"], "left")
    stop = F.coalesce("moved", "first_focus")
    tiles = tiles.select("file", "number", "start_time", "end_time", stop.alias("stage_stop_time"), "x", "y", "drift_units", "drift", (F.col("end_time") - F.col("start_time")).alias("total_time"), (F.col("end_time") - stop).alias("dwell"), "last_stamp", "piece")
    seq = F.row_number().over(Window.partitionBy("file", "piece").orderBy("line_no")) - 1
    drifts = stamps.withColumn("seq", seq).join(saves.select("file", "piece", "number"), ["file", "piece"]).select("file", "number", "seq", "since_stop", "drift")
    return header, tiles.drop("piece"), drifts


# Piece files


def pmg(texts: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Header (pieces, scale, reduction) and pieces (file, ordinal, name, x, y) of piece texts (file, text).

    With a table of existing files (file, name), a piece whose .bmp isn't there may be a .tif, and others go. The last
    piece of a name counts.
    """
    number = lambda key, kind: F.regexp_extract("text", rf"{key}[ \t]+([-+.\deE]+)", 1).try_cast("double").try_cast(kind)
    heads = texts.select("file", "text", number("VISPIECES", "int").alias("pieces"), (1 / number("VISSCALE", "double")).alias("scale"), (1 / number("IMAGEREDUCTION", "double")).alias("reduction"))
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)(?<!END)(?<!VIS)PIECE\b(.*?)ENDPIECE"), 1)
    found = heads.select("file", "scale", "reduction", F.posexplode(blocks).alias("ordinal", "block"))
    place = lambda k: F.regexp_extract("block", r"CORNER\s+([-+.\deE]+)\s+([-+.\deE]+)", k).try_cast("double") * F.col("scale") * F.col("reduction")
    pieces = found.select("file", "ordinal", F.regexp_extract("block", r"PATH[^<]*<([^>]*)>", 1).alias("name"), place(1).alias("x"), place(2).alias("y")).where("name <> ''")
    if files is not None:
        tif = F.regexp_replace("name", r"\.[^.]*$", ".tif")
        there = files.select("file", F.col("name").alias("_there")).distinct()
        as_is = pieces.join(there, (pieces["file"] == there["file"]) & (pieces["name"] == there["_there"]), "left_semi")
        changed = pieces.join(as_is, ["file", "ordinal"], "left_anti").withColumn("name", tif)
        pieces = as_is.unionByName(changed.join(there.withColumnRenamed("_there", "name"), ["file", "name"], "left_semi").select(*as_is.columns))
    w = Window.partitionBy("file", "name").orderBy(F.desc("ordinal"))
    pieces = pieces.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return heads.drop("text"), pieces


# File names


class Part:
    """A part of a name between underscores: its column, type, and default; without a default it is required."""

    def __init__(self, name: str, kind: str = "string", default: object = ..., column: Column | None = None) -> None:
        self.name, self.kind, self.default = name, kind, default


PMG_NAME = [Part("Slide", "int"), Part("Block"), Part("Section", "int", None), Part("Initials"), Part("Mag"), Part("Spot", "int"), Part("Probe")]
SECTION_NAME = [Part("Section", "int"), Part("Channel"), Part("Filter", "string", None), Part("Downsample", "int", 1)]


def parsed_names(rows: DataFrame, path: str, parts: list[Part]) -> DataFrame:
    """rows with a column for each part of the file name. A part that doesn't have its type takes its default and is left for
    the next; `name_error` is a text if the name has too few or too many parts, or a required one doesn't fit."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    out = rows.withColumn("_parts", F.split(base, "_")).withColumn("_at", F.lit(0)).withColumn("name_error", F.lit(None).cast("string"))
    required = sum(p.default is ... for p in parts)
    n = F.size("_parts")
    out = out.withColumn("name_error", F.when(n < required, "too few parts").when(n > len(parts) + 1, "too many parts"))
    for p in parts:
        text = F.get(F.col("_parts"), F.col("_at"))
        value = text if p.kind == "string" else F.when(text.rlike(r"^\s*[-+]?\d+\s*$"), text.try_cast(p.kind)) if p.kind == "int" else text.try_cast(p.kind)
        out = out.withColumn("_v", value)
        if p.default is ...:
            out = out.withColumn("name_error", F.coalesce("name_error", F.when(F.col("_v").isNull(), F.lit(f"{p.name} missing"))))
        default = F.lit(None if p.default is ... else p.default).cast(p.kind)
        out = out.withColumn(p.name, F.coalesce("_v", default)).withColumn("_at", F.col("_at") + F.when(F.col("_v").isNotNull(), 1).otherwise(0))
    return out.drop("_parts", "_at", "_v")


def with_name_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Filter", F.coalesce("Filter", F.lit("Imported"))).withColumn("Downsample", F.coalesce("Downsample", F.lit(1)))


def section_of_folder(rows: DataFrame, path: str) -> DataFrame:
    """Section number, name and downsample of a folder "number[_name][_downsample]"."""
    base = F.regexp_extract(path, r"([^/\\]*)[/\\]?$", 1)
    parts = F.split(base, "_")
    number = F.get(parts, F.lit(0)).try_cast("int")
    last = F.element_at(parts, -1).try_cast("int")
    rest = F.when((F.size(parts) > 2) & last.isNotNull(), F.slice(parts, 2, F.size(parts) - 2)).otherwise(F.slice(parts, 2, F.size(parts)))
    return rows.withColumn("section", number).withColumn("section_name", F.nullif(F.array_join(rest, "_"), F.lit(""))).withColumn("downsample", F.when(F.size(parts) > 2, last))


# Small texts


def contrast_overrides(texts: DataFrame) -> DataFrame:
    """(section, min, max, gamma) of lines of four numbers; comments (#) and other lines are left out. The last one counts."""
    parts = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = lines_of(texts).withColumn("p", parts).where(F.size("p") == 4)
    d = lambda k: F.col("p")[k].try_cast("double")
    made = rows.select("file", "line_no", F.col("p")[0].try_cast("int").alias("section"), d(1).alias("min"), d(2).alias("max"), d(3).alias("gamma")).where("section is not null and min is not null and max is not null and gamma is not null")
    return made.groupBy("section").agg(F.max_by(F.struct("min", "max", "gamma"), F.struct("file", "line_no")).alias("v")).select("section", "v.*")


def flip_list(texts: DataFrame) -> DataFrame:
    """(section): one number a line; any other line is an error."""
    return lines_of(texts).where("line <> ''").select(F.when(F.col("line").rlike(r"^-?\d+$"), F.col("line").try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a section number: "), F.col("line")))).alias("section")).distinct()


def prune_scores(texts: DataFrame) -> DataFrame:
    """(tile, score) of tab-separated lines."""
    split = F.posexplode(F.split("text", "\r?\n"))
    p = F.split("line", "\t")
    return texts.select("file", split.alias("line_no", "line")).where(F.size(p) == 2).select(F.trim(p[0]).alias("tile"), p[1].try_cast("double").alias("score")).where("score is not null")


#: A text of one element, whose attributes have no entities, and one name twice; all that isn't surely the former is left to a parser.
_SPACE = r"[ \t\r\n]"
_ATTRIBUTE = rf'{_SPACE}+[A-Za-z_][A-Za-z0-9_.-]*="[ !#-%\x27-;=?-~ -퟿]*"'
_ELEMENT = rf'\A(<\?xml version="1\.0"( encoding="(utf|UTF)-8")? ?\?>)?{_SPACE}*<[A-Za-z_][A-Za-z0-9_.-]*({_ATTRIBUTE})*{_SPACE}*/>{_SPACE}*\z'
_TWICE = rf'{_SPACE}([A-Za-z0-9_.-]+)="[^"]*"({_ATTRIBUTE})*{_SPACE}+\1="'


def tileset_info(texts: DataFrame) -> DataFrame:
    """Grid and tile dimensions of tileset XML texts. A text of one plain element, as `sinks` writes it, is read by expressions
    on strings; others are parsed once for each attribute."""
    names = {"GridDimX": "int", "GridDimY": "int", "TileDimX": "int", "TileDimY": "int", "FilePrefix": "string", "FilePostfix": "string", "Downsample": "double"}
    columns = ("grid_x", "grid_y", "tile_x", "tile_y", "prefix", "postfix", "downsample")
    number = {"int": "^[0-9]{1,9}$", "double": r"^[0-9]{1,9}([.][0-9]{1,9})?$"}
    plain = F.col("_shape")
    for n, kind in names.items():
        if kind in number:
            plain &= F.col(f"_{n}").rlike(number[kind])
    # each step's columns are used several times by the next, and so computed once
    found = texts.select("file", "text", (F.col("text").rlike(_ELEMENT) & ~F.col("text").rlike(_TWICE)).alias("_shape"), *[F.regexp_extract("text", rf'{_SPACE}{n}="([^"]*)"', 1).alias(f"_{n}") for n in names])
    found = found.withColumn("_plain", plain)
    value = lambda n, kind: F.when(F.col("_plain"), F.col(f"_{n}").cast(kind)).otherwise(F.expr(f"xpath_{kind}(text, '//@{n}')"))
    return found.select("file", *[value(n, kind).alias(c) for (n, kind), c in zip(names.items(), columns)])


def notes(spark: SparkSession, glob: str) -> DataFrame:
    """(file, text): notes as they are attached."""
    from tessera.functions.scalar import note_text

    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("file"), note_text("value").alias("text"))
