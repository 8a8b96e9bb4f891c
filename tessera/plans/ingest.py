"""Sources and sinks as queries: files' texts or bytes are made of the relational tables, read back by the library, and
compared with SQL over the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.operators import windows
from tessera.plans import paths
from tessera.plans.proxies import _tree
from tessera.sources import elements, exports, mrc, sinks, texts
from tessera.sources.tables import Tables, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("$") else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(rows: DataFrame, file: str, order: str, head: str, block: Column) -> DataFrame:
    """(file, text): a text for each file, its rows' blocks in order after the head."""
    grouped = rows.groupBy(F.col(file).alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("x"))
    return grouped.select("file", F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: v["b"]), "")).alias("text"))


def _one(lines: DataFrame, head: str = "") -> DataFrame:
    """(file, text) of lines as one file."""
    return lines.agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), "\n")).alias("text")).select(F.lit("f").alias("file"), "text")


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _captures(t: Tables) -> DataFrame:
    block = _text("[Image = ", "$p_partkey", ".tif]\nPieceCoordinates = ", "$p_size", " ", "$p_partkey", " 0\nIntensity = ", "$p_retailprice", "\nMinMaxMean = 12 16000 5123.4\nNote = none\n")
    return _files(t.part, "p_brand", "p_partkey", "PixelSpacing = 21.76\nDataMode = 1\nImageSize = 4080 2040\n\n", block)


@query("SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, p_partkey || '.tif' AS image, p_size AS x, p_partkey::INTEGER AS y, p_retailprice AS intensity, 4096.0::DOUBLE AS most FROM part")
def capture_tiles(t):
    tiles = texts.numbered_tiles(texts.idoc(_captures(t), camera_bits=12)[1])
    return tiles.select("file", "ordinal", F.col("Image").alias("image"), "x", "y", F.col("Intensity").alias("intensity"), F.col("MinMaxMean")[1].alias("most"))


@query("SELECT DISTINCT p_brand AS file, 1::INTEGER AS mode, 21.76::DOUBLE AS spacing, 4080::INTEGER AS width, 2040::INTEGER AS height FROM part")
def capture_headers(t):
    return texts.idoc(_captures(t))[0].select("file", F.col("DataMode").alias("mode"), F.col("PixelSpacing").alias("spacing"), F.col("ImageSize")[0].alias("width"), F.col("ImageSize")[1].alias("height"))


@query("SELECT p_brand AS file, arg_min(p_retailprice, p_partkey)::VARCHAR AS intensity, '21.76' AS spacing FROM part GROUP BY 1")
def capture_attribute_maps(t):
    a = lambda n: F.try_element_at("attrs", F.lit(n))
    return texts.capture_attributes(*texts.idoc(_captures(t))).select("file", a("Intensity").alias("intensity"), a("PixelSpacing").alias("spacing"))


@query("SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, p_partkey || '.tif' AS image, p_size + 0.5::DOUBLE AS tilt FROM part")
def capture_mdoc(t):
    made = _files(t.part, "p_brand", "p_partkey", "DataMode = 1\n", _text("[ZValue = ", "$p_partkey", "]\nTiltAngle = ", "$p_size", ".5\n"))
    return texts.idoc(texts.idoc_of_mdoc(made))[1].select("file", "ordinal", F.col("Image").alias("image"), F.col("TiltAngle").alias("tilt"))


def _logs(t: Tables) -> DataFrame:
    """A log for each nation: its suppliers are pieces, ten seconds each, saved once the next one's capture has begun."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = t.supplier.withColumn("k", F.row_number().over(w) - 1).withColumn("was", F.lag("s_suppkey").over(w)).withColumn("last", F.lead("s_suppkey").over(w).isNull())
    at = lambda n: F.concat((F.lit(100 + n) + F.col("k") * 10).cast("string"), F.lit(".0: "))
    save = lambda number, y: _text("SaveImage Saving image at ", "$s_nationkey", " ", y, ",  file Z = ", number, "\n")
    block = F.concat(
        at(0), F.lit("DoNextPiece Starting capture with stage move\n"), F.when(F.col("was").isNotNull(), F.concat(at(0), save(F.col("was"), F.col("k") - 1))).otherwise(""),
        at(1), F.lit("BlankerProc finished stage move\n"), at(2), F.lit("Autofocus Start\n"), _text("Measured defocus = 2 um, drift = ", F.col("s_suppkey") % 7, ".5 nm/sec\n"),
        F.when(F.col("last"), F.concat(at(10), F.lit("DoNextPiece Starting capture\n"), at(10), save(F.col("s_suppkey"), F.col("k")), at(11), F.lit("Montage Done\n"))).otherwise(""),
    )
    return _files(rows.withColumn("file", F.col("s_nationkey").cast("string")), "file", "s_suppkey", "SerialEM Version 9.8b\n90.0: Montage Start\n", block)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier)
SELECT s_nationkey::VARCHAR AS file, s_suppkey::INTEGER AS number, 100.0::DOUBLE + 10 * k AS start_time, 110.0::DOUBLE + 10 * k AS end_time, 101.0::DOUBLE + 10 * k AS stage_stop_time, s_nationkey AS x, k::INTEGER AS y, 'nm/sec' AS drift_units,
  s_suppkey % 7 + 0.5::DOUBLE AS drift, 10.0::DOUBLE AS total_time, 9.0::DOUBLE AS dwell FROM a""")
def log_tiles(t):
    return texts.acquisition_log(_logs(t))[1].drop("last_stamp")


@query("SELECT s_nationkey::VARCHAR AS file, '9.8b' AS version, 90.0::DOUBLE AS montage_start, 101.0::DOUBLE + 10 * count(*) AS montage_end FROM supplier GROUP BY 1")
def log_headers(t):
    return texts.acquisition_log(_logs(t))[0].select("file", "version", "montage_start", "montage_end")


@query("SELECT s_nationkey::VARCHAR AS file, s_suppkey::INTEGER AS number, 0::INTEGER AS seq, 1.0::DOUBLE AS since_stop, s_suppkey % 7 + 0.5::DOUBLE AS drift FROM supplier")
def log_drifts(t):
    return texts.acquisition_log(_logs(t))[2]


@query("SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, p_partkey || '.bmp' AS name, p_size * 0.5::DOUBLE AS x, p_partkey * 0.5::DOUBLE AS y FROM part")
def piece_files(t):
    block = _text("PIECE\nPATH <", "$p_partkey", ".bmp>\nCORNER ", "$p_size", " ", "$p_partkey", " 0\nENDPIECE\n")
    return texts.pmg(_files(t.part, "p_brand", "p_partkey", "VISPIECES 3\nVISSCALE 0.5\nIMAGEREDUCTION 4\n", block))[1]


@query("""SELECT s_suppkey AS key, s_suppkey::INTEGER AS section, 'TEM' AS channel, CASE WHEN s_suppkey % 2 = 1 THEN 'Raw' ELSE 'Imported' END AS filter, (CASE WHEN s_suppkey % 2 = 1 THEN 4 ELSE 1 END)::INTEGER AS downsample,
  CASE WHEN s_suppkey % 10 = 0 THEN 'too many parts' END AS error FROM supplier""")
def section_file_names(t):
    k = F.col("s_suppkey")
    path = _text("/x/", k, "_TEM", F.when(k % 2 == 1, "_Raw_4").when(k % 10 == 0, "_Imported_1_a_b_c").otherwise(""), ".png")
    parsed = texts.with_name_defaults(texts.parsed_names(t.supplier.select("s_suppkey", path.alias("path")), "path", texts.SECTION_NAME))
    return parsed.select(k.alias("key"), F.col("Section").alias("section"), F.col("Channel").alias("channel"), F.col("Filter").alias("filter"), F.col("Downsample").alias("downsample"), F.col("name_error").alias("error"))


@query("SELECT s_suppkey AS key, s_suppkey::INTEGER AS section, s_name AS name, 4::INTEGER AS downsample FROM supplier")
def section_folders(t):
    rows = t.supplier.select("s_suppkey", _text("/v/", F.format_string("%04d", "s_suppkey"), "_", "$s_name", "_4").alias("path"))
    return texts.section_of_folder(rows, "path").select(F.col("s_suppkey").alias("key"), "section", F.col("section_name").alias("name"), "downsample")


@query("SELECT s_suppkey::INTEGER AS section, s_nationkey::DOUBLE AS min, s_acctbal AS max, 1.5::DOUBLE AS gamma FROM supplier")
def contrast_override_file(t):
    rows = t.supplier.select(F.col("s_suppkey").cast("int").alias("section"), F.col("s_nationkey").cast("double").alias("min"), F.col("s_acctbal").alias("max"), F.lit(1.5).alias("gamma"))
    return texts.contrast_overrides(_one(sinks.override_lines(rows), "# section min max gamma\n"))


@query("SELECT DISTINCT s_nationkey AS section FROM supplier")
def flip_list_file(t):
    return texts.flip_list(_one(t.supplier.select(F.col("s_nationkey").cast("string").alias("value")), "\n"))


@query("SELECT p_partkey || '.png' AS tile, p_retailprice AS score FROM part")
def prune_score_file(t):
    return texts.prune_scores(_one(sinks.prune_score_lines(t.part.select(_text("$p_partkey", ".png").alias("tile"), F.col("p_retailprice").alias("score"))), "no score\n"))


@query("SELECT p_partkey::VARCHAR AS file, p_size AS grid_x, p_size + 1 AS grid_y, 256::INTEGER AS tile_x, 512::INTEGER AS tile_y, p_brand AS prefix, '.png' AS postfix, 2.0::DOUBLE AS downsample FROM part")
def tileset_info_files(t):
    rows = t.part.select("p_partkey", F.col("p_size").alias("grid_x"), (F.col("p_size") + 1).alias("grid_y"), F.lit(256).alias("tile_x"), F.lit(512).alias("tile_y"), F.col("p_brand").alias("prefix"), F.lit(".png").alias("postfix"), F.lit(2.0).alias("downsample"))
    rows = rows.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return texts.tileset_info(rows.select(F.col("p_partkey").cast("string").alias("file"), sinks.tileset_info_xml(rows).alias("text")))


@query("""WITH a AS (SELECT n_nationkey AS k, 0 AS o, 0 AS depth, 'Section' AS tag, n_name AS name FROM nation
UNION ALL SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 1, 'Channel', s_name FROM supplier)
SELECT k::VARCHAR AS file, o::BIGINT AS ord, depth::INTEGER AS depth, tag, name FROM a WHERE k IN (SELECT s_nationkey FROM supplier)""")
def elements_parsed(t):
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("file", F.col("n_nationkey").cast("string"))
    inside = _files(rows, "file", "s_suppkey", "", _text('<Channel Name="', "$s_name", '"/>'))
    heads = t.nation.select(F.col("n_nationkey").cast("string").alias("file"), _text('<Section Name="', "$n_name", '">').alias("head"))
    xml = inside.join(F.broadcast(heads), "file").select("file", F.concat("head", "text", F.lit("</Section>")).alias("text"))
    return elements.parsed(xml).select("file", "ord", "depth", "tag", F.try_element_at("attrs", F.lit("Name")).alias("name"))


@query("""SELECT 'Volume' AS tag, NULL AS label, NULL AS parent UNION ALL SELECT 'Block', r_name, NULL FROM region UNION ALL SELECT 'Section', n_nationkey::VARCHAR, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'Channel', s_name, s_nationkey::VARCHAR FROM supplier""")
def saved_elements(t):
    """Saved as linked files, a folder for each region and nation, and loaded again."""
    folder = _folder(t, "volume")
    elements.saved(_tree(t).withColumn("text", F.lit(None).cast("string")), folder).write.format("noop").mode("overwrite").save()
    found = elements.load(t.spark, folder)
    a = lambda n: F.try_element_at("attrs", F.lit(n))
    label = F.coalesce(a("Name"), a("Number"))
    above = found.select(F.col("id").alias("parent"), label.alias("above"))
    return found.join(above, "parent", "left").select("tag", label.alias("label"), F.col("above").alias("parent"))


def _stacks(t: Tables) -> str:
    folder = _folder(t, "stacks")
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    tiles = t.embeddings.select(F.col("label").cast("string").alias("stack"), number.alias("tile"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("values"), (F.col("vec_id") % 1000).alias("piece_x"), F.col("label").alias("piece_y"))
    mrc.written(tiles, folder).write.format("noop").mode("overwrite").save()
    return f"{folder}/*.mrc"


@query("SELECT label::VARCHAR AS stack, 8::INTEGER AS width, 8::INTEGER AS height, count(*)::INTEGER AS tiles, 2::INTEGER AS mode, false AS big_endian FROM embeddings GROUP BY 1")
def stack_headers(t):
    return mrc.headers(t.spark, _stacks(t)).select(F.regexp_extract("file", r"([^/]*)\.mrc$", 1).alias("stack"), "width", "height", "tiles", "mode", "big_endian")


@query("SELECT label::VARCHAR AS stack, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS tile, CAST(vec_id % 1000 AS INTEGER) AS piece_x, label AS piece_y FROM embeddings")
def stack_tiles(t):
    return mrc.tiles(t.spark, _stacks(t)).select(F.regexp_extract("file", r"([^/]*)\.mrc$", 1).alias("stack"), "tile", "piece_x", "piece_y")


@query("SELECT label::VARCHAR AS stack, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS tile, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, list_max(embedding)::DOUBLE AS most FROM embeddings")
def stack_pixels(t):
    px = mrc.pixels(t.spark, _stacks(t))
    return px.select(F.regexp_extract("file", r"([^/]*)\.mrc$", 1).alias("stack"), "tile", F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"), F.array_max("values").alias("most"))


@query("""WITH a AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 1000) % 256) AS v FROM embeddings),
b AS (SELECT label, k, list_transform(v, lambda x: least(255, greatest(0, round_even(((CASE WHEN x > 128 THEN x / 2 ELSE x END) - 10) * (255.0::DOUBLE / 128), 0)))) AS v FROM a)
SELECT label || '/' || printf('%03d', k) || '.png' AS path, 8::INTEGER AS width, 8::INTEGER AS height, CAST(list_sum(v) AS BIGINT) AS total, CAST(v[1] AS INTEGER) AS first FROM b""")
def exported_tiles(t):
    """Tiles written as images of 8 bits with their contrast corrected, and read again."""
    folder = _folder(t, "images")
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    values = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("double") % 256)
    tiles = t.embeddings.select(_text("/x/", "$label", ".mrc").alias("file"), number.alias("tile"), F.lit(8).alias("width"), F.lit(8).alias("height"), values.alias("values"))
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # a file for each tile is much work, its bytes are few
    exports.exported_images(tiles.repartition(tasks, "file", "tile"), folder, bits=8, low=10.0, high=128.0).write.parquet(f"{folder}-names")
    found = exports.images_at(t.spark.read.parquet(f"{folder}-names").repartition(tasks))
    total = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("path"), "width", "height", total.alias("total"), F.col("values")[0].alias("first"))


@query("""SELECT n_nationkey::INTEGER AS number, '<Section Number="' || n_nationkey || '" Path="' || n_regionkey || '/' || n_nationkey || '" Name="">' ||
  string_agg('<Transform Name="Grid" Path="' || s_suppkey || '/t.mosaic" FilePrefix="" FilePostfix="png" UseForVolume="true" />', '' ORDER BY s_suppkey) || '</Section>' AS document
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""")
def viewer_sections(t):
    """Sections for a viewer, of which each channel has one transform."""
    tree = _tree(t).withColumn("text", F.lit(None).cast("string"))
    channel = F.col("tag") == "Channel"
    placed = tree.withColumn("attrs", F.when(channel, F.map_concat("attrs", F.create_map(F.lit("Path"), F.substring("id", 2, 20)))).otherwise(F.col("attrs")))
    grids = tree.where(channel).select(F.concat("id", F.lit("t")).alias("id"), F.col("id").alias("parent"), "ord", F.lit("Transform").alias("tag"), F.create_map(F.lit("Name"), F.lit("Grid"), F.lit("Path"), F.lit("t.mosaic")).alias("attrs"), "text")
    made = exports.viewer_sections(placed.unionByName(grids), grids.select("id", F.lit("000.png").alias("image")))
    return made.where(F.contains("document", F.lit("<Transform")))


@query("SELECT l_suppkey AS section, first(l_orderkey ORDER BY l_shipdate DESC, l_orderkey) AS newest, max(l_shipdate) AS modified FROM lineitem GROUP BY 1")
def newest_file(t):
    return windows.newest(t.lineitem, ["l_suppkey"], "l_orderkey", "l_shipdate").withColumnRenamed("l_suppkey", "section")


@query("""SELECT p_brand AS row, coalesce(string_agg(p_partkey::VARCHAR, '; ' ORDER BY p_partkey::VARCHAR) FILTER (p_size % 2 = 0), '') AS even,
  coalesce(string_agg(p_partkey::VARCHAR, '; ' ORDER BY p_partkey::VARCHAR) FILTER (p_size % 2 = 1), '') AS odd FROM part GROUP BY 1""")
def report_table(t):
    rows = t.part.select(F.col("p_brand").alias("row"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("kind"), F.col("p_partkey").cast("string").alias("cell"))
    return sinks.table_report(rows, "row", "kind", "cell", ["even", "odd"]).select("row", *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("even", "odd")])


@query("""SELECT s_suppkey AS key, '<a href="v%20/' || s_name || '.png">' || s_name || '</a>' AS link, '<a href="' || s_name || '.png"><img src="' || s_name || '.png" width="100" height="50"/></a>' AS image FROM supplier""")
def report_cells(t):
    return t.supplier.select(F.col("s_suppkey").alias("key"), sinks.anchor(_text("v /", "$s_name", ".png"), F.col("s_name")).alias("link"), sinks.image_tag(_text("$s_name", ".png"), F.lit(2000), F.lit(1000), 100, 100).alias("image"))


@query("""SELECT 's' || s_suppkey AS id, 'Name' AS label, s_name AS value FROM supplier UNION ALL SELECT 's' || s_suppkey, 'Balance', rtrim(rtrim(printf('%.4f', s_acctbal), '0'), '.') FROM supplier""")
def attribute_table(t):
    return sinks.attribute_rows(_tree(t).where("tag = 'Channel'"))


@query("SELECT '/v/' || s_nationkey AS folder, list_sort(list_distinct(list('f' || s_suppkey % 4))) AS files FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 4) FILTER (s_suppkey % 4 < 2) = 2")
def folder_table(t):
    return sinks.folder_index(t.supplier.select(_text("/v/", "$s_nationkey", "/f", F.col("s_suppkey") % 4).alias("path")), ["f0", "f1"])


@query("SELECT n_nationkey::INTEGER AS section, count(s_suppkey)::INTEGER AS transforms, 0::INTEGER AS tilesets, min(s_name) AS first FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def section_documents(t):
    found = sinks.export_document(t.nation.select(F.col("n_nationkey").alias("section")), t.supplier.select(F.col("s_nationkey").alias("section"), "s_name"), t.region.select(F.col("r_regionkey").alias("section"), "r_name").where("section < 0"))
    j = lambda p, kind: F.get_json_object("document", p).cast(kind)
    return found.select(F.col("section").cast("int").alias("section"), j("$.num_transforms", "int").alias("transforms"), j("$.num_tilesets", "int").alias("tilesets"), j("$.transforms[0].s_name", "string").alias("first"))


@query("SELECT s_suppkey::VARCHAR AS supplier, s_nationkey::VARCHAR AS section FROM supplier")
def nearest_section(t):
    tree = _tree(t)
    return paths.nearest_ancestor(tree, "Section").where(F.col("id").startswith("s")).select(F.substring("id", 2, 20).alias("supplier"), F.substring("ancestor", 2, 20).alias("section"))
