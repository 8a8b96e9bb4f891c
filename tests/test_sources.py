import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.sources import elements, exports, mrc, sinks, texts

IDOC = """DataMode = 1
PixelSpacing = 21.76
ImageSize = 4080 4080
ImageSeries = 1
Montage = 1
Title = not a number
[Image = 10000.tif]
PieceCoordinates = 3590 7180 0
Intensity = 0.549157
SpotSize = 2
Defocus = -6.8902
MinMaxMean = 12 16000 5123.4
SubFramePath = C:\\x
[Image = 10001.tif]
PieceCoordinates = 0 3590 0
Magnification = 5000
MinMaxMean = -3 70000 100
"""


def table(spark, text, file="f"):
    return spark.createDataFrame([(file, text)], "file string, text string")


def test_idoc(spark):
    header, tiles = texts.idoc(table(spark, IDOC), camera_bits=14)
    h = header.first()
    assert (h["DataMode"], h["PixelSpacing"], h["ImageSize"], h["ImageSeries"], h["Montage"]) == (1, 21.76, [4080, 4080], 1, 1)
    a, b = tiles.orderBy("ordinal").collect()
    assert (a["Image"], a["PieceCoordinates"], a["Intensity"], a["SpotSize"], a["Defocus"], a["MinMaxMean"]) == ("10000.tif", [3590, 7180, 0], 0.549157, 2, -6.8902, [12.0, 16000.0, 5123.4])
    assert b["MinMaxMean"] == [-3.0, 16384.0, 100.0] and b["Magnification"] == 5000 and b["Defocus"] is None
    numbered = texts.numbered_tiles(tiles).orderBy("ordinal").collect()
    assert [(r["target"], r["x"], r["y"]) for r in numbered] == [("000.png", 3590, 7180), ("001.png", 0, 3590)]
    attrs = texts.capture_attributes(header, tiles).first()["attrs"]
    assert attrs["Montage"] == "1" and attrs["SpotSize"] == "2" and "Defocus" not in attrs


def test_idoc_empty_and_two_files(spark):
    header, tiles = texts.idoc(spark.createDataFrame([("a", ""), ("b", IDOC), ("c", None)], "file string, text string"))
    assert header.count() == 1 and tiles.count() == 2


def test_mdoc(spark):
    out = texts.idoc_of_mdoc(table(spark, "A = 1\n[ZValue = 12]\nB = 2")).first()["text"]
    assert out == "A = 1\n[Image = 12.tif]\nB = 2"


LOG = """Last update properties file: Jan 2, 2020
SerialEM Version 9.8b,  built today
Started  1/2/2020 at noon
100.0: Montage Start
101.0: DoNextPiece Starting stage move
102.0: Autofocus Start
Measured defocus = 2 um, drift = 1.57 nm/sec
103.0: Autofocus Done
110.0: DoNextPiece Starting capture with stage move
112.0: BlankerProc finished stage move
113.0: SaveImage Saving image at 4 5,  file Z = 0
114.0: Autofocus Start
Measured defocus = 2 um, drift = 1.38 nm/sec
115.0: Autofocus Start
Measured defocus = 3 um, drift = 0.9 nm/sec
120.5: DoNextPiece Starting capture with stage move
121.0: SaveImage Saving image at 4 6,  file Z = 1
130.0: SaveImage Processing
"""


def test_log(spark):
    header, tiles, drifts = texts.acquisition_log(table(spark, LOG))
    h = header.first()
    assert (h["version"], h["startup"], h["properties_version"]) == ("9.8b,  built today", "1/2/2020 at noon", "Jan 2, 2020")
    assert (h["montage_start"], h["montage_end"]) == (100.0, 130.0)
    a, b = tiles.orderBy("number").collect()
    assert (a["number"], a["x"], a["y"], a["start_time"], a["end_time"], a["stage_stop_time"], a["drift"]) == (0, 4, 5, 101.0, 110.0, 102.0, 1.57)
    assert (b["number"], b["start_time"], b["end_time"], b["stage_stop_time"], b["drift"], b["drift_units"], b["dwell"]) == (1, 110.0, 120.5, 112.0, 0.9, "nm/sec", 8.5)
    stamps = [(r["number"], r["seq"], r["since_stop"], r["drift"]) for r in drifts.orderBy("number", "seq").collect()]
    assert stamps == [(0, 0, 0.0, 1.57), (1, 0, 2.0, 1.38), (1, 1, 3.0, 0.9)]


PMG = "VISPIECES 3\nVISSCALE 0.5\nIMAGEREDUCTION 4\n" + "".join(f"PIECE\nPATH <{n}>\nCORNER {x} {y} 0\nENDPIECE\n" for n, x, y in (("a.bmp", 10, 20), ("b.bmp", 30, 40), ("a.bmp", 50, 60), ("gone.bmp", 1, 1)))


def test_pmg(spark):
    header, pieces = texts.pmg(table(spark, PMG))
    h = header.first()
    assert (h["pieces"], h["scale"], h["reduction"]) == (3, 2.0, 0.25)
    assert {(r["name"], r["x"], r["y"]) for r in pieces.collect()} == {("a.bmp", 25.0, 30.0), ("b.bmp", 15.0, 20.0), ("gone.bmp", 0.5, 0.5)}
    there = spark.createDataFrame([("f", "a.bmp"), ("f", "b.tif")], "file string, name string")
    assert {r["name"] for r in texts.pmg(table(spark, PMG), there)[1].collect()} == {"a.bmp", "b.tif"}


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("1234_5678_ja_40x_04_yy.pmg", (1234, "5678", None, "ja", "40x", 4, "yy", None)),
        ("/x/1234_5678_0001_ja_40x_04_yy.pmg", (1234, "5678", 1, "ja", "40x", 4, "yy", None)),
        ("1234_5678_0001_ja_40x_04_y y.pmg", (1234, "5678", 1, "ja", "40x", 4, "y y", None)),
        ("1234_5678.pmg", None),
    ],
)
def test_names(spark, name, want):
    r = texts.parsed_names(spark.createDataFrame([(name,)], "path string"), "path", texts.PMG_NAME).first()
    if want is None:
        assert r["name_error"] == "too few parts"
    else:
        assert tuple(r)[2:] + (r["name_error"],) == want or tuple(r[p.name] for p in texts.PMG_NAME) + (r["name_error"],) == want


def test_section_names(spark):
    rows = spark.createDataFrame([("12_TEM.png",), ("12_TEM_Leveled_4.png",), ("0012_TEM_Leveled.png",)], "path string")
    out = texts.with_name_defaults(texts.parsed_names(rows, "path", texts.SECTION_NAME)).orderBy("path").collect()
    assert {(r["Section"], r["Channel"], r["Filter"], r["Downsample"]) for r in out} == {(12, "TEM", "Imported", 1), (12, "TEM", "Leveled", 4), (12, "TEM", "Leveled", 1)}


def test_small_texts(spark):
    got = texts.contrast_overrides(table(spark, "# section min max gamma\n1 10 200 0.8\nbad line\n2 5 6 1 # x\n1 11 200 0.9\n")).orderBy("section").collect()
    assert [tuple(r) for r in got] == [(1, 11.0, 200.0, 0.9), (2, 5.0, 6.0, 1.0)]
    assert sorted(r[0] for r in texts.flip_list(table(spark, "3\n 5\n\n3")).collect()) == [3, 5]
    with pytest.raises(Exception, match="not a section number"):
        texts.flip_list(table(spark, "3\nx")).collect()
    scores = texts.prune_scores(table(spark, "b.png\t0.5\na.png\t1.25\nno tab"))
    assert [tuple(r) for r in scores.orderBy("tile").collect()] == [("a.png", 1.25), ("b.png", 0.5)]
    assert [r[0] for r in sinks.prune_score_lines(scores).collect()] == ["a.png\t1.25", "b.png\t0.5"]


def test_tileset_info_round_trip(spark):
    rows = spark.createDataFrame([(10, 5, 256, 512, "p", "q.png", 2.0)], "grid_x int, grid_y int, tile_x int, tile_y int, prefix string, postfix string, downsample double")
    xml = rows.select(F.lit("f").alias("file"), sinks.tileset_info_xml(rows).alias("text"))
    assert tuple(texts.tileset_info(xml).first())[1:] == (10, 5, 256, 512, "p", "q.png", 2.0)


def made_mrc(order=">"):
    head = bytearray(1024)
    struct.pack_into(order + "4I", head, 0, 3, 2, 2, 1)
    struct.pack_into(order + "3I", head, 0x1C, 3, 2, 2)
    struct.pack_into(order + "3f", head, 0x28, 60.0, 40.0, 40.0)
    struct.pack_into(order + "3I", head, 0x40, 1, 2, 3)
    struct.pack_into(order + "3f", head, 0x4C, 1.0, 9.0, 5.0)
    tile = lambda k: struct.pack(order + "H3H2HHHf", 150, k, k + 1, 0, 25 * k, 50, 50, 12500, 0.75)
    struct.pack_into(order + "I", head, 0x5C, 2 * len(tile(0)))
    struct.pack_into(order + "2H", head, 0x80, len(tile(0)), 63)
    head[0xD4] = 17 if order == ">" else 68
    values = np.arange(12).astype(order + "i2")
    values[5] = 300
    return bytes(head) + tile(0) + tile(1) + values.tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
def test_mrc(spark, tmp_path, order):
    (tmp_path / "a.mrc").write_bytes(made_mrc(order))
    path = str(tmp_path / "*.mrc")
    h = mrc.headers(spark, path).first()
    assert (h["width"], h["height"], h["tiles"], h["mode"], h["max"], h["big_endian"]) == (3, 2, 2, 1, 9.0, order == ">")
    assert h["nm_per_pixel_x"] == pytest.approx(2.0)
    a, b = mrc.tiles(spark, path).orderBy("tile").collect()
    assert (b["tilt"], b["piece_x"], b["piece_y"], b["stage_x"], b["pixel_x"], b["magnification"], b["intensity"], b["exposure"]) == (1.5, 1, 2, 1.0, pytest.approx(500.0), 5000.0, 0.5, 0.75)
    px = mrc.pixels(spark, path, camera_bits=8).orderBy("tile").collect()
    assert px[0]["values"] == [0, 1, 2, 3, 4, 45] and px[1]["values"] == [6, 7, 8, 9, 10, 11]
    assert [(r["x"], r["y"]) for r in mrc.mosaic_positions(mrc.tiles(spark, path)).orderBy("tile").collect()] == [(0, 0), (pytest.approx(500.0), 0)]


def test_elements(spark, tmp_path):
    (tmp_path / "TEM" / "0001").mkdir(parents=True)
    (tmp_path / "VolumeData.xml").write_text('<Volume Name="v"><Block_Link Path="TEM"/><Gone_Link Path="gone"/></Volume>')
    (tmp_path / "TEM" / "VolumeData.xml").write_text('<Block Name="TEM" Path="TEM"><Section_Link Path="0001" Number="1"/></Block>')
    (tmp_path / "TEM" / "0001" / "VolumeData.xml").write_text('<Section Number="1" Path="0001"><Channel Name="c"><Notes>x &amp; y</Notes></Channel></Section>')
    (tmp_path / "TEM" / "broken").mkdir()
    (tmp_path / "TEM" / "broken" / "VolumeData.xml").write_text("<Section")
    got = elements.load(spark, str(tmp_path))
    assert sorted(r["tag"] for r in got.collect()) == ["Block", "Channel", "Notes", "Section", "Volume"]
    xml = elements.as_xml(got)
    assert xml == '<Volume Name="v"><Block Name="TEM" Path="TEM"><Section Number="1" Path="0001"><Channel Name="c"><Notes>x &amp; y</Notes></Channel></Section></Block></Volume>'
    again = elements.parsed(table(spark, xml))
    assert elements.as_xml(again) == xml


def test_reports(spark, tmp_path):
    e = spark.createDataFrame([("a", {"Name": "x", "Gamma": "0.90000001", "Version": "1.0", "N": "12"})], "id string, attrs map<string,string>")
    assert {(r["label"], r["value"]) for r in sinks.attribute_rows(e).collect()} == {("Name", "x"), ("Gamma", "0.9"), ("N", "12")}
    html = spark.range(1).select(sinks.anchor(F.lit("a b.png"), F.lit("<x>")).alias("a"), sinks.image_tag(F.lit("p.png"), F.lit(2000), F.lit(1000), 100, 100).alias("i")).first()
    assert html["a"] == '<a href="a%20b.png">&lt;x&gt;</a>' and html["i"] == '<a href="p.png"><img src="p.png" width="100" height="50"/></a>'
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "w"), (2, "b", "<y>")], "section long, kind string, text string")
    report = sinks.table_report(rows, "section", "kind", "text")
    assert [tuple(r) for r in report.orderBy("section").collect()] == [(1, "w; x", ""), (2, "", "<y>")] or [tuple(r) for r in report.orderBy("section").collect()] == [(1, "w; x", None), (2, None, "<y>")]
    page = sinks.html_report(report, "section")
    assert page.index("<td>2</td>") < page.index("<td>1</td>") and "&lt;y&gt;" in page
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("content")
    files = spark.createDataFrame([(f"file://{tmp_path}/in/f.txt",)], "path string")
    assert sinks.copied_files(files, f"file://{tmp_path}/out").count() == 1 and (tmp_path / "out" / "f.txt").read_text() == "content"
    index = sinks.folder_index(spark.createDataFrame([("/a/x.png",), ("/a/y.txt",), ("/b/x.png",)], "path string"), ["x.png", "y.txt"])
    assert [(r["folder"], r["files"]) for r in index.collect()] == [("/a", ["x.png", "y.txt"])]
    s = spark.createDataFrame([(1,)], "section long")
    tr = spark.createDataFrame([(1, "t2"), (1, "t1")], "section long, name string")
    doc = sinks.export_document(s, tr, tr.where("section = 9")).first()["document"]
    assert '"num_transforms":2' in doc and '"num_tilesets":0' in doc and doc.index("t1") < doc.index("t2")


def test_png_round_trip(spark, tmp_path):
    for kind in ("u1", "u2"):
        v = np.arange(35, dtype=kind).reshape(5, 7) * 7
        assert (exports.parsed_png(exports.png(v)) == v).all() and exports.parsed_png(exports.png(v)).dtype == v.dtype
    bad = bytearray(exports.png(v))
    bad[-20] ^= 1
    with pytest.raises(ValueError):
        exports.parsed_png(bytes(bad))
    assert exports.contrasted(np.array([0.0, 10.0, 110.0, 300.0]), 10, 110, 8).tolist() == [0.0, 0.0, 232.0, 255.0]
    tiles = spark.createDataFrame([("x/a.mrc", 3, 2, 2, [1.0, 2.0, 3.0, 70000.0]), ("x/b.mrc", 0, 1, 1, [5.0])], "file string, tile int, width int, height int, values array<double>")
    exports.exported_images(tiles, f"file://{tmp_path}/out").collect()
    got = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1]: r["values"] for r in exports.read_images(spark, f"{tmp_path}/out/*/*.png").collect()}
    assert got == {"a/003.png": [1, 2, 3, 65535], "b/000.png": [5]}


VIEWED = """<Volume Name="v"><Block Name="TEM" Path="TEM"><Section Number="2" Path="0002" Name="two"><Notes>n &amp; m</Notes><Channel Name="C" Path="c">
<Scale><X UnitsOfMeasure="nm" UnitsPerPixel="2"/></Scale><Transform Name="Grid8" Path="g.mosaic"/><Transform Name="Empty" Path="e.mosaic"/>
<Filter Name="F" Path="f"><TilePyramid Path="tp" LevelFormat="%03d"><Level Path="004" Downsample="4"/><Level Path="001" Downsample="1"/></TilePyramid>
<Tileset Path="ts" TileXDim="256" TileYDim="512" FilePrefix="p" FilePostfix=".png" CoordFormat="%03d"><Level Path="001" Downsample="1" GridDimX="3" GridDimY="4"/></Tileset></Filter></Channel></Section></Block></Volume>"""


def test_viewer_document(spark):
    tree = elements.parsed(table(spark, VIEWED))
    first = tree.where("tag = 'Transform' and attrs['Name'] = 'Grid8'").select("id", F.lit("a.001.png").alias("image"))
    sections = exports.viewer_sections(tree, first)
    r = sections.first()
    scale = '<Scale><X UnitsOfMeasure="nm" UnitsPerPixel="2" /></Scale>'
    assert r["number"] == 2 and r["document"] == (
        '<Section Number="2" Path="TEM/0002" Name="two"><Transform Name="Grid8" Path="c/g.mosaic" FilePrefix="a" FilePostfix="png" UseForVolume="true" />'
        f'<Pyramid Name="C.F.Pyramid" Path="c/f/tp" LevelFormat="%03d"><Level Path="001" Downsample="1" /><Level Path="004" Downsample="4" />{scale}</Pyramid>'
        f'<Tileset name="C.F" path="c/f/ts" TileXDim="256" TileYDim="512" FilePrefix="p" FilePostfix=".png" CoordFormat="%03d"><Level path="001" Downsample="1" GridDimX="3" GridDimY="4" />{scale}</Tileset><Notes>n &amp; m</Notes></Section>'
    )
    edges = spark.createDataFrame([(1, 2, "1-2.stos", "Grid")], "control int, mapped int, path string, type string")
    whole = exports.viewer_document(sections, edges, "v", "sum", units="nm", per_pixel=2.0)
    assert whole.startswith('<Volume Name="v" num_stos="1" num_sections="1" InputChecksum="sum"><Scale>') and whole.endswith('<stos controlSection="1" mappedSection="2" path="1-2.stos" type="Grid" /></Volume>')


def test_saved_elements_load_again(spark, tmp_path):
    tree = elements.parsed(table(spark, VIEWED))
    written = elements.saved(tree, f"file://{tmp_path}/v").collect()
    assert {r["path"].removeprefix(str(tmp_path)) for r in written} >= {"/v/VolumeData.xml", "/v/TEM/VolumeData.xml", "/v/TEM/0002/VolumeData.xml"}
    again = elements.load(spark, f"{tmp_path}/v")
    key = lambda df: sorted((r["tag"], sorted(r["attrs"].items()), r["text"]) for r in df.collect())
    assert key(again) == key(tree)
    assert elements.unlinked(elements.parsed(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(f"{tmp_path}/v").select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), "^file:/+", "/").alias("file"), F.col("value").alias("text")))).count() == 0


def test_notes(spark, tmp_path):
    (tmp_path / "n.txt").write_text("a < b\x00")
    assert texts.notes(spark, str(tmp_path / "*.txt")).first()["text"] == "a &lt; b"


def test_edges_for_export_rank_before_they_join(spark, sf_dir):
    """Transforms of a section aren't paired with all its edges before the first is taken."""
    plan = catalog.queries()["edges_for_export"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    ranked = [k for k, line in enumerate(plan) if "Window [" in line]
    assert ranked
    for k in ranked:
        below = list(itertools.takewhile(lambda line: depth(line) > depth(plan[k]), plan[k + 1 :]))
        assert below and not any("Join" in line for line in below)


@pytest.mark.parametrize("text", [
    '<Level GridDimX="3" GridDimY="4" TileDimX="5" TileDimY="6" FilePrefix="a b" FilePostfix="" Downsample="2.5"/>',
    '<?xml version="1.0"?>\n<Level\nFilePostfix=".png" GridDimX="03" XGridDimX="9" GridDimY="4" TileDimX="5" TileDimY="6" Downsample="0.1" FilePrefix="x\'é" />\n',
    "<Level GridDimX='3' FilePrefix='a&amp;b&#65;' Downsample='-2.5'/>",
    '<T><Level GridDimX="3.7" GridDimY="x" FilePrefix="a&lt;\tb"/><Level GridDimX="8" Downsample="1e3" FilePostfix="q"/></T>',
    '<!-- GridDimX="1" --><Level Note="> GridDimX=" GridDimX="99999999999" TileDimX="-4"/>',
    '<Level GridDimX="3" GridDimY="4" TileDimX="5" TileDimY="6" FilePrefix="a&amp;b" FilePostfix="" Downsample="2"/>', "<Level/>", None,
])
def test_tileset_info_is_what_a_parser_finds(spark, text):
    rows = spark.createDataFrame([("f", text)], "file string, text string")
    names = {"GridDimX": "int", "GridDimY": "int", "TileDimX": "int", "TileDimY": "int", "FilePrefix": "string", "FilePostfix": "string", "Downsample": "double"}
    want = rows.select(*[F.expr(f"xpath_{kind}(text, '//@{n}')") for n, kind in names.items()]).first()
    assert repr(tuple(texts.tileset_info(rows).first())[1:]) == repr(tuple(want))


def test_tileset_info_reads_plain_texts_without_a_parser(spark):
    """An attribute that comes twice is an error to a parser, and none may be lost to it."""
    rows = spark.createDataFrame([("f", '<Level GridDimX="3" GridDimY="4" TileDimX="5" TileDimY="6" Downsample="2" GridDimX="4"/>')], "file string, text string")
    with pytest.raises(Exception):
        texts.tileset_info(rows).collect()
    shape = texts.tileset_info(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in shape.upper()


def test_pixels_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Of several tiles each, the last one shorter; a stack without tiles has none."""
    monkeypatch.setattr(mrc, "RANGE_BYTES", 3 * 8 * 4)
    values = np.arange(7 * 4, dtype=np.float32).reshape(7, 4)
    (tmp_path / "a.mrc").write_bytes(mrc.packed(2, 2, values, np.zeros((7, 3))))
    (tmp_path / "b.mrc").write_bytes(mrc.packed(2, 2, values[:0], np.zeros((0, 3))))
    px = mrc.pixels(spark, str(tmp_path / "*.mrc")).orderBy("tile").collect()
    assert [(r["tile"], r["values"]) for r in px] == [(k, v.tolist()) for k, v in enumerate(values)]


def test_exported_images_are_read_by_name(spark, tmp_path):
    """Of those that were written, and no others in the folder."""
    tiles = spark.createDataFrame([("x/a.mrc", k, 2, 1, [float(k), 2.0]) for k in range(3)], "file string, tile int, width int, height int, values array<double>")
    made = exports.exported_images(tiles, f"file://{tmp_path}/out", bits=8)
    made.write.parquet(f"{tmp_path}/names")
    (tmp_path / "out" / "a" / "other.png").write_bytes(b"")
    got = exports.images_at(spark.read.parquet(f"{tmp_path}/names")).collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["width"], r["height"], r["values"]) for r in got) == [(f"00{k}.png", 2, 1, [k, 2]) for k in range(3)]
