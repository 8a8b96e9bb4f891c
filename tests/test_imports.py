import struct

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.plans import imports, merge, pipeline
from tessera.sources import dm4, elements, texts


def tag(name, body, kind=21):
    raw = name.encode()
    return struct.pack(">BH", kind, len(raw)) + raw + struct.pack(">q", len(body)) + body


def data(info, value):
    return b"%%%%" + struct.pack(f">q{len(info)}q", len(info), *info) + value


def folder(*tags):
    return struct.pack(">bbq", 1, 0, len(tags)) + b"".join(tags)


def made_dm4(little):
    o = "<" if little else ">"
    text = lambda s: data([20, 4, len(s)], s.encode("utf-16-le" if little else "utf-16-be"))
    num = lambda v: data([5], struct.pack(o + "I", v))
    dimension = lambda s: tag("", folder(tag("Scale", data([6], struct.pack(o + "f", s))), tag("Units", text("nm"))), 20)
    image = folder(
        tag("Calibrations", folder(tag("Dimension", folder(dimension(2.0), dimension(4.0)), 20)), 20),
        tag("Data", data([20, 4, 6], struct.pack(o + "6H", 1, 2, 3, 4, 5, 600))),
        tag("DataType", num(10)),
        tag("Dimensions", folder(tag("", num(3)), tag("", num(2))), 20),
        tag("PixelDepth", num(2)),
    )
    root = folder(tag("Pair", data([15, 0, 2, 0, 3, 0, 6], struct.pack(o + "if", 7, 0.5))), tag("ImageList", folder(tag("", folder(), 20), tag("", folder(tag("ImageData", image, 20)), 20)), 20))
    return struct.pack(">iqi", 4, len(root), int(little)) + root


@pytest.mark.parametrize("little", [True, False])
def test_dm4(spark, tmp_path, little):
    raw = made_dm4(little)
    assert dm4.tags_of(raw)["Pair"] == [7, 0.5]
    (tmp_path / "a.dm4").write_bytes(raw)
    r = dm4.images(dm4.tags(spark, str(tmp_path / "*.dm4"))).first()
    assert tuple(r)[1:8] == (3, 2, 10, 16, 2.0, 4.0, "nm")
    px = dm4.pixels(spark, str(tmp_path / "*.dm4")).first()
    assert (px["width"], px["height"], px["values"]) == (3, 2, [1, 2, 3, 4, 5, 600])


def test_import(spark, tmp_path):
    for n, spacing in ((12, 21.76), (13, 20.0)):
        d = tmp_path / f"{n:04d}_name_x"
        d.mkdir()
        (d / "a.idoc").write_text(f"DataMode = 1\nPixelSpacing = {spacing}\n[Image = 1.tif]\nPieceCoordinates = 10 20 0\nMinMaxMean = 5 200 90\n[Image = 2.tif]\nPieceCoordinates = 30 5 0\nMinMaxMean = 7 255 80\n")
    overrides = texts.contrast_overrides(spark.createDataFrame([("o", "13 1 100 0.5")], "file string, text string"))
    flips = texts.flip_list(spark.createDataFrame([("f", "12")], "file string, text string"))
    there = spark.createDataFrame([(12, "000.png")], "section int, target string")
    out = imports.captures(spark, str(tmp_path / "*/*.idoc"), overrides, flips, existing=there)
    s = {r["section"]: r for r in out["sections"].collect()}
    assert (s[12]["min"], s[12]["max"], s[12]["gamma"], s[12]["bits"], s[12]["flipped"], s[12]["section_name"]) == (5.0, 255.0, 1.0, 16, True, "name_x")
    assert (s[13]["min"], s[13]["max"], s[13]["gamma"], s[13]["flipped"]) == (1.0, 100.0, 0.5, False) and s[12]["nm_per_pixel"] == pytest.approx(2.176)
    tiles = sorted((r["section"], r["target"], r["x"], r["y"]) for r in out["tiles"].collect())
    assert tiles == [(n, f"00{k}.png", x, y) for n in (12, 13) for k, x, y in ((0, 0, 15), (1, 20, 0))]
    assert sorted((r["section"], r["target"]) for r in out["work"].collect()) == [(12, "001.png"), (13, "000.png"), (13, "001.png")]


def test_merge(spark):
    parse = lambda x: elements.parsed(spark.createDataFrame([(str(hash(x)), x)], "file string, text string"))
    v = parse('<V Name="v"><S Number="1" A="own"/><S Number="2"/></V>')
    a = parse('<V Host="h"><S Number="1" A="own" B="b"><N/></S><S Number="3"><M/></S></V>')
    out = merge.merged(v, a)
    got = {(r["tag"], r["attrs"].get("Number"), tuple(sorted(r["attrs"].items()))) for r in out.collect()}
    assert got == {("V", None, (("Host", "h"), ("Name", "v"))), ("S", "1", (("A", "own"), ("B", "b"), ("Number", "1"))), ("S", "2", (("Number", "2"),)), ("N", None, ()), ("S", "3", (("Number", "3"),)), ("M", None, ())}
    parents = {r["tag"]: r["p"] for r in out.alias("x").join(out.select(F.col("id").alias("pid"), F.concat("tag", F.coalesce(F.col("attrs")["Number"], F.lit(""))).alias("p")), F.col("parent") == F.col("pid")).where("tag in ('N', 'M')").collect()}
    assert parents == {"N": "S1", "M": "S3"}


@pipeline.function
def section_numbers(rows, elements, **kwargs):
    return rows.join(elements.select(F.col("id").alias("S"), F.col("attrs")["Number"].alias("number")), "S").select("number")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "VolumeData.xml").write_text('<Volume><Section Number="1"/><Section Number="2"/></Volume>')
    (tmp_path / "p.xml").write_text('<P><Pipeline Name="Numbers"><Arguments><Argument flag="-Sections" dest="Sections" type="IntegerList"/></Arguments><Iterate XPath="Section" VariableName="S"><RequireSetMembership Attribute="Number" List="#Sections"/><PythonCall Function="section_numbers"/></Iterate></Pipeline><Pipeline Name="Bad"><Nothing/></Pipeline></P>')
    assert cli.main([str(tmp_path / "p.xml"), str(tmp_path), "Numbers", "-Sections", "2-5"]) == 0
    printed = capsys.readouterr().out
    assert "|2 " in printed and "|1 " not in printed
    assert cli.main([str(tmp_path / "p.xml"), str(tmp_path), "Bad"]) == 1
