import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import aggregates, graph, joins, lineage, raster, select, sets, upsert, windows
from tessera.streaming import logs


def ints(spark, values, name="section"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def edges(df):
    return sorted((r["control"], r["mapped"]) for r in df.select("control", "mapped").collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_registration_tree(spark):
    assert edges(graph.registration_tree(ints(spark, range(1, 11)), 6)) == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (6, 7), (7, 8), (8, 9), (9, 10)]
    assert edges(graph.registration_tree(ints(spark, [7]), 3)) == [] and edges(graph.registration_tree(ints(spark, []), 3)) == []


@pytest.mark.parametrize(("k", "extra"), [(1, {(6, 8)}), (2, {(4, 8), (6, 9)})])
def test_section_added_again(spark, k, extra):
    """A tree without section 7, then with it: edges of the first that the second lacks are kept."""
    before = graph.registration_tree(ints(spark, [2, 3, 4, 6, 8, 9]), 5, k)
    after = graph.registration_tree(ints(spark, [2, 3, 4, 6, 7, 8, 9]), 5, k)
    changed = graph.reconciled(before, after)
    assert set(edges(changed.where("change = 'kept'"))) - set(edges(after)) == extra
    assert set(edges(graph.reconciled(before, after, mirror=True).where("change <> 'removed'"))) == set(edges(after))


def test_excluded_sections(spark):
    tree = graph.with_excluded(graph.registration_tree(ints(spark, [2, 4]), 2), ints(spark, [2, 4]), ints(spark, [1, 3, 9]))
    assert edges(tree) == [(2, 1), (2, 3), (2, 4), (4, 9)]


def test_long_chain_and_cycle(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit(1.5).alias("dx"))
    loop = spark.createDataFrame([(1000, 1001, 1.0), (1001, 1000, 1.0), (1002, 1001, 1.0)], "node long, parent long, dx double")
    got = {r["node"]: (r["root"], r["depth"], r["dx"]) for r in graph.to_roots(chain.union(loop), ["dx"]).collect()}
    assert got == {k: (0, k, 1.5 * k) for k in range(1, 200)}
    assert edges(graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "control long, mapped long"))) == [(1, 2), (1, 3)]


def test_composed(spark):
    t = "node long, parent long, a double, b double, c double, d double, tx double, ty double"
    child = spark.createDataFrame([(2, 1, 0.0, -1.0, 1.0, 0.0, 5.0, 6.0)], t)
    parent = spark.createDataFrame([(1, 0, 2.0, 0.0, 0.0, 2.0, 1.0, 1.0)], t)
    assert tuple(graph.composed(child.drop("x"), parent, "parent").first())[2:] == (0.0, -2.0, 2.0, 0.0, 11.0, 13.0)


def test_sets(spark):
    base, even = ints(spark, [1, 2, 3, 4, 5]), ints(spark, [2, 4])
    less = sets.unmarked(base, even)
    assert sorted(r[0] for r in less.collect()) == [1, 3, 5]
    assert sorted(r[0] for r in sets.marked(less, even).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r[0] for r in sets.common(base, even).collect()) == [2, 4]
    m = spark.createDataFrame([(3, [4]), (4, [5, 6]), (4, [10]), (9, []), (1, [2])], "control long, mapped array<long>")
    assert {r["control"]: r["mapped"] for r in sets.valid_mappings(m, ints(spark, [1])).collect()} == {3: [4], 4: [5, 6, 10]}


@pytest.mark.parametrize(("a", "b", "p", "same"), [("1.001", "1", 0, True), ("1.001", "1", 2, True), ("1.001", "1", 3, False), ("255.5", "256", 0, True), ("x", "x", None, True), (None, None, None, True), (None, "1", None, False), ("1", "1.0", None, True)])
def test_rounded_compare(spark, a, b, p, same):
    assert one(spark, select.values_equal(F.lit(a), F.lit(b), p)) is same


def test_prune(spark):
    rows = spark.createDataFrame([(s, float(k)) for s in (1, 2) for k in range(10)] + [(3, None), (3, 2.0)], "section long, score double")
    assert raster.pruned(rows, ["section"], "score", 5 - 0.01).groupBy("section").count().where("section < 3").collect()[0]["count"] == 5
    assert raster.pruned(rows, ["section"], "score", 5 - 0.01).where("section = 3").count() == 2, "refused"
    assert raster.pruned(rows, ["section"], "score", None).where("section = 3").count() == 1


def test_predicates(spark):
    rows = spark.createDataFrame([("Raw8",), ("raw16",), (None,)], "n string")
    assert rows.where(select.matches("n", "raw")).count() == 2 and rows.where(select.matches("n", "raw", True)).count() == 1
    assert rows.where(select.matches("n", "*")).count() == 3 and rows.where(select.matches("n", "(?!Raw)")).count() == 0
    assert rows.where(select.in_set("n", None)).count() == 3 and rows.where(select.in_set("n", [])).count() == 0
    have = F.create_map(*[F.lit(x) for x in ("a", "1", "b", "2")])
    assert one(spark, select.mismatched(have, {"a": "1", "b": "3", "c": "4"})) == ["b", "c"]


def test_levels(spark):
    have = spark.createDataFrame([("i", d) for d in (1.0, 4.0, 16.0)], "image string, downsample double")
    want = spark.createDataFrame([("i", 4.0), ("i", 8.0), ("i", 1.0), ("j", 2.0)], "image string, downsample double")
    got = lambda f, c: {(r["image"], r["downsample"]): r[c] for r in f(have, want, ["image"]).collect()}
    assert got(joins.finer_level, "finer") == {("i", 4.0): 1.0, ("i", 8.0): 4.0, ("i", 1.0): None, ("j", 2.0): None}
    assert got(joins.coarser_level, "coarser") == {("i", 4.0): 16.0, ("i", 8.0): 16.0, ("i", 1.0): 4.0, ("j", 2.0): None}
    assert got(joins.level_by_halving, "source_level") == {("i", 4.0): 4.0, ("i", 8.0): 4.0, ("i", 1.0): 1.0, ("j", 2.0): None}
    assert raster.tileset_levels(5, 3) == [(2, 3, 2), (4, 2, 1)] and raster.tileset_levels(8, 8, last=2) == [(2, 4, 4)]


def test_lineage(spark):
    inputs = spark.createDataFrame([("a", "t1", "stos", "c1", None), ("b", "t2", "stos", "c2", "0 0 5 5")], "id string, name string, type string, checksum string, crop string")
    derived = spark.createDataFrame([("a",), ("b",)], "id string")
    stamped = lineage.stamped(derived, inputs, ["id"])
    now = inputs.withColumn("checksum", F.when(F.col("id") == "b", "new").otherwise(F.col("checksum"))).select("id", *[F.col(s.removeprefix("input_")).alias(f"now_{s}") for s in lineage.STAMP])
    got = {r["id"]: r["m"] for r in stamped.join(now, "id").select("id", lineage.lineage_matches().alias("m")).collect()}
    assert got == {"a": True, "b": False}
    assert one(spark, lineage.contrast_mismatched(F.lit(10.2), F.lit(20.0), F.lit(0.9), (10, 20, 0.9))) is False
    assert one(spark, lineage.contrast_mismatched(F.lit(None).cast("double"), F.lit(20.0), F.lit(0.9), (10, 20, 0.9))) is True
    assert one(spark, lineage.reusable(F.lit(True), F.lit(False))) is True


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k long, v string")
    assert sorted(tuple(r) for r in upsert.inserted(t, new, ["k"]).collect()) == [(1, "a", False), (2, "b", False), (3, "c", True)]
    again = upsert.inserted(upsert.inserted(t, new, ["k"]).drop("added"), new, ["k"])
    assert again.where("added").count() == 0, "idempotent"
    e = spark.createDataFrame([(1, 2)], "control long, mapped long")
    assert edges(upsert.with_edge(upsert.with_edge(e, 1, 3), 1, 3)) == [(1, 2), (1, 3)] and edges(upsert.without_edge(e, 1, 2)) == []
    f = spark.createDataFrame([(1, 5.0, 6.0, 1.0, True)], "id long, low double, high double, gamma double, locked boolean")
    assert tuple(upsert.with_contrast(f, F.lit(True), math.nan, 9.0, math.nan).first()) == (1, 5.0, 9.0, 1.0, False)
    assert tuple(upsert.with_contrast(f, F.lit(True), math.nan, math.nan, math.nan).first()) == (1, 5.0, 6.0, 1.0, True)


def test_best_of(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 1.0), (2, "d", None), (3, "e", None), (3, "f", None)], "m long, t string, cost double")
    assert {(r["m"], r["t"]) for r in aggregates.best_of(rows, ["m"], "cost", ["t"]).collect()} == {(1, "b"), (2, "d")}


def test_windows(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "2020-01-01", 2), ("a", "2020-01-01", 3), ("b", None, 4)], "k string, d string, o long")
    assert {r["o"] for r in windows.latest_by_key(rows, ["k"], "d", ["o"]).collect()} == {2, 4}
    n = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), ("c", 2)], "g string, n long")
    assert {(r["g"], r["n"]) for r in windows.numbered_from_zero(n, ["g"], "n").collect()} == {("a", 0), ("a", 1), ("b", 0), ("c", 2)}
    assert {(r["g"], r["n"]) for r in windows.numbered_from_zero(n, ["g"], "n", False).collect()} == {("a", 0), ("a", 1), ("b", 0), ("c", 1)}


def test_histogram_and_cutoffs(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    counts = aggregates.histogram(rows, "v", 10)
    assert [r["n"] for r in counts.orderBy("bucket").collect()] == [10] * 9 + [11]
    c = aggregates.cutoffs(counts, 0.15, 0.15, 10).first()
    assert (c["low_cutoff"], c["high_cutoff"]) == (10.0, 90.0)
    assert aggregates.histogram(rows.where("v < 0"), "v", 10).count() == 0
    same = aggregates.histogram(rows.where("v = 5"), "v", 10).collect()
    assert [(r["bucket"], r["n"]) for r in same] == [(0, 1)]
    with pytest.raises(Exception, match="minimum cutoff"):
        aggregates.chosen_cutoffs(spark.createDataFrame([(9.0, 2.0, None, None, None)], "low_cutoff double, high_cutoff double, user_low double, user_high double, user_gamma double")).collect()


def test_integrity(spark):
    f = spark.createDataFrame([(1, "c", "f"), (2, "c", "f")], "section long, channel string, filter string")
    t = spark.createDataFrame([(1, "c", "f", 2, "c", "f"), (1, "c", "g", 2, "c", "f"), (1, "c", "f", 3, "c", "f"), (1, "c", "f", 2, "d", "f")], "control long, control_channel string, control_filter string, mapped long, mapped_channel string, mapped_filter string")
    assert sorted(str(r["reason"]) for r in joins.integrity(t, f).collect()) == ["None", "control filter missing", "mapped channel missing", "mapped section missing"]
    assert joins.valid_transforms(t, f).count() == 1
    assert joins.filter_pairs(spark.createDataFrame([(1, 2)], "control long, mapped long"), f, "C", "F").count() == 1


def test_cascade(spark):
    e = spark.createDataFrame([(0, None, False), (1, 0, False), (2, 1, True), (3, 0, True), (4, 3, False)], "id long, parent long, locked boolean")
    assert sorted(r["id"] for r in lineage.cleaned(e, e.where("id in (1, 3)")).collect()) == [0, 3, 4]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.as_ints(lit("3, 1,x,3"))) == [1, 3]
    assert tuple(one(spark, S.crop_box(lit("10 20")))) == (0.0, 0.0, 10.0, 20.0) and tuple(one(spark, S.crop_box(lit("1 2 3 4")))) == (1.0, 2.0, 3.0, 4.0)
    assert one(spark, S.tile_number(lit("/x/0012.png"))) == 12 and one(spark, S.tile_width(lit("0012.png"))) == 4 and one(spark, S.tile_number(lit("a12.png"))) is None
    assert one(spark, S.joined_path(lit("http://a/"), lit(None).cast("string"), lit("/b"), lit(""))) == "http://a/b"
    assert one(spark, S.relative_path(lit("/a/b/c"), lit("/a/"))) == "b/c"
    assert one(spark, S.plain_text_of_rtf(lit(r"{\rtf1{\fonttbl{\f0 Arial;}}\f0\fs20 Hello\par World}"))) == "Hello\nWorld"
    assert one(spark, S.seconds_text(lit(3725.9))) == "1:02:05"
    assert tuple(one(spark, S.fitted(lit(2000), lit(1000), 1024, 1024))) == (1024, 512) and tuple(one(spark, S.fitted(lit(10), lit(10), 1024, 1024))) == (10, 10)
    assert one(spark, S.gamma_at(lit(5.0), lit(0.0), lit(10.0))) == pytest.approx(1.0) and one(spark, S.gamma_at(lit(0.0), lit(0.0), lit(0.0))) == 1.0
    assert one(spark, S.fingerprint(lit(None), lit("a"))) != one(spark, S.fingerprint(lit(""), lit("a")))
    assert one(spark, S.version_compatible(lit("A"), lit(1.3), {"A": 1.2})) and not one(spark, S.version_compatible(lit("B"), lit(1.3), {"A": 1.2}))
    assert [one(spark, S.kind_of(lit(x))) for x in ("true", "5", "5.5", "x")] == ["bool", "int", "float", "str"]
    assert one(spark, S.bit_mask(lit(0.0), lit(255.0), 16)) == 255


def test_raster(spark):
    px = spark.createDataFrame([(0, y, x, float(4 * y + x)) for y in range(4) for x in range(4)], "t long, y int, x int, v double")
    assert {(r["downsample"], r["y"], r["x"]): r["v"] for r in raster.tile_pyramid(px, ["t"], [2, 4]).collect()} == {(2, 0, 0): 2.5, (2, 0, 1): 4.5, (2, 1, 0): 10.5, (2, 1, 1): 12.5, (4, 0, 0): 7.5}
    with pytest.raises(ValueError):
        raster.tile_pyramid(px, ["t"], [2, 3])
    assert [one(spark, raster.stretched(F.lit(v), 10, 0, 1.0)) for v in (-1.0, 5.0, 11.0)] == [0.0, 0.5, 1.0]
    flat = raster.unshaded(px, raster.shading(px, ["t"]), ["t"], bright=True).where("v <> 0").select("v").distinct().collect()
    assert [r["v"] for r in flat] == [7.5]


def test_volume_and_imported_transforms(spark):
    ch = spark.createDataFrame([(1, "TEM"), (2, "TEM"), (3, "TEM"), (2, "Other")], "section long, channel string")
    tr = spark.createDataFrame([(s, c, t) for s, c in ((1, "TEM"), (2, "TEM"), (3, "TEM"), (2, "Other")) for t in ("Grid", "ToVolume")], "section long, channel string, transform string")
    e = spark.createDataFrame([(1, 2)], "control long, mapped long")
    got = graph.volume_transforms(ch, tr, e, "tem", "ToV").collect()
    assert sorted((r["section"], r["transform"]) for r in got) == [(1, "ToVolume"), (2, "ToVolume")]
    t = spark.createDataFrame([(1, 5.0, 1.0), (2, 6.0, 1.0)], "id long, dx double, downsample double")
    new = spark.createDataFrame([(2, 3.0, 8.0, 4.0), (3, 1.0, 2.0, 2.0)], "id long, dx double, control_downsample double, mapped_downsample double")
    out = graph.imported_transforms(t, new, ["id"], ["dx"]).collect()
    assert sorted((r["id"], r["dx"], r["downsample"], r["change"]) for r in out) == [(1, 5.0, 1.0, "kept"), (2, 6.0, 4.0, "replaced"), (3, 1.0, 2.0, "added")]


def test_completed_stream_is_in_files(spark, sf_dir):
    """No memory sink holds the result, the session's settings stay, and a stream without events has an empty result."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    done = logs.completed(logs.sessions(logs.events(spark, sf_dir), late="100 days"))
    assert all("/stream-" in f for f in done.inputFiles()) and done.inputFiles() and done.columns == ["user_id", "start", "end", "n"]
    assert done.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept
    none = logs.completed(logs.events(spark, sf_dir).where("false").withWatermark("ts", "1 hour").groupBy("user_id").count())
    assert none.count() == 0 and none.columns == ["user_id", "count"]


def test_closure_reads_its_edges_once(spark):
    """However deep the graph."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    chain = spark.range(1, 6).select(F.col("id").alias("control"), (F.col("id") + 1).alias("mapped")).mapInPandas(counted, "control long, mapped long")
    assert edges(graph.closure(chain)) == [(1, k) for k in range(2, 7)]
    assert seen.value == 5
