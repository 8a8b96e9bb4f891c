"""The operators as queries over the relational tables, with their SQL.

lineitem stands for tiles (section l_suppkey, score l_quantity, intensity l_extendedprice), embeddings for 8 by 8 rasters,
events for an acquisition log, suppliers for sections, documents for notes.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import aggregates, graph, joins, lineage, raster, select, sets, upsert, windows
from tessera.plans import paths, pipeline
from tessera.sources.tables import Tables, registry
from tessera.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


def _tiles(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("section"), F.col("l_quantity").alias("score"))


def _pixels(t: Tables) -> DataFrame:
    return raster.pixels(t.embeddings, "embedding", 8, ["vec_id", "label"])


PIXELS = "px AS (SELECT vec_id, label, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, v::DOUBLE AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"


# Pruning and histograms


@query("""
SELECT section, count(*) AS tiles, sum(CASE WHEN keep THEN 1 ELSE 0 END)::BIGINT AS kept, count(*) - sum(CASE WHEN keep THEN 1 ELSE 0 END)::BIGINT AS removed FROM (
  SELECT l_suppkey AS section, l_quantity >= 45.5 OR max(l_quantity) OVER (PARTITION BY l_suppkey) < 45.5 AS keep FROM lineitem) GROUP BY section""")
def prune_sections(t):
    tiles = _tiles(t)
    kept = raster.pruned(tiles, ["section"], "score", 45.5).groupBy("section").agg(F.count("*").alias("kept"))
    every = tiles.groupBy("section").agg(F.count("*").alias("tiles"))
    n = F.coalesce("kept", F.lit(0)).cast("long")
    return every.join(kept, "section", "left").select("section", "tiles", n.alias("kept"), (F.col("tiles") - n).alias("removed"))


@query("""
WITH s AS (SELECT l_suppkey AS section, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) AS sd, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT *, least(greatest(CASE WHEN sd > 0 THEN ceil(round((hi - lo) / (sd / 10), 6))::BIGINT ELSE 10 END, 10), n) AS bins FROM s)
SELECT section, bins, CASE WHEN hi > lo THEN greatest(0, least(floor((l_quantity - lo) / (hi - lo) * bins)::BIGINT, bins - 1)) ELSE 0 END AS bucket, count(*) AS n
FROM lineitem JOIN b ON l_suppkey = section GROUP BY ALL""")
def prune_histogram(t):
    return aggregates.score_histogram(_tiles(t), "score", ["section"])


HISTOGRAM = """h AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem),
counts AS (SELECT CASE WHEN high > low THEN greatest(0, least(floor((l_extendedprice - low) / (high - low) * 64)::BIGINT, 63)) ELSE 0 END AS bucket, low, high, count(*) AS n FROM lineitem, h GROUP BY ALL)"""


@query(f"WITH {HISTOGRAM} SELECT bucket, low, high, n FROM counts")
def intensity_histogram(t):
    return aggregates.histogram(t.lineitem, "l_extendedprice", 64)


@query(f"""
WITH {HISTOGRAM}, c AS (SELECT *, sum(n) OVER (ORDER BY bucket) / (SELECT sum(n) FROM counts) AS up, sum(n) OVER (ORDER BY bucket DESC) / (SELECT sum(n) FROM counts) AS down FROM counts)
SELECT round(min(CASE WHEN up > 0.05 THEN low + (high - low) * bucket / 64 END), 6) AS low_cutoff, round(max(CASE WHEN down > 0.02 THEN low + (high - low) * (bucket + 1) / 64 END), 6) AS high_cutoff FROM c""")
def autolevel_cutoffs(t):
    counts = aggregates.histogram(t.lineitem, "l_extendedprice", 64)
    found = aggregates.cutoffs(counts, 0.05, 0.02, 64)
    return found.select(F.round("low_cutoff", 6).alias("low_cutoff"), F.round("high_cutoff", 6).alias("high_cutoff"))


@query("""
WITH a AS (SELECT l_suppkey AS section, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
o AS (SELECT s_suppkey AS section, CASE WHEN s_suppkey % 5 = 0 THEN 100.5 END AS user_low, CASE WHEN s_suppkey % 7 = 0 THEN 90000.25 END AS user_high, CASE WHEN s_suppkey % 3 = 0 THEN 0.8 END AS user_gamma FROM supplier)
SELECT section, coalesce(user_low, floor(lo)) AS low, coalesce(user_high, ceil(hi)) AS high, coalesce(user_gamma, 1.0)::DOUBLE AS gamma FROM a LEFT JOIN o USING (section)""")
def requested_cutoffs(t):
    auto = t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.min("l_extendedprice").alias("low_cutoff"), F.max("l_extendedprice").alias("high_cutoff"))
    k = F.col("s_suppkey")
    asked = t.supplier.select(k.alias("section"), F.when(k % 5 == 0, 100.5).alias("user_low"), F.when(k % 7 == 0, 90000.25).alias("user_high"), F.when(k % 3 == 0, 0.8).alias("user_gamma"))
    return aggregates.chosen_cutoffs(auto.join(asked, "section", "left")).select("section", "low", "high", "gamma")


@query("""
SELECT l_suppkey AS section, round(CASE WHEN p > 0 AND p < 1 THEN greatest(0.1, least(10, ln(0.5) / ln(p))) ELSE 1 END, 6) AS gamma
FROM (SELECT l_suppkey, (avg(l_extendedprice) - min(l_extendedprice)) / nullif(max(l_extendedprice) - min(l_extendedprice), 0) AS p FROM lineitem GROUP BY 1)""")
def gamma_at_mean(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.avg("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return g.select("section", F.round(S.gamma_at("mean", "lo", "hi"), 6).alias("gamma"))


@query("""
SELECT l_suppkey AS section, least(max(l_extendedprice), 65536) AS max, greatest(min(least(l_extendedprice, 65536)), 0) AS min, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""")
def image_statistics(t):
    tiles = t.lineitem.select(F.col("l_suppkey").alias("section"), F.col("l_extendedprice").alias("max"), F.col("l_extendedprice").alias("min"), F.col("l_quantity").alias("mean"))
    return aggregates.image_statistics(tiles, ["section"], camera_bits=16).withColumn("mean", F.round("mean", 6))


# Contrast and rasters


@query("""
WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 1000.0 END AS low, CASE WHEN s_suppkey % 6 = 0 THEN 80000.0 END AS high FROM supplier WHERE s_suppkey % 2 = 0)
SELECT section, coalesce(o.low, a.lo)::DOUBLE AS low, coalesce(o.high, a.hi)::DOUBLE AS high FROM (SELECT l_suppkey AS section, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) a LEFT JOIN o ON section = s_suppkey""")
def contrast_lookup(t):
    auto = t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    k = F.col("s_suppkey")
    override = t.supplier.where(k % 2 == 0).select(k.alias("section"), F.when(k % 4 == 0, 1000.0).alias("low"), F.when(k % 6 == 0, 80000.0).alias("high"))
    return joins.with_default(auto, override, ["section"], ["low", "high"])


@query(f"""WITH {PIXELS} SELECT vec_id, y, x, round(pow(least(greatest((v + 0.2) / 0.4, 0), 1), 1 / 0.7), 6) AS v FROM px""")
def contrast_stretch(t):
    return _pixels(t).select("vec_id", "y", "x", F.round(raster.stretched("v", -0.2, 0.2, 0.7), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 65535 - l_extendedprice AS inverted FROM lineitem")
def invert(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", raster.inverted("l_extendedprice", 16).alias("inverted"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > 65535 THEN l_extendedprice - 65535 ELSE l_extendedprice END AS v FROM lineitem")
def repaired_pixels(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.out_of_range_repaired("l_extendedprice", 16).alias("v"))


@query(f"""WITH {PIXELS},
a AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px GROUP BY ALL), b AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM a GROUP BY ALL)
SELECT vec_id, 2 AS downsample, y, x, round(v, 6) AS v FROM a UNION ALL SELECT vec_id, 4, y, x, round(v, 6) FROM b""")
def tile_pyramid(t):
    return raster.tile_pyramid(_pixels(t), ["vec_id"], [2, 4]).select("vec_id", "downsample", "y", "x", F.round("v", 6).alias("v"))


@query("""
WITH cells AS (SELECT label, (vec_id % 50 // 7)::INTEGER AS cx, (vec_id % 50 % 7)::INTEGER AS cy, sum(embedding[1]::DOUBLE) AS v FROM embeddings GROUP BY ALL)
SELECT label, cx // 2 AS gx, cy // 2 AS gy, round(sum(v) / 4, 6) AS v FROM cells GROUP BY ALL""")
def tileset_level(t):
    k = F.col("vec_id") % 50
    cells = t.embeddings.groupBy("label", F.floor(k / 7).cast("int").alias("tile_x"), (k % 7).cast("int").alias("tile_y")).agg(F.sum(F.col("embedding")[0].cast("double")).alias("v"))
    return raster.next_tileset_level(cells, ["label"]).select("label", F.col("tile_x").alias("gx"), F.col("tile_y").alias("gy"), F.round("v", 6).alias("v"))


@query(f"WITH {PIXELS} SELECT label, y, x, round(min(v), 6) AS shade FROM px GROUP BY ALL")
def shade_image(t):
    return raster.shading(_pixels(t), ["label"], "min").select("label", "y", "x", F.round("shade", 6).alias("shade"))


@query(f"WITH {PIXELS}, s AS (SELECT label, y, x, avg(v) AS shade FROM px GROUP BY ALL) SELECT vec_id, y, x, round(v - shade, 6) AS v FROM px JOIN s USING (label, y, x)")
def shade_apply(t):
    px = _pixels(t)
    return raster.unshaded(px, raster.shading(px, ["label"]), ["label"]).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {PIXELS} SELECT vec_id, y, x, round(v - min(v) OVER (PARTITION BY vec_id), 6) AS v FROM px")
def min_correction(t):
    return raster.less_minimum(_pixels(t), ["vec_id"]).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {PIXELS} SELECT a.vec_id AS control, a.vec_id + 1 AS mapped, round(avg(abs(a.v - b.v)), 6) AS difference FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1")
def pixel_diff(t):
    px = _pixels(t).select(F.col("vec_id").alias("pair"), "y", "x", "v")
    moved = px.withColumn("pair", F.col("pair") - 1)
    d = raster.difference(px, moved, ["pair"])
    return d.groupBy(F.col("pair").alias("control")).agg(F.round(F.avg("v"), 6).alias("difference")).select("control", (F.col("control") + 1).alias("mapped"), "difference")


@query(f"WITH {PIXELS}, d AS (SELECT unnest([-1, 0, 1]) AS k) SELECT p.vec_id, p.y, p.x, round(median(q.v), 6) AS v FROM px p, d a, d b, px q WHERE p.vec_id < 200 AND q.vec_id = p.vec_id AND q.y = p.y + a.k AND q.x = p.x + b.k GROUP BY ALL")
def blob_filter(t):
    px = _pixels(t).where("vec_id < 200")
    return raster.blobs(px, ["vec_id"]).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {PIXELS}, i AS (SELECT unnest(range(9)) AS i), t AS (SELECT DISTINCT vec_id, y // 3 AS ty, x // 3 AS tx FROM px),
e AS (SELECT vec_id, tx, ty, (i % 3)::INTEGER AS x, (i // 3)::INTEGER AS y FROM t, i)
SELECT e.vec_id, e.tx, e.ty, e.y, e.x, round(coalesce(px.v, 0), 6) AS v FROM e LEFT JOIN px ON px.vec_id = e.vec_id AND px.x = e.tx * 3 + e.x AND px.y = e.ty * 3 + e.y""")
def image_to_grid(t):
    cells = raster.cut_to_grid(_pixels(t), ["vec_id"], 3)
    return cells.select("vec_id", F.col("tile_x").alias("tx"), F.col("tile_y").alias("ty"), "y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {PIXELS} SELECT label, y, x, round(arg_min(v, (abs(y - 3.5) + abs(x - 3.5) + vec_id % 11) * 1000000 + vec_id), 6) AS v FROM px GROUP BY ALL")
def assemble_nearest(t):
    px = _pixels(t).withColumn("tile", F.col("vec_id")).withColumn("distance", F.abs(F.col("y") - 3.5) + F.abs(F.col("x") - 3.5) + F.col("vec_id") % 11)
    return raster.assembled(px, ["label"], "distance").withColumn("v", F.round("v", 6))


@query("SELECT floor(l_extendedprice / 4096)::BIGINT AS gx, floor(l_quantity / 8)::BIGINT AS gy, count(*) AS tiles FROM lineitem GROUP BY ALL")
def grid_assign(t):
    cells = raster.in_grid(t.lineitem.select("l_extendedprice", "l_quantity"), 4096, 8, "l_extendedprice", "l_quantity")
    return cells.groupBy(F.col("tile_x").alias("gx"), F.col("tile_y").alias("gy")).agg(F.count("*").alias("tiles"))


@query("SELECT l_suppkey AS section, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - min(l_extendedprice) OVER w, 6) AS x, l_quantity - min(l_quantity) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def zero_origin(t):
    tiles = t.lineitem.select(F.col("l_suppkey").alias("section"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return aggregates.to_zero_origin(tiles, ["section"]).withColumn("x", F.round("x", 6))


@query("SELECT l_suppkey AS section, min(l_extendedprice) AS x0, min(l_quantity) AS y0, max(l_extendedprice + 512.0::DOUBLE) AS x1, max(l_quantity + 512.0::DOUBLE) AS y1 FROM lineitem GROUP BY 1")
def volume_bounds(t):
    tiles = t.lineitem.select(F.col("l_suppkey").alias("section"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit(512.0).alias("width"), F.lit(512.0).alias("height"))
    return aggregates.bounds(tiles, ["section"])


@query("SELECT min(l_tax + 1) AS units_per_pixel, 'nm' AS unit FROM lineitem")
def volume_scale(t):
    return aggregates.volume_scale(t.lineitem.select((F.col("l_tax") + 1).alias("units_per_pixel"), F.lit("nm").alias("unit")))


@query("""SELECT p_partkey, floor(p_size / 4.0)::BIGINT AS x, floor(p_retailprice / 4)::BIGINT AS y, ceil((p_size + 7) / 4.0)::BIGINT AS width, ceil((p_retailprice + 7) / 4)::BIGINT AS height FROM part""")
def crop_downsampled(t):
    d = lambda x: x.cast("double")
    box = F.struct(d(F.col("p_size")).alias("x"), d(F.col("p_retailprice")).alias("y"), d(F.col("p_size") + 7).alias("width"), (F.col("p_retailprice") + 7).alias("height"))
    return t.part.select("p_partkey", S.crop_at(box, 4.0).alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, floor(p_size * s)::BIGINT AS width, floor(p_retailprice * s)::BIGINT AS height FROM (SELECT *, 1.0::DOUBLE / greatest(p_size::DOUBLE / 32, p_retailprice / 1024, 1) AS s FROM part)""")
def fitted_dimensions(t):
    return t.part.select("p_partkey", S.fitted("p_size", "p_retailprice", 32, 1024).alias("d")).select("p_partkey", "d.width", "d.height")


@query("SELECT p_partkey, (pow(2, least(ceil(log2(greatest(p_retailprice, 1) + 1))::INTEGER, 12)) - 1)::BIGINT AS mask FROM part")
def bit_masks(t):
    return t.part.select("p_partkey", S.bit_mask(F.lit(0.0), "p_retailprice", 12).alias("mask"))


# Registration


@query("""
SELECT l_partkey AS mapped, l_suppkey AS control, l_extendedprice AS mean, candidates FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_partkey) AS candidates FROM lineitem) WHERE r = 1""")
def best_registration(t):
    c = t.lineitem.select(F.col("l_partkey").alias("mapped"), F.col("l_suppkey").alias("control"), F.col("l_extendedprice").alias("mean"), "l_orderkey", "l_linenumber")
    return aggregates.best_of(c, ["mapped"], "mean", ["control", "l_orderkey", "l_linenumber"]).select("mapped", "control", "mean", "candidates")


@query("""
WITH s AS (SELECT s_suppkey AS section, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier WHERE s_suppkey % 9 <> 4),
m AS (SELECT arg_min(section, abs(section - 40) * 100000 + section) AS c FROM s),
k AS (SELECT unnest([-2, -1, 1, 2]) AS k)
SELECT a.section AS control, b.section AS mapped FROM s a, m, k, s b WHERE b.r = a.r + k AND (a.section = c OR (a.section > c AND k > 0) OR (a.section < c AND k < 0))""")
def registration_tree(t):
    return graph.registration_tree(t.supplier.where("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("section")), 40, 2)


PARENTS = "e AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey >= 3 THEN s_suppkey // 3 END AS parent, s_nationkey::DOUBLE AS dx, s_acctbal AS dy FROM supplier)"


def _parents(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("node"), F.when(k >= 3, F.floor(k / 3)).alias("parent"), F.col("s_nationkey").cast("double").alias("dx"), F.col("s_acctbal").alias("dy"))


@query(f"""WITH RECURSIVE {PARENTS}, r AS (SELECT node, parent AS root, 1 AS depth FROM e WHERE parent IS NOT NULL
UNION ALL SELECT r.node, e.parent, depth + 1 FROM r JOIN e ON e.node = r.root WHERE e.parent IS NOT NULL)
SELECT node, arg_max(root, depth) AS root, max(depth)::BIGINT AS depth FROM r GROUP BY node""")
def to_root_closure(t):
    return graph.to_roots(_parents(t).select("node", "parent"))


@query(f"""WITH RECURSIVE {PARENTS}, r AS (SELECT node, parent AS root, 1 AS depth, dx, dy FROM e WHERE parent IS NOT NULL
UNION ALL SELECT r.node, e.parent, depth + 1, r.dx + e.dx, r.dy + e.dy FROM r JOIN e ON e.node = r.root WHERE e.parent IS NOT NULL)
SELECT node, arg_max(root, depth) AS root, round(arg_max(dx, depth), 4) AS dx, round(arg_max(dy, depth), 4) AS dy FROM r GROUP BY node""")
def slice_to_volume(t):
    return graph.to_roots(_parents(t), ["dx", "dy"]).select("node", "root", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


EDGES = "e AS (SELECT DISTINCT l_suppkey // 10 AS control, l_suppkey AS mapped FROM lineitem WHERE l_suppkey >= 10 UNION SELECT DISTINCT 1 + l_suppkey // 20, l_suppkey FROM lineitem WHERE l_suppkey >= 30)"


def _edges(t: Tables) -> DataFrame:
    k = F.col("l_suppkey")
    sections = t.lineitem.where(k >= 10).select(k).distinct()
    controls = F.array(F.floor(k / 10), F.when(k >= 30, F.floor(k / 20) + 1))
    return sections.select(F.explode(F.array_compact(F.array_distinct(controls))).alias("control"), k.alias("mapped"))


@query(f"WITH {EDGES} SELECT DISTINCT control AS section FROM e WHERE control NOT IN (SELECT mapped FROM e)")
def roots(t):
    return graph.roots(_edges(t))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT control, mapped FROM e WHERE control NOT IN (SELECT mapped FROM e) UNION SELECT r.control, e.mapped FROM r JOIN e ON e.control = r.mapped) SELECT DISTINCT control, mapped FROM r""")
def root_closure_of_graph(t):
    return graph.closure(_edges(t))


@query(f"WITH {EDGES} SELECT mapped, string_agg(control::VARCHAR, ',' ORDER BY control) AS controls FROM e GROUP BY mapped")
def mapped_to_controls(t):
    return aggregates.mapped_to_controls(_edges(t))


@query(f"""WITH {EDGES}, tr AS (SELECT control, mapped FROM e WHERE mapped % 3 = 0 UNION SELECT mapped, control FROM e WHERE mapped % 11 = 0)
SELECT coalesce(e.control, tr.control) AS control, coalesce(e.mapped, tr.mapped) AS mapped, CASE WHEN e.control IS NULL THEN 'added' WHEN e.control NOT IN (SELECT control FROM tr) THEN 'removed' ELSE 'kept' END AS change
FROM e FULL JOIN tr ON e.control = tr.control AND e.mapped = tr.mapped""")
def reconciled_edges(t):
    e = _edges(t)
    tree = e.where("mapped % 3 = 0").union(e.where("mapped % 11 = 0").select(F.col("mapped").alias("control"), F.col("control").alias("mapped")))
    return graph.reconciled(e, tree)


@query("""
WITH f AS (SELECT DISTINCT n_regionkey AS section, 'c' || (n_nationkey % 3)::VARCHAR AS channel, n_name AS filter FROM nation), e AS (SELECT a.r_regionkey AS control, b.r_regionkey AS mapped FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1)
SELECT e.control, e.mapped, a.channel AS control_channel, a.filter AS control_filter, b.channel AS mapped_channel, b.filter AS mapped_filter
FROM e JOIN f a ON a.section = e.control JOIN f b ON b.section = e.mapped WHERE regexp_matches(a.filter, '^NATION_[0-9]*[1-6]$') AND regexp_matches(b.filter, '^NATION_[0-9]*[1-6]$')""")
def section_pairs(t):
    f = t.nation.select(F.col("n_regionkey").alias("section"), F.concat(F.lit("c"), (F.col("n_nationkey") % 3).cast("string")).alias("channel"), F.col("n_name").alias("filter")).distinct()
    e = t.region.select(F.col("r_regionkey").alias("control"), (F.col("r_regionkey") + 1).alias("mapped")).join(t.region.select(F.col("r_regionkey").alias("mapped")), "mapped", "left_semi")
    return joins.filter_pairs(e, f, None, "nation_[0-9]*[1-6]$")


@query("""
WITH m AS (SELECT DISTINCT s_suppkey AS section FROM supplier WHERE s_suppkey % 2 = 0), x AS (SELECT s_suppkey AS section, s_acctbal AS dx FROM supplier WHERE s_suppkey % 4 = 0)
SELECT l.section, l.tiles, x.dx FROM (SELECT l_suppkey AS section, count(*) AS tiles FROM lineitem GROUP BY 1) l LEFT JOIN x USING (section) WHERE l.section NOT IN (SELECT section FROM m) OR x.dx IS NOT NULL""")
def mosaic_to_volume(t):
    ch = t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.count("*").alias("tiles"))
    edges = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("mapped"))
    tr = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("section"), F.col("s_acctbal").alias("dx"))
    return joins.volume_mapping(ch, edges, tr)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(0.8 * l_extendedprice - 0.6 * l_quantity + s_acctbal, 4) AS x, round(0.6 * l_extendedprice + 0.8 * l_quantity + s_nationkey, 4) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 = 1""")
def tiles_through_transform(t):
    tiles = t.lineitem.select(F.col("l_suppkey").alias("section"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    n = lambda v: F.lit(float(v))
    tr = t.supplier.where("s_suppkey % 3 = 1").select(F.col("s_suppkey").alias("section"), n(0.8).alias("a"), n(-0.6).alias("b"), n(0.6).alias("c"), n(0.8).alias("d"), F.col("s_acctbal").alias("tx"), F.col("s_nationkey").cast("double").alias("ty"))
    return graph.moved_tiles(tiles, tr, ["section"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT s_suppkey AS section, round(s_acctbal * (8.0::DOUBLE / 2.0), 6) AS dx FROM supplier")
def rescaled_transforms(t):
    return graph.rescaled(t.supplier.select(F.col("s_suppkey").alias("section"), F.col("s_acctbal").alias("dx")), ["dx"], 8.0, 2.0).withColumn("dx", F.round("dx", 6))


# Levels


LEVELS = "lv AS (SELECT DISTINCT p_brand AS image, p_size AS downsample FROM part WHERE p_size % 3 = 0), w AS (SELECT DISTINCT p_brand AS image, p_size AS downsample FROM part)"


def _levels(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = t.part.select(F.col("p_brand").alias("image"), F.col("p_size").alias("downsample")).distinct()
    return w.where("downsample % 3 = 0"), w


@query(f"WITH {LEVELS} SELECT w.image, w.downsample, max(lv.downsample) AS finer FROM w LEFT JOIN lv ON lv.image = w.image AND lv.downsample < w.downsample GROUP BY ALL")
def asof_finer(t):
    return joins.finer_level(*_levels(t), ["image"])


@query(f"WITH {LEVELS} SELECT w.image, w.downsample, min(lv.downsample) AS coarser FROM w LEFT JOIN lv ON lv.image = w.image AND lv.downsample > w.downsample GROUP BY ALL")
def asof_coarser(t):
    return joins.coarser_level(*_levels(t), ["image"])


@query(f"WITH {LEVELS}, k AS (SELECT unnest(range(8)) AS k) SELECT w.image, w.downsample, max(lv.downsample)::DOUBLE AS source_level FROM w LEFT JOIN k ON true LEFT JOIN lv ON lv.image = w.image AND lv.downsample * pow(2, k) = w.downsample GROUP BY ALL")
def level_by_halving(t):
    return joins.level_by_halving(*_levels(t), ["image"])


@query("""SELECT p_brand AS image, coalesce(max(CASE WHEN 2048 / p_size >= 100 AND p_retailprice / p_size >= 50 THEN p_size END), min(p_size)) AS downsample FROM part GROUP BY 1""")
def downsample_for_size(t):
    lv = t.part.select(F.col("p_brand").alias("image"), F.col("p_size").alias("downsample"), (F.lit(2048.0) / F.col("p_size")).alias("width"), (F.col("p_retailprice") / F.col("p_size")).alias("height"))
    return windows.level_for_size(lv, ["image"], 100, 50)


@query("SELECT image, downsample, row_number() OVER w - 1 AS level_index, min(downsample) OVER (PARTITION BY image) AS finest, max(downsample) OVER (PARTITION BY image) AS coarsest FROM (SELECT DISTINCT p_brand AS image, p_size AS downsample FROM part) WINDOW w AS (PARTITION BY image ORDER BY downsample)")
def level_ranks(t):
    return windows.level_ranks(_levels(t)[1], ["image"])


@query("""SELECT l_suppkey AS section, count(*) AS files, CASE WHEN count(*) > 600 THEN 'too many files' WHEN max(l_linenumber) <> 7 - 1 THEN 'last column missing' END AS reason FROM lineitem GROUP BY 1""")
def populated_levels(t):
    lv = t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.count("*").alias("files"), F.lit(600).alias("tiles"), F.max("l_linenumber").alias("last_column"), F.lit(7).alias("grid_x"))
    return aggregates.populated(lv).select("section", "files", "reason")


@query("SELECT l_suppkey AS section, count(*) FILTER (l_returnflag <> 'R') AS tiles_validated, count(*) FILTER (l_returnflag = 'R') AS invalid FROM lineitem GROUP BY 1")
def verified_tiles(t):
    return aggregates.verified(t.lineitem.select(F.col("l_suppkey").alias("section"), (F.col("l_returnflag") != "R").alias("valid")), ["section"])


# Tiles and references


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def missing_targets(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return select.missing(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def existing_tiles(t):
    there = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return select.existing(t.orders.select("o_orderkey", "o_totalprice"), there, ["o_orderkey"])


REFERENCES = """f AS (SELECT DISTINCT n_regionkey AS section, n_nationkey % 4 AS channel, n_name AS filter FROM nation),
tr AS (SELECT s_suppkey AS id, s_nationkey % 7 AS control, s_suppkey % 5 AS control_channel, 'NATION_' || s_nationkey::VARCHAR AS control_filter, s_nationkey % 5 AS mapped, s_nationkey % 4 AS mapped_channel, 'NATION_' || (s_suppkey % 25)::VARCHAR AS mapped_filter FROM supplier)"""


def _references(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = t.nation.select(F.col("n_regionkey").cast("long").alias("section"), (F.col("n_nationkey") % 4).cast("long").alias("channel"), F.col("n_name").alias("filter")).distinct()
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    name = lambda x: F.concat(F.lit("NATION_"), x.cast("string"))
    tr = t.supplier.select(k.alias("id"), (n % 7).alias("control"), (k % 5).alias("control_channel"), name(n).alias("control_filter"), (n % 5).alias("mapped"), (n % 4).alias("mapped_channel"), name(k % 25).alias("mapped_filter"))
    return tr, f


@query(f"""WITH {REFERENCES}
SELECT id, CASE WHEN control NOT IN (SELECT section FROM f) THEN 'control section missing'
 WHEN NOT EXISTS (SELECT 1 FROM f WHERE section = control AND channel = control_channel) THEN 'control channel missing'
 WHEN NOT EXISTS (SELECT 1 FROM f WHERE section = control AND channel = control_channel AND filter = control_filter) THEN 'control filter missing'
 WHEN mapped NOT IN (SELECT section FROM f) THEN 'mapped section missing'
 WHEN NOT EXISTS (SELECT 1 FROM f WHERE section = mapped AND channel = mapped_channel) THEN 'mapped channel missing'
 WHEN NOT EXISTS (SELECT 1 FROM f WHERE section = mapped AND channel = mapped_channel AND filter = mapped_filter) THEN 'mapped filter missing' END AS reason FROM tr""")
def referential_clean(t):
    return joins.integrity(*_references(t)).select("id", "reason")


@query(f"WITH {REFERENCES} SELECT id FROM tr WHERE (control, control_channel, control_filter) IN (SELECT section, channel, filter FROM f) AND (mapped, mapped_channel, mapped_filter) IN (SELECT section, channel, filter FROM f)")
def valid_transforms(t):
    return joins.valid_transforms(*_references(t)).select("id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN md5(o_orderpriority) <> md5(CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE 'x' END) ELSE o_orderdate > TIMESTAMP '1998-01-01' END AS stale FROM orders""")
def stale_outputs(t):
    o = t.orders
    recorded = F.when(F.col("o_orderstatus") == "F", F.md5("o_orderpriority"))
    now = F.md5(F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).otherwise("x"))
    return o.select("o_orderkey", lineage.stale(recorded, now, F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")).alias("stale"))


@query("""WITH i AS (SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR || o_orderstatus) AS fingerprint FROM orders),
o AS (SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN 'z' ELSE o_orderstatus END) AS fingerprint, o_orderkey % 6 = 0 AS locked FROM orders WHERE o_orderkey % 5 <> 0)
SELECT id FROM i WHERE fingerprint NOT IN (SELECT fingerprint FROM o) AND id NOT IN (SELECT id FROM o WHERE locked)""")
def incremental_work(t):
    k = F.col("o_orderkey")
    mark = lambda s: F.md5(F.concat(k.cast("string"), s))
    inputs = t.orders.select(k.alias("id"), mark(F.col("o_orderstatus")).alias("fingerprint"))
    outputs = t.orders.where(k % 5 != 0).select(k.alias("id"), mark(F.when(k % 3 == 0, "z").otherwise(F.col("o_orderstatus"))).alias("fingerprint"), (k % 6 == 0).alias("locked"))
    return lineage.to_compute(inputs, outputs).select("id")


@query("""SELECT s_suppkey, NOT (round_even(s_acctbal, 0) IS NOT DISTINCT FROM round_even((s_suppkey * 100)::DOUBLE, 0)) AS mismatched FROM supplier""")
def rounded_mismatch(t):
    return t.supplier.select("s_suppkey", (~select.values_equal("s_acctbal", F.col("s_suppkey") * 100, 0)).alias("mismatched"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 0 THEN s_suppkey // 4 END AS parent, s_suppkey % 7 = 0 AS locked FROM supplier),
g AS (SELECT id FROM e WHERE id % 10 = 4 AND NOT locked UNION SELECT e.id FROM g JOIN e ON e.parent = g.id) SELECT id FROM e WHERE id NOT IN (SELECT id FROM g)""")
def cascade_clean(t):
    k = F.col("s_suppkey")
    e = t.supplier.select(k.alias("id"), F.when(k > 0, F.floor(k / 4)).alias("parent"), (k % 7 == 0).alias("locked"))
    return lineage.cleaned(e, e.where("id % 10 = 4")).select("id")


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) THEN 'region' END AS reason FROM customer""")
def validity_reasons(t):
    n = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("there"))
    rows = t.customer.join(n, "c_nationkey", "left")
    return lineage.validity(rows, [(F.col("c_acctbal") >= 0, "negative"), (F.col("c_mktsegment") != "MACHINERY", "segment"), (F.col("there"), "region")]).select("c_custkey", "reason")


# Upserts


@query("""SELECT c_custkey, c_name, false AS added FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name, true FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def insert_if_absent(t):
    c = t.customer.select("c_custkey", "c_name")
    return upsert.inserted(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), F.col("c_name"))), ["c_custkey"])


@query("""SELECT c_custkey, c_name, 'kept' AS change FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name, CASE WHEN c_custkey % 3 = 0 THEN 'replaced' ELSE 'added' END FROM customer WHERE c_custkey % 2 = 0""")
def replace_rows(t):
    c = t.customer.select("c_custkey", "c_name")
    return upsert.replaced(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), F.col("c_name"))), ["c_custkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def latest_by_key(t):
    return windows.latest_by_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("""WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, o_orderkey FROM orders) SELECT k, min(o_orderkey) AS o_orderkey FROM o WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, o_orderkey FROM o WHERE k IS NULL""")
def first_by_key(t):
    o = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"), "o_orderkey")
    return windows.first_by_key(o, "k", ["o_orderkey"])


@query("SELECT s_suppkey AS section FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity = 50")
def mark_damaged(t):
    return sets.marked(t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("section")), t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("section")))


@query("SELECT s_suppkey AS section FROM supplier EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0")
def mark_undamaged(t):
    s = t.supplier
    return sets.unmarked(s.select(F.col("s_suppkey").alias("section")), s.where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("section")))


@query("SELECT s_suppkey AS section FROM supplier WHERE s_suppkey % 2 = 0 INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def common_sections(t):
    s = t.supplier.select(F.col("s_suppkey").alias("section"))
    return sets.common(s.where("section % 2 = 0"), s.where("section % 3 = 0"))


@query(f"WITH {EDGES} SELECT control, mapped FROM e WHERE control NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 4 = 0)")
def allowed_edges(t):
    banned = t.supplier.where("s_nationkey % 4 = 0").select(F.col("s_suppkey").alias("section"))
    return sets.allowed_edges(_edges(t), banned).select("control", "mapped")


@query("SELECT control, string_agg(mapped::VARCHAR, ',' ORDER BY mapped) AS mapped FROM (SELECT DISTINCT l_linenumber AS control, l_suppkey AS mapped FROM lineitem) GROUP BY control")
def merge_duplicates(t):
    m = t.lineitem.groupBy(F.col("l_linenumber").alias("control"), "l_returnflag").agg(F.collect_list("l_suppkey").alias("mapped"))
    return sets.merged_controls(m.select("control", "mapped")).select("control", S.ints_as_text("mapped").alias("mapped"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, n_name) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'filled') AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def merge_attributes(t):
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    pairs = lambda *x: F.map_from_entries(F.array_compact(F.array(*x)))
    e = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    mine = c.select("c_custkey", pairs(F.when(k % 3 != 0, e("name", F.col("c_name"))), F.when(k % 2 == 0, e("segment", F.col("c_mktsegment")))).alias("attrs"))
    more = c.select("c_custkey", pairs(e("name", F.col("n_name")), e("segment", F.lit("filled"))).alias("attrs"))
    out = upsert.filled_attributes(mine, more, ["c_custkey"])
    return out.select("c_custkey", F.col("attrs")["name"].alias("name"), F.col("attrs")["segment"].alias("segment"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 5.0 ELSE s_acctbal END::DOUBLE AS low, s_acctbal + 1 AS high, CASE WHEN s_nationkey < 10 THEN 0.9 ELSE 1.0 END::DOUBLE AS gamma, s_nationkey >= 10 AS locked FROM supplier""")
def set_contrast(t):
    f = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 1).alias("high"), F.lit(1.0).alias("gamma"), F.lit(True).alias("locked"), "s_nationkey")
    return upsert.with_contrast(f, F.col("s_nationkey") < 10, 5.0, float("nan"), 0.9).drop("s_nationkey")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type, p_type IN ('ECONOMY', 'PROMO') AS changed FROM part")
def migrated_types(t):
    return upsert.renamed(t.part.select("p_partkey", "p_type"), "p_type", {"ECONOMY": "BASIC", "PROMO": "OFFER"})


@query("SELECT o_custkey, o_orderkey, o_orderkey - CASE WHEN min(o_orderkey) OVER (PARTITION BY o_custkey) <> 0 THEN 1 ELSE 0 END AS number FROM orders")
def renumber(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("number"))
    return windows.numbered_from_zero(o, ["o_custkey"], "number", only_from_one=False)


# Predicates and texts


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^(small|red) .*') AND regexp_matches(p_brand, '^Brand#1')")
def channel_filter_match(t):
    return t.part.where(select.matches("p_name", "(small|RED) .*") & select.matches("p_brand", "Brand#1", True)).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def set_membership(t):
    return t.orders.where(select.in_set("o_orderstatus", ["F", "P"]) & select.in_set("o_custkey", None)).select("o_orderkey")


@query("SELECT p_partkey, p_brand, try_cast(substr(p_brand, 7) AS BIGINT) AS section, split_part(p_name, ' ', 2) AS channel, coalesce(nullif(split_part(p_name, ' ', 3), ''), 'Imported') AS filter FROM part")
def filename_parse(t):
    parts = F.split("p_name", " ")
    return t.part.select("p_partkey", "p_brand", S.as_int(F.substring("p_brand", 7, 100)).alias("section"), F.get(parts, F.lit(1)).alias("channel"), F.coalesce(S.blank_to_null(F.get(parts, F.lit(2))), F.lit("Imported")).alias("filter"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(0), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS note FROM documents""")
def notes_clean(t):
    return t.documents.select("doc_id", F.md5(S.note_text("text")).alias("note"))


@query("SELECT s_suppkey, printf('%04d', s_suppkey::INTEGER) || '_' || s_name || '.png' AS name, replace(s_name || ' x', ' ', '_') AS path FROM supplier")
def image_names(t):
    return t.supplier.select("s_suppkey", F.concat(F.concat_ws("_", S.section_name(F.col("s_suppkey").cast("int")), "s_name"), S.dotted(F.lit("png"))).alias("name"), S.without_spaces(F.concat("s_name", F.lit(" x"))).alias("path"))


@query("SELECT l_suppkey AS section, min(l_shipdate) AS modified, arg_min(l_orderkey, l_shipdate::VARCHAR || printf('%012d', l_orderkey)) AS first FROM lineitem GROUP BY 1")
def oldest_file(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("section")).agg(F.min("l_shipdate").alias("modified"), F.min(F.struct("l_shipdate", "l_orderkey"))["l_orderkey"].alias("first"))


# Logs and reports


@query("""SELECT event_id, user_id, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 3) AS dwell,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drift FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def acquisition_timings(t):
    timed = windows.tile_timings(t.events, ["user_id"], "ts", ["event_id"])
    return windows.filled_forward(timed, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "drift").select("event_id", "user_id", "dwell", "drift")


@query("""SELECT user_id, count(*) AS tiles, count(*) FILTER (dwell IS NOT NULL) AS timed_tiles, round(avg(value) FILTER (dwell IS NOT NULL), 6) AS average_drift, max(value) FILTER (dwell IS NOT NULL) AS max_drift, min(value) FILTER (dwell IS NOT NULL) AS min_drift, round(avg(dwell), 6) AS average_time, min(dwell) AS fastest_time
FROM (SELECT user_id, value, CASE WHEN event_type <> 'error' THEN value * 2 END AS dwell FROM events) GROUP BY 1""")
def log_summary(t):
    tiles = t.events.select("user_id", F.col("value").alias("drift"), F.when(F.col("event_type") != "error", F.col("value") * 2).alias("dwell"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    return aggregates.log_summary(tiles, ["user_id"]).drop("total_time").withColumn("average_time", F.round("average_time", 6)).withColumn("average_drift", F.round("average_drift", 6))


@query("""SELECT l_suppkey AS row, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def row_report(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("row")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return p.select("row", *[F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in ("A", "N", "R")])


@query("SELECT p_brand, p_type, count(*) AS parts, grouping(p_brand) * 2 + grouping(p_type) AS level FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_report(t):
    return t.part.cube("p_brand", "p_type").agg(F.count("*").alias("parts"), F.grouping_id().cast("long").alias("level"))


@query("SELECT user_id, count(*) AS events, coalesce(sum((props::JSON->>'k')::BIGINT), 0)::BIGINT AS k FROM events GROUP BY 1")
def json_attributes(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("events"), F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("k"))


@query("""SELECT 'Volume/Section[' || s_suppkey::VARCHAR || ']/' || n_name AS path, n_name AS tag FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def image_report(t):
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select(S.joined_path(F.lit("Volume"), F.concat(F.lit("Section["), F.col("s_suppkey").cast("string"), F.lit("]")), F.col("n_name")).alias("path"), F.col("n_name").alias("tag"))


# Streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(t):
    done = logs.completed(logs.windowed(logs.events(t.spark, t.folder), late="100 days"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def stream_sessions(t):
    done = logs.completed(logs.sessions(logs.events(t.spark, t.folder), late="100 days"))
    return done.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


# Trees: regions hold nations, nations hold suppliers


def _tree(t: Tables) -> DataFrame:
    """Regions, nations and suppliers as elements of one document."""
    text = lambda c: F.col(c).cast("string")
    row = lambda df, i, p, o, tag, **attrs: df.select(i.alias("id"), p.alias("parent"), o.cast("long").alias("ord"), F.lit(tag).alias("tag"), F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]).alias("attrs"))
    root = row(t.spark.range(1), F.lit("v"), F.lit(None).cast("string"), F.col("id"), "Volume", Path=F.lit("/v"))
    r = row(t.region, F.concat(F.lit("r"), text("r_regionkey")), F.lit("v"), F.col("r_regionkey"), "Block", Name=F.col("r_name"), Path=text("r_regionkey"))
    n = row(t.nation, F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey")), F.col("n_nationkey"), "Section", Number=text("n_nationkey"), Path=text("n_nationkey"))
    s = row(t.supplier, F.concat(F.lit("s"), text("s_suppkey")), F.concat(F.lit("n"), text("s_nationkey")), F.col("s_suppkey"), "Channel", Name=F.col("s_name"), Balance=text("s_acctbal"))
    return root.unionByName(r).unionByName(n).unionByName(s)


@query("SELECT s_suppkey::VARCHAR AS supplier FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey > 3 AND s_acctbal < 2000")
def path_matches(t):
    tree = _tree(t)
    found = paths.find_all(tree.where("parent is null"), tree, "Block/Section[@Number>3]/Channel[@Balance<2000]")
    return found.select(F.substring("id", 2, 20).alias("supplier"))


@query("SELECT n_regionkey::VARCHAR AS region, arg_min(s_suppkey, n_nationkey::BIGINT * 10000000 + s_suppkey)::VARCHAR AS first FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def path_first_match(t):
    tree = _tree(t)
    found = paths.find(tree.where("tag = 'Block'"), tree, "Section/Channel", "block")
    return found.select(F.substring("block", 2, 20).alias("region"), F.substring("id", 2, 20).alias("first"))


@query("SELECT s_suppkey::VARCHAR AS supplier, n_nationkey::VARCHAR AS number, '/v/' || n_regionkey || '/' || n_nationkey AS full_path FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def inherited_attributes(t):
    tree = _tree(t)
    channels = tree.where("tag = 'Channel'").select("id")
    number = paths.inherited_attribute(tree, "Number")
    return channels.join(number, "id").join(paths.full_paths(tree), "id").select(F.substring("id", 2, 20).alias("supplier"), F.col("value").alias("number"), "full_path")


PIPELINE = """<Pipeline Name="Balances"><Arguments><Argument flag="-Sections" dest="Sections"/></Arguments>
<Iterate XPath="Block" VariableName="BlockNode"><Iterate XPath="Section" VariableName="SectionNode"><RequireSetMembership Attribute="Number" List="#Sections"/>
<Select XPath="Channel[@Balance>0]" VariableName="ChannelNode"/><RequireMatch Root="#BlockNode" Attribute="Name" RegEx="A"/><PythonCall Function="first_balances" Channel="#ChannelNode"/></Iterate></Iterate></Pipeline>"""


@pipeline.function
def first_balances(rows: DataFrame, elements: DataFrame, Channel: str, **_) -> DataFrame:
    balance = elements.select(F.col("id").alias(Channel), F.try_element_at("attrs", F.lit("Balance")).cast("double").alias("balance"))
    return rows.join(balance, Channel).select(F.substring("SectionNode", 2, 20).alias("section"), F.substring(Channel, 2, 20).alias("channel"), "balance")


@query("""SELECT n_nationkey::VARCHAR AS section, min(s_suppkey)::VARCHAR AS channel, arg_min(s_acctbal, s_suppkey) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE s_acctbal > 0 AND n_nationkey BETWEEN 2 AND 20 AND r_name LIKE 'A%' GROUP BY n_nationkey""")
def pipeline_run(t):
    (made,) = pipeline.run(ElementTree.fromstring(PIPELINE), _tree(t), {"Sections": list(range(2, 21))})
    return made
