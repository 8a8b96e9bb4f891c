"""Registration graphs: trees over sections, roots, closures, composed transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import cut
from tessera.operators.select import matches
from tessera.operators.upsert import replaced


def nearest_section(sections: DataFrame, wanted: int) -> DataFrame:
    """One row: the eligible section nearest to the wanted one, the smaller of two."""
    rank = F.struct(F.abs(F.col("section") - wanted).alias("d"), F.col("section").alias("s"))
    return sections.agg(F.min(rank)["s"].alias("center"))


def registration_tree(sections: DataFrame, center: int, k: int = 1) -> DataFrame:
    """(control, mapped): each eligible section maps the next k away from the center; the center, or the section nearest to
    it, maps k on either side.

    The band join is an equality of ranks: every control is repeated k times (twice that for the center), never compared
    with all others. Ranks need one order over the sections of a volume, which are some thousands at most.
    """
    ranked = sections.select("section").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("section")))
    mid = nearest_section(sections, center)
    controls = ranked.crossJoin(F.broadcast(mid))
    steps = F.sequence(F.lit(1), F.lit(k))
    signed = F.when(F.col("section") > F.col("center"), steps).when(F.col("section") < F.col("center"), F.transform(steps, lambda x: -x)).otherwise(F.concat(steps, F.transform(steps, lambda x: -x)))
    wanted = controls.select(F.col("section").alias("control"), F.col("rank").alias("_rank"), F.explode(signed).alias("_step")).select("control", (F.col("_rank") + F.col("_step")).alias("rank"))
    return wanted.join(ranked.withColumnRenamed("section", "mapped"), "rank").select("control", "mapped")


def with_excluded(tree: DataFrame, eligible: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sections that may not be controls are leaves of the eligible section nearest to them, the smaller of two."""
    pairs = excluded.select(F.col("section").alias("mapped")).crossJoin(eligible.select(F.col("section").alias("control")))
    nearest = pairs.groupBy("mapped").agg(F.min(F.struct(F.abs(F.col("control") - F.col("mapped")).alias("d"), "control"))["control"].alias("control"))
    return tree.unionByName(nearest.select("control", "mapped"))


def reconciled(stored: DataFrame, tree: DataFrame, mirror: bool = False) -> DataFrame:
    """(control, mapped, change) of stored edges against a tree: "added", "kept" or "removed". A mirror keeps nothing else;
    otherwise only edges of controls that the tree lacks are removed."""
    both = stored.select("control", "mapped").distinct().withColumn("_s", F.lit(True)).join(tree.select("control", "mapped").distinct().withColumn("_t", F.lit(True)), ["control", "mapped"], "full")
    if mirror:
        change = F.when(F.col("_s").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("kept")
        return both.select("control", "mapped", change.alias("change"))
    controls = tree.select("control").distinct().withColumn("_c", F.lit(True))
    change = F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed").otherwise("kept")
    return both.join(controls, "control", "left").select("control", "mapped", change.alias("change"))


def roots(edges: DataFrame) -> DataFrame:
    """(section): controls that nothing maps."""
    return edges.select(F.col("control").alias("section")).distinct().join(edges.select(F.col("mapped").alias("section")), "section", "left_anti")


def to_roots(parents: DataFrame, sums: list[str] = []) -> DataFrame:
    """(node, root, depth, sums): for each node of a forest (node, parent, sums) its root and the sums along the path to it;
    roots are the nodes without a row, or with a null parent.

    Pointer doubling: each round lets every node skip to where its present ancestor points, so a chain of n sections takes
    log2(n) joins. Nodes on or below a cycle never reach a root and have none in the result.
    """
    now = parents.where("parent is not null").select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), *sums)
    now = cut(now)
    most = max(1, now.count()).bit_length() + 1
    for _ in range(most):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *[F.col(s).alias(f"_{s}") for s in sums])
        joined = now.join(up, "root", "left")
        zero = F.lit(0)
        after = cut(joined.select("node", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", zero)).alias("depth"), *[(F.col(s) + F.coalesce(f"_{s}", zero)).alias(s) for s in sums], F.col("_root").isNotNull().alias("_moved")))
        moved = not after.where("_moved").isEmpty()
        now = after.drop("_moved")
        if not moved:
            return now
    return now.join(parents.where("parent is not null").select(F.col("node").alias("root")), "root", "left_anti").select("node", "root", "depth", *sums)


def closure(edges: DataFrame) -> DataFrame:
    """(control, mapped): every section that can be reached from a root, mapped directly to it, also where sections have
    several controls. Cycles end by themselves: a pair is found once. What edges are made of is read once, not in each round."""
    edges = cut(edges.select("control", "mapped").distinct())
    top = roots(edges).withColumnRenamed("section", "control")
    pairs = cut(edges.join(top, "control", "left_semi"))
    new = pairs
    while not new.isEmpty():
        step = new.join(edges.select(F.col("control").alias("mapped"), F.col("mapped").alias("_next")), "mapped").select("control", F.col("_next").alias("mapped")).distinct()
        new = cut(step.join(pairs, ["control", "mapped"], "left_anti"))
        pairs = cut(pairs.union(new))
    return pairs


def composed(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Affine transforms (a, b, c, d, tx, ty) applied one after the other: child then parent, matched by child.on = parent.node."""
    p = parent.select(F.col("node").alias(on), *[F.col(x).alias(f"p_{x}") for x in ("a", "b", "c", "d", "tx", "ty")])
    j = child.join(p, on)
    m = lambda i, k: F.col(f"p_{i}") * F.col(k)
    return j.select("node", on, (m("a", "a") + m("b", "c")).alias("a"), (m("a", "b") + m("b", "d")).alias("b"), (m("c", "a") + m("d", "c")).alias("c"), (m("c", "b") + m("d", "d")).alias("d"), (m("a", "tx") + m("b", "ty") + F.col("p_tx")).alias("tx"), (m("c", "tx") + m("d", "ty") + F.col("p_ty")).alias("ty"))


def rescaled(transforms: DataFrame, columns: list[str], given: float, wanted: float) -> DataFrame:
    """Translations between levels."""
    return transforms.select(*[(F.col(x) * (given / wanted)).alias(x) if x in columns else F.col(x) for x in transforms.columns])


def moved_tiles(tiles: DataFrame, transforms: DataFrame, on: list[str]) -> DataFrame:
    """Tile positions through their section's affine transform; tiles of sections without one go."""
    x, y = F.col("x"), F.col("y")
    return tiles.join(transforms, on).withColumn("_x", F.col("a") * x + F.col("b") * y + F.col("tx")).withColumn("y", F.col("c") * x + F.col("d") * y + F.col("ty")).withColumn("x", F.col("_x")).drop("_x", "a", "b", "c", "d", "tx", "ty")


def volume_transforms(channels: DataFrame, transforms: DataFrame, edges: DataFrame, channel_pattern: str | None, transform_pattern: str | None) -> DataFrame:
    """Transforms whose name and channel match, of the sections that a map has on either side."""
    inside = edges.select(F.col("control").alias("section")).union(edges.select(F.col("mapped").alias("section"))).distinct()
    chosen = channels.where(matches("channel", channel_pattern)).join(inside, "section", "left_semi")
    return transforms.where(matches("transform", transform_pattern)).join(chosen.select("section", "channel").distinct(), ["section", "channel"], "left_semi")


def imported_transforms(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """External transforms put in place of those with the same keys. Where control and mapped side are at different levels
    (control_downsample, mapped_downsample), translations are brought to the finer one, which is the result's `downsample`."""
    finer = F.least("control_downsample", "mapped_downsample")
    scaled = rows.select(*[(F.col(x) * F.col("control_downsample") / finer).alias(x) if x in columns else F.col(x) for x in rows.columns if not x.endswith("_downsample")], finer.alias("downsample"))
    return replaced(table, scaled, keys)
