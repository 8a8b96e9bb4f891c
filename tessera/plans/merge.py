"""Merging one metadata tree into another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import cut


def merged(volume: DataFrame, about: DataFrame) -> DataFrame:
    """volume's elements with what about adds, both element tables of one root each.

    Children of matched parents match if they have one tag and all attributes that both have are equal (the first such in
    order). A match gets the attributes that it lacks; its own win. Elements of about without a match are added with all
    below them. One join for each level of about.
    """
    none = F.create_map().cast("map<string,string>")
    v = volume.select(F.col("id").alias("v_id"), F.col("parent").alias("v_parent"), F.col("ord").alias("v_ord"), F.col("tag").alias("v_tag"), F.coalesce("attrs", none).alias("v_attrs"))
    a = about.select(F.col("id").alias("a_id"), F.col("parent").alias("a_parent"), "depth", F.col("tag").alias("a_tag"), F.coalesce("attrs", none).alias("a_attrs"))
    pairs = cut(a.where("a_parent is null").crossJoin(v.where("v_parent is null")).where("a_tag = v_tag").select("a_id", "v_id"))
    level, known = pairs, pairs
    shared_equal = F.forall(F.map_keys("a_attrs"), lambda k: F.try_element_at("v_attrs", k).isNull() | (F.try_element_at("v_attrs", k) == F.try_element_at("a_attrs", k)))
    while not level.isEmpty():
        below = a.join(level.select(F.col("a_id").alias("a_parent"), F.col("v_id").alias("v_parent")), "a_parent")
        found = below.join(v, (below["v_parent"] == v["v_parent"]) & (below["a_tag"] == v["v_tag"])).where(shared_equal)
        level = cut(found.groupBy("a_id").agg(F.min_by("v_id", "v_ord").alias("v_id")))
        known = cut(known.union(level))
    more = known.join(a.select("a_id", "a_attrs"), "a_id").groupBy("v_id").agg(F.first("a_attrs").alias("more"))
    out = volume.join(more, F.col("id") == F.col("v_id"), "left")
    own = F.coalesce("attrs", none)
    filled = out.withColumn("attrs", F.map_concat(own, F.map_filter(F.coalesce("more", none), lambda k, x: ~F.map_contains_key(own, k)))).select(*volume.columns)
    new = about.join(known.select(F.col("a_id").alias("id")), "id", "left_anti")
    new = new.join(known.select(F.col("a_id").alias("parent"), "v_id"), "parent", "left").withColumn("parent", F.coalesce("v_id", "parent"))
    return filled.unionByName(new.select(*volume.columns))
