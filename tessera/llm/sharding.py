"""Sharding by weighted rendezvous hashing.

Every record scores every shard: -weight / ln(u) with u in (0, 1) from the MD5 of the record's key and the shard's name; the
best score has the record. So a record depends on nothing but its key and the shards, and if a shard comes or goes only
the records that it wins or held move, a share equal to its weight's. No shuffle; one pass over the keys.

The key is the doc_id; a row without one has the MD5 of its text (of the empty text if that is null too), read only
for such rows. Rows with equal keys share a shard. Ties, which need equal hashes, go to the first shard in order of name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 32 shards, the first eight of twice the weight.
SHARDS = {f"shard-{k:04d}": 2.0 if k < 8 else 1.0 for k in range(32)}


def record_key(doc_id: Column, text: Column) -> Column:
    return F.when(doc_id.isNull(), F.concat(F.lit("t"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))).otherwise(doc_id.cast("string"))


def shard_of(key: Column, shards: dict[str, float] = SHARDS) -> Column:
    """The name of the shard that wins a key."""
    if not shards or any(not 0 < w < math.inf for w in shards.values()):
        raise ValueError("shards need positive, finite weights")
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(shards.items())])

    def score(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), s["name"])), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        return s["weight"] / -F.log(u)

    scored = F.transform(table, lambda s: F.struct(score(s).alias("score"), s["name"].alias("name")))
    best = F.aggregate(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("name")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return best["name"]


def sharded(docs: DataFrame, shards: dict[str, float] = SHARDS) -> DataFrame:
    """(doc_id, key, shard) for every row of docs; other columns are ignored."""
    keyed = docs.select("doc_id", record_key(F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.select("doc_id", "key", shard_of(F.col("key"), shards).alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: dict[str, float] = SHARDS, files: int = 4) -> str:
    """docs as Parquet in one folder for each shard, in at most `files` files each; returns the name of the folders' column.

    It is `shard`, after as many underscores as are needed for docs not to have it: all columns of docs are written as they
    are. A table without rows has no folders.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    key = record_key(F.col("doc_id"), F.col("text"))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    docs.withColumn(name, shard_of(key, shards)).repartition(len(shards) * files, name, part).write.partitionBy(name).parquet(path)
    return name


def sharding_sql(table: str = "documents", shards: dict[str, float] = SHARDS) -> str:
    """sharded(table) in DuckDB's SQL."""
    values = ", ".join(f"('{n}', {float(w)}::DOUBLE)" for n, w in sorted(shards.items()))
    return f"""
WITH keyed AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN 't' || md5(coalesce(text, '')) ELSE CAST(doc_id AS VARCHAR) END AS key FROM {table}),
shards(name, weight) AS (VALUES {values}),
scored AS (SELECT r, doc_id, key, name, weight / -ln((CAST(CAST('0x' || substr(md5(key || '|' || name), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656) AS score FROM keyed, shards)
SELECT any_value(doc_id) AS doc_id, any_value(key) AS key, arg_max(name, score) AS shard FROM scored GROUP BY r"""
