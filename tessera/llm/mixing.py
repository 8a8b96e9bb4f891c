"""Mixing sources to target weights by capped water-filling.

Each source should get its weight's share of a budget of characters, but no source is repeated more than `max_epochs`
times. Sources whose share is beyond that are clamped to it, and what they leave is divided among the others by weight,
until no other is beyond its cap. With r = cap / weight rising, the clamped sources are a prefix: source j is clamped if
its r is at most (budget - the caps before it) / (the weights from it on). That level is found in one ordered pass over
the sources' totals (a table of sources, not of documents), so there is no loop.

Every document of a source with e = given / size epochs is repeated floor(e) times, and once more if a seeded hash of its
doc_id is below the fraction. Hashes come of MD5, so that any engine draws the same sample.

Defined results: a null source is a source of its own, with weight `other` if weights are given by name and don't name it.
A text's size is its number of characters, at least 1 (null and empty texts too, so that every source has a size). If
the budget is beyond all caps every source is at its cap. Rows with equal doc_id draw the same number. Rows with null
doc_id are drawn by the MD5 of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Weights are sizes to this power if none are given by name.
TEMPER, MAX_EPOCHS, SEED = 0.5, 4.0, 17


def _size(text: Column) -> Column:
    return F.greatest(F.coalesce(F.length(text), F.lit(1)), F.lit(1)).cast("long")


def allocation(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, max_epochs: float = MAX_EPOCHS, temper: float = TEMPER, other: float = 0.0) -> DataFrame:
    """(source, size, weight, given, epochs) for each source. budget: characters in all, by default as many as docs has."""
    totals = docs.select(F.col("source").cast("string").alias("source"), _size(F.col("text").cast("string")).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temper)))
    else:
        weight = F.lit(float(other))
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    totals = totals.withColumn("weight", weight)
    everything = Window.partitionBy(F.lit(1))  # over sources
    cap = F.col("size") * float(max_epochs)
    totals = totals.withColumn("budget", F.sum("size").over(everything).cast("double") if budget is None else F.lit(float(budget))).withColumn("cap", cap)
    rising = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_first())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    level = F.when(F.sum("weight").over(after) > 0, (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    filled = totals.withColumn("level", level).withColumn("clamped", (F.col("weight") > 0) & (F.col("cap") <= F.col("level") * F.col("weight")))
    # the level of the first source that isn't clamped holds for all of them: those with no weight are last and get nothing
    free = F.first(F.when(~F.col("clamped"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = F.when(F.col("clamped"), F.col("cap")).when(F.col("weight") > 0, F.greatest(F.lit(0.0), free * F.col("weight"))).otherwise(F.lit(0.0))
    return filled.withColumn("given", given).select("source", "size", "weight", "given", (F.col("given") / F.col("size")).alias("epochs"))


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _repeated(rows: DataFrame, doc_id: str, text: str, source: str, shares: DataFrame, seed: int) -> DataFrame:
    """rows once for each repetition, with _copy from 1. Sources join null-safely; their table is small against the rows."""
    # written, so that its size is known before the join is planned: within the broadcast threshold documents aren't shuffled
    epochs = written(shares.select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs")), "shares")
    joined = rows.join(epochs, F.col(source).cast("string").eqNullSafe(F.col("_source")))
    whole = F.floor("_epochs")
    times = (whole + F.when(_draw(F.col(doc_id), F.col(text), seed) < F.col("_epochs") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_source", "_epochs", "_times")


def sampled(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, **kwargs) -> DataFrame:
    """(doc_id, source, copy): one row for each repetition of each row of docs."""
    shares = allocation(docs, weights, budget, max_epochs, **kwargs)
    # the text is read for its draw only where there is no doc_id
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("_text"))
    return _repeated(rows, "doc_id", "_text", "source", shares, seed).select("doc_id", "source", F.col("_copy").alias("copy"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, **kwargs) -> DataFrame:
    """docs with each row as often as it is drawn; all columns stay as they are, whatever their names."""
    shares = allocation(docs, weights, budget, max_epochs, **kwargs)
    names = [f"_{k}" for k in range(len(docs.columns))]
    of = {c: n for c, n in zip(docs.columns, names)}
    made = _repeated(docs.toDF(*names), of["doc_id"], of["text"], of["source"], shares, seed)
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def mixing_sql(table: str = "documents", max_epochs: float = MAX_EPOCHS, temper: float = TEMPER, seed: int = SEED, columns: str = "doc_id, source, copy") -> str:
    """sampled(table) in DuckDB's SQL."""
    return f"""
WITH docs AS (SELECT * FROM {table}),
totals AS (SELECT source, CAST(sum(greatest(coalesce(length(text), 1), 1)) AS BIGINT) AS size FROM docs GROUP BY source),
weighted AS (SELECT *, pow(CAST(size AS DOUBLE), {temper}) AS weight, CAST(sum(size) OVER () AS DOUBLE) AS budget, size * CAST({max_epochs} AS DOUBLE) AS cap FROM totals),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
filled AS (SELECT *, cap <= level * weight AS clamped FROM levels),
free AS (SELECT arg_min(level, cap / weight) AS free FROM filled WHERE NOT clamped),
shares AS (SELECT source, CASE WHEN clamped THEN cap ELSE greatest(0, free * weight) END / size AS epochs FROM filled LEFT JOIN free ON true),
drawn AS (SELECT d.*, epochs, CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 AS u
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
times AS (SELECT *, CAST(floor(epochs) + CASE WHEN u < epochs - floor(epochs) THEN 1 ELSE 0 END AS INTEGER) AS n FROM drawn)
SELECT {columns} FROM (SELECT *, unnest(range(1, n + 1))::INTEGER AS copy FROM times WHERE n > 0)"""
