"""A globally ordered capture index by external merge.

A sample of the keys (URL key, then timestamp, then page_id) divides their range into as many parts as the captures' bytes
call for. Every partition of captures is then sorted by itself into a run, and runs are cut at the splitters and into
blocks of some thousand captures, so that each capture moves once, inside a packed block, to the task that merges its range.
There a loser tree merges the runs, decoding one block of a run at a time. A URL with very many captures is divided like
anything else; the numbers in its history are carried from range to range in a summary of one row a range.

The URL key: lower case, without scheme, user, default port, leading "www.", fragment and trailing slash of the path; the
host's labels reversed and joined by commas, then ")", path, and the query's arguments in order.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, small_batches

BLOCK = 2048
#: Of a range, in keys and URLs, and the keys in the sample for each range.
RANGE_BYTES, SAMPLED = 8 << 20, 64
#: The time of page_id 0, and the seconds between one page_id and the next, for tables without capture times.
EPOCH, STEP = 1_704_067_200, 60
CAPTURE = ["key", "urlkey", "timestamp", "page_id", "url", "digest", "length"]


class LoserTree:
    """Merges sorted iterators: `winner` is the one with the least head; each step replays one path of log2(k) matches.

    Heads are (key, source) pairs, so equal keys come in order of their sources. An iterator that ends has the head None,
    which loses to every other.
    """

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        k = len(sources)
        self.tree = [-1] * max(1, k)
        if k:
            self.tree[0] = self._play(1)

    def _play(self, node: int) -> int:
        k = len(self.sources)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._less(b, a):
            a, b = b, a
        self.tree[node] = b
        return a

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return False
        return y is None or x[0] < y[0] or (x[0] == y[0] and a < b)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.sources)
        if not k:
            return
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.sources[w], None)
            node = (w + k) // 2
            while node:
                if self._less(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.tree[0] = w


def url_key(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(url)), "#.*$", ""), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    labels = F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, ":[0-9]+$", ""), "[.]")), ","), F.regexp_extract(host, ":[0-9]+$", 0))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/$", "")
    query = F.regexp_replace(rest, "^[^?]*[?]?", "")
    arguments = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(labels, F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), arguments)))


def captures(pages: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """(urlkey, timestamp, page_id, url, digest, length): a capture for each row with a url. Timestamps have 14 digits; by
    default they follow from page_id (EPOCH, STEP), a null one is 0. A null html has the digest of the empty text."""
    page = F.col("page_id").cast("long")
    if timestamp is None:
        timestamp = F.timestamp_seconds(F.lit(EPOCH) + page * STEP)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    made = pages.where(F.col("url").isNotNull()).select(
        url_key(F.col("url")).alias("urlkey"),
        F.coalesce(F.date_format(timestamp.cast("timestamp_ntz"), "yyyyMMddHHmmss"), F.lit("0" * 14)).alias("timestamp"),
        page.alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.md5(html).alias("digest"),
        F.octet_length(html).cast("long").alias("length"),
    )
    return made


def keyed(found: DataFrame) -> DataFrame:
    """Captures with the key that they are ordered by: its page_id has 20 digits that sort as the numbers do, negative ones too."""
    number = F.coalesce(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit(""))
    return found.withColumn("key", F.concat_ws("\u0000", F.col("urlkey"), F.col("timestamp"), number)).select(*CAPTURE)


def splitters(rows: DataFrame, ranges: int | None = None) -> list[str]:
    """At most ranges - 1 keys in order, from a sample of SAMPLED keys for each range. By default a range has some RANGE_BYTES of keys and URLs."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("url") + 64), F.lit(0))).first()
    ranges = ranges or -(-size // RANGE_BYTES)
    if ranges <= 1:
        return []
    some = rows.select("key").sample(min(1.0, SAMPLED * ranges / n), seed=1)
    firsts = some.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first"))
    return sorted({r["first"] for r in firsts.collect()})[1:]


def runs(rows: DataFrame, edges: list[str]) -> DataFrame:
    """(range, run, block, captures, data): every partition of keyed captures sorted and packed in blocks, each inside of one
    of the ranges that the edges divide. Each capture is in one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, number, held, size, now = uuid.uuid4().hex, 0, [], 0, 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            values = (now, run, number, size, sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["range", "run", "block", "captures", "data"])

        for batch in batches:
            keys, at = batch.column("key").to_pylist(), 0
            while at < len(keys):
                mine = bisect.bisect_right(edges, keys[at])
                if held and (mine != now or size == BLOCK):
                    yield packed()
                    held, size, number = [], 0, number + 1
                now = mine
                end = len(keys) if mine == len(edges) else bisect.bisect_left(keys, edges[mine], at)
                end = min(end, at + BLOCK - size)
                held.append(batch.slice(at, end - at))
                size, at = size + end - at, end
        if held:
            yield packed()

    return rows.sortWithinPartitions("key").mapInArrow(pack, "range int, run string, block int, captures long, data binary")


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of whole ranges, sorted by range, run and block, to captures in order with their range and history."""

    def captures_of(blocks: list[bytes]) -> Iterator[tuple]:
        for data in blocks:
            table = pa.ipc.open_stream(data).read_all()
            yield from zip(*(table.column(c).to_pylist() for c in CAPTURE))

    def one(r: int, runs: dict[str, list[bytes]]) -> Iterator[pd.DataFrame]:
        rows, position, capture, urlkey, digest = [], 0, 0, None, None
        for row in LoserTree([captures_of(b) for b in runs.values()]):
            capture, digest = (capture + 1, digest) if row[1] == urlkey else (1, None)
            urlkey = row[1]
            rows.append((r, position, capture, digest, *row[1:]))
            digest = row[5]
            position += 1
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=MERGED)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=MERGED)

    now, runs = None, {}
    for frame in frames:
        for r, run, data in zip(frame["range"], frame["run"], frame["data"]):
            if r != now and now is not None:
                yield from one(now, runs)
                runs = {}
            now = r
            runs.setdefault(run, []).append(data)
    if now is not None:
        yield from one(now, runs)


MERGED = ["range", "local", "capture", "before", "urlkey", "timestamp", "page_id", "url", "digest", "length"]
MERGED_TYPES = "range int, local long, capture long, before string, urlkey string, timestamp string, page_id long, url string, digest string, length long"


def merged_index(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """(position, urlkey, timestamp, page_id, url, digest, length, capture, changed) for each capture, in global order:
    position counts from 0 over all, capture from 1 within a urlkey, and changed says whether the digest differs from
    that of the capture before (true for the first). Equal captures are all kept; a null page_id sorts first.

    The merged parts are written one a range, each in order; `position` is the order over all of them.
    """
    spark = found.sparkSession
    small_batches(spark)
    rows = keyed(found)
    edges = splitters(rows, ranges)
    path = scratch_path(spark, "runs")
    runs(rows, edges).write.option("compression", "none").parquet(path)
    blocks = spark.read.parquet(path).select("range", "run", "block", "data")
    path = scratch_path(spark, "merged")
    blocks.repartitionById(len(edges) + 1, F.col("range")).sortWithinPartitions("range", "run", "block").mapInPandas(_merge, MERGED_TYPES).write.parquet(path)
    merged = spark.read.parquet(path)
    ends = merged.groupBy("range").agg(F.count("*").alias("n"), F.min("local").alias("zero"), *[F.min_by(c, "local").alias(f"first_{c}") for c in ("urlkey", "digest")], *[F.max_by(c, "local").alias(f"last_{c}") for c in ("urlkey", "digest", "capture")])
    carried, position, urlkey, digest, capture = [], 0, None, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["range"]):  # one row a range
        same = r["first_urlkey"] == urlkey
        carried.append((r["range"], position, r["first_urlkey"], capture if same else 0, digest if same else None))
        position += r["n"]
        capture = r["last_capture"] + (capture if same and r["last_urlkey"] == urlkey else 0)
        urlkey, digest = r["last_urlkey"], r["last_digest"]
    table = F.broadcast(spark.createDataFrame(carried, "range int, base long, head string, past long, past_digest string"))
    joined = merged.join(table, "range")
    head = F.col("urlkey") == F.col("head")
    before = F.when(head & (F.col("capture") == 1), F.col("past_digest")).otherwise(F.col("before"))
    return joined.select((F.col("base") + F.col("local")).alias("position"), "urlkey", "timestamp", "page_id", "url", "digest", "length", (F.col("capture") + F.when(head, F.col("past")).otherwise(0)).alias("capture"), (before.isNull() | (before != F.col("digest"))).alias("changed"))


def captures_sql(table: str = "pages") -> str:
    """merged_index(captures(table)) in DuckDB's SQL."""
    return f"""
WITH a AS (SELECT *, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS bare FROM {table} WHERE url IS NOT NULL),
b AS (SELECT *, regexp_replace(bare, '^[^/?]*', '') AS rest,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host FROM a),
c AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/$', '') AS path, regexp_replace(rest, '^[^?]*[?]?', '') AS query FROM b),
d AS (SELECT array_to_string(list_reverse(string_split(regexp_replace(host, ':[0-9]+$', ''), '.')), ',') || regexp_extract(host, ':[0-9]+$') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS urlkey,
  coalesce(strftime(make_timestamp(({EPOCH} + page_id * {STEP}) * 1000000), '%Y%m%d%H%M%S'), '00000000000000') AS timestamp,
  page_id, url, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length FROM c)
SELECT row_number() OVER (ORDER BY urlkey, timestamp, page_id NULLS FIRST) - 1 AS position, *,
  row_number() OVER h AS capture, coalesce(lag(digest) OVER h <> digest, true) AS changed
FROM d WINDOW h AS (PARTITION BY urlkey ORDER BY timestamp, page_id NULLS FIRST)"""
