"""Approximate nearest neighbours from balanced posting lists (after SPANN, Chen et al. 2021).

Build: vectors are divided by a few rounds of distributed k-means into groups, and each group by repeated balanced
bisection into lists of at most `list_size`, whose means are the centroids. So lists are of like length whatever the
density. Every vector then goes to its nearest centroid and, if others are nearly as near (`spread`), to those too, up to
`replicas`, leaving out a centroid that is nearer to one already chosen than to the vector.

Centroids are searched by a graph in memory: each knows its nearest `degree` others, and a beam search for a whole batch of
queries starts from the nearest of some entry points. Centroids and graph are all that is broadcast. Their size is known
before they are made: where they would exceed `centroid_bytes` lists are made longer until they don't, at any input size.

What a search meets is measured on each table: for a sample of its vectors the true neighbours are found by brute force, and
lists are made longer, or more of them are taken, until the sample meets RECALL of them (`fitted`). On vectors without any
structure that is a fixed share of the table, so work then grows with the square of its size.

Search: each query takes up to `lists` centroids of the beam, and of those the ones no further than `ratio` times its
nearest. Neighbouring lists are held by one task, some WHOLE vectors of them; a vector goes once to each task that holds a
list it's posted in or asks for, with the numbers of those lists. A task answers with the k best of all the lists that a
query asked for there, and those are merged by query.

Vectors are compared by cosine: all are scaled to length 1. A vector that is null, has a null or infinite element, another
length than most or no direction (all zeros) takes no part. Rows with null vec_id take no part; of rows with one vec_id
the one with the least vector counts. Equal distances are ordered by vec_id, but which
of them has the last place is open. A vector isn't its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written

LIST_SIZE, GROUP, DEGREE, REPLICAS, SPREAD = 64, 20_000, 24, 6, 1.2
LISTS, RATIO, BEAM, K = 24, 1.6, 64, 10
RECALL, SAMPLE = 0.94, 256
#: Vectors of the lists that a task holds, and queries that it answers, in about.
WHOLE, ASKING = 8192, 65_536
CENTROID_BYTES = 256 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def prepared(rows: DataFrame) -> DataFrame:
    """(id, v): vectors of length 1 as float32 bytes, one for each vec_id."""
    good = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("e")).where("id is not null and e is not null and size(e) > 0")
    good = good.groupBy("id").agg(F.min("e").alias("e"))
    widths = good.groupBy(F.size("e").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.array([np.asarray(x, np.float64) for x in f["e"]]).reshape(len(f), width).astype(np.float64)
            norm = np.sqrt((m * m).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            m = (m[ok] / norm[ok, None]).astype(np.float32)
            yield pd.DataFrame({"id": f["id"].to_numpy()[ok], "v": [x.tobytes() for x in m]})

    return written(good.where(F.size("e") == width).mapInPandas(scale, "id long, v binary"), "vectors")


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; the first of equal ones. Rows in pieces, so that no product is large."""
    half = (centres * centres).sum(1) / 2
    step = max(1, (4 << 20) // max(1, len(centres)))
    return np.concatenate([(half - x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def bisected(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of x in parts of at most `size`, each cut in halves across the axis between two means."""
    todo, parts = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        y = x[rows]
        a = y[((y - y.mean(0)) ** 2).sum(1).argmax()]
        b = y[((y - a) ** 2).sum(1).argmax()]
        for _ in range(4):
            near = ((y - a) ** 2).sum(1) < ((y - b) ** 2).sum(1)
            if not near.any() or near.all():
                break
            a, b = y[near].mean(0), y[~near].mean(0)
        order = np.argsort(y @ (a - b), kind="stable")
        todo += [rows[order[: len(order) // 2]], rows[order[len(order) // 2 :]]]
    return parts


class Graph:
    """Centroids, each with its nearest others, and entry points: every centroid is one or has an edge from one, so that no cluster is without."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray) -> None:
        self.centroids, self.edges = centroids, edges
        covered, entries = np.zeros(len(centroids) + 1, bool), []
        for k in range(len(centroids)):
            if not covered[k]:
                entries.append(k)
                covered[k] = covered[edges[k]] = True
        self.entries = np.array(entries, np.int64)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids found nearest to each query and their distances, nearest first (-1 and infinite where there are fewer)."""
        parts = [self._search(q[i : i + 512], beam) for i in range(0, len(q), 512)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf, np.float32)
        half = (self.centroids * self.centroids).sum(1) / 2
        if 4 * beam >= len(half):  # as much work as ranking all
            d = half - q @ self.centroids.T
            best = np.argpartition(d, beam - 1, 1)[:, :beam] if beam < d.shape[1] else np.tile(np.arange(d.shape[1]), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), 1, kind="stable"), 1)
            ids[:, : best.shape[1]] = best
            dist[:, : best.shape[1]] = np.sqrt(np.maximum(2 * np.take_along_axis(d, best, 1) + (q * q).sum(1)[:, None], 0))
            return ids, dist
        first = half[self.entries] - q @ self.centroids[self.entries].T
        m = min(8, len(self.entries))
        start = np.argpartition(first, m - 1, 1)[:, :m]
        done = np.ones((n, beam), bool)
        k = min(beam, start.shape[1])
        ids[:, :k] = self.entries[start[:, :k]]
        dist[:, :k] = ((self.centroids[ids[:, :k]] - q[:, None, :]) ** 2).sum(2)
        done[:, :k] = False
        live = np.arange(n)
        while len(live):
            pick = np.argsort(np.where(done[live], np.inf, dist[live]), 1, kind="stable")[:, :4]
            row = np.arange(len(live))[:, None]
            open_ = ~done[live][row, pick]
            chosen = np.where(open_, ids[live][row, pick], -1)
            done[live[:, None], pick] = True
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(live), -1)
            d = ((self.centroids[near] - q[live][:, None, :]) ** 2).sum(2)
            d[near < 0] = np.inf
            all_ids = np.concatenate((ids[live], near), 1)
            all_d = np.concatenate((dist[live], d.astype(np.float32)), 1)
            all_done = np.concatenate((done[live], np.zeros(near.shape, bool)), 1)
            order = np.lexsort((~all_done, all_ids), axis=1)
            all_ids, all_d, all_done = all_ids[row, order], all_d[row, order], all_done[row, order]
            again = np.zeros(all_ids.shape, bool)
            again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
            all_d[again] = np.inf
            order = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[live], dist[live], done[live] = all_ids[row, order], all_d[row, order], all_done[row, order]
            gone = ~np.isfinite(dist[live])
            block_ids, block_done = ids[live], done[live]
            block_ids[gone], block_done[gone] = -1, True
            ids[live], done[live] = block_ids, block_done
            live = live[~block_done.all(1)]
        return ids, np.sqrt(dist)


def build_graph(vectors: DataFrame, list_size: int = LIST_SIZE, degree: int = DEGREE, centroid_bytes: int = CENTROID_BYTES, group: int = GROUP, rounds: int = 3) -> Graph:
    """The graph of the lists of prepared vectors."""
    spark = vectors.sparkSession
    head = vectors.select("v").first()
    if head is None:
        return Graph(np.zeros((0, 1), np.float32), np.zeros((0, degree), np.int64))
    n, width = vectors.count(), len(head["v"]) // 4
    list_size = max(list_size, -(-2 * n * (4 * width + 4 * degree) // centroid_bytes))
    groups = min(-(-n // group), max(1, centroid_bytes // (4 * width)))
    seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(groups).collect() if groups > 1 else []
    centres = _matrix(pd.Series([r["v"] for r in seeds])) if seeds else np.zeros((1, width), np.float32)
    for _ in range(rounds if groups > 1 else 0):
        shared = spark.sparkContext.broadcast(centres)

        def sums(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, number = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for f in frames:
                x = _matrix(f["v"])
                g = nearest(x, c)
                np.add.at(total, g, x)
                number += np.bincount(g, minlength=len(c))
            some = np.flatnonzero(number)
            yield pd.DataFrame({"g": some, "n": number[some], "s": [list(x) for x in total[some]]})

        parts = vectors.mapInPandas(sums, "g long, n long, s array<double>").groupBy("g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s")).collect()
        centres = centres.copy()
        for r in parts:
            centres[r["g"]] = np.array(r["s"]) / r["n"]
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("long")
    def group_of(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(_matrix(v), shared.value), dtype="int64")

    placed = vectors.withColumn("g", group_of("v"))
    sizes = placed.groupBy("g").count()  # a group that is too large for one task is dealt out to several
    parts = placed.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / (2 * group))))

    def means(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f.sort_values("id")["v"])
        return pd.DataFrame({"c": [x[rows].mean(0).astype(np.float32).tobytes() for rows in bisected(x, list_size)]})

    made = written(parts.groupBy("g", "part").applyInPandas(means, "c binary"), "centroids")
    centroids = _matrix(pd.Series(sorted(r["c"] for r in made.collect())))
    shared_c = spark.sparkContext.broadcast(centroids)

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared_c.value
        half = (c * c).sum(1) / 2
        for f in frames:
            at = f["id"].to_numpy()
            for i in range(0, len(at), 256):
                d = half - c[at[i : i + 256]] @ c.T
                d[np.arange(len(d)), at[i : i + 256]] = np.inf
                m = min(degree, len(c) - 1)
                near = np.argpartition(d, m - 1, 1)[:, :m] if m else np.zeros((len(d), 0), np.int64)
                yield pd.DataFrame({"id": at[i : i + 256], "near": [list(x) for x in near]})

    edges = np.full((len(centroids) + 1, degree), -1)
    for r in spark.range(len(centroids)).mapInPandas(neighbours, "id long, near array<long>").collect():
        edges[r["id"], : len(r["near"])] = r["near"]
    return Graph(centroids, edges)


def _chosen(graph: Graph, x: np.ndarray, replicas: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the lists that they are put in."""
    ids, dist = graph.search(x, max(16, 2 * replicas))
    keep = np.zeros(ids.shape, bool)
    keep[:, 0] = ids[:, 0] >= 0
    for j in range(1, ids.shape[1]):
        ok = (ids[:, j] >= 0) & (dist[:, j] <= spread * dist[:, 0] + 1e-6) & (keep.sum(1) < replicas)
        for i in range(j):
            between = np.sqrt(((graph.centroids[ids[:, i]] - graph.centroids[ids[:, j]]) ** 2).sum(1))
            ok &= ~(keep[:, i] & (between < dist[:, j]))
        keep[:, j] = ok
    row, col = np.nonzero(keep)
    return row, ids[row, col]


def needed(vectors: DataFrame, graph: Graph, k: int, replicas: int, spread: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the k true neighbours of some vectors, taken by hash: how many lists, and lists up to which multiple of the
    nearest one's distance, a search must take to meet it (infinite where the beam misses its lists)."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    who, q = np.array([r["id"] for r in sample]), _matrix(pd.Series([r["v"] for r in sample]))
    shared = vectors.sparkSession.sparkContext.broadcast((who, q))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, q = shared.value
        at, d, v = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), object)
        for f in frames:
            i = f["id"].to_numpy()
            far = 1 - q @ _matrix(f["v"]).T
            far[who[:, None] == i[None]] = np.inf
            at, d, v = np.hstack((at, np.tile(i, (len(q), 1)))), np.hstack((d, far)), np.hstack((v, np.tile(f["v"].to_numpy(), (len(q), 1))))
            near = np.argsort(d, 1, kind="stable")[:, :k]
            at, d, v = (np.take_along_axis(x, near, 1) for x in (at, d, v))
        row, col = np.nonzero(np.isfinite(d))
        yield pd.DataFrame({"q": row, "id": at[row, col], "d": d[row, col], "v": v[row, col]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["d", "id"])[["q", "v"]].head(k)

    true = vectors.mapInPandas(best, "q long, id long, d float, v binary").groupBy("q").applyInPandas(merged, "q long, v binary").toPandas()
    if not len(true):
        return np.zeros(0), np.zeros(0)
    ids, dist = graph.search(q, beam)
    row, where = _chosen(graph, _matrix(true["v"]), replicas, spread)
    found = ids[true["q"].to_numpy()[row]] == where[:, None]
    hit = found.any(1)
    rank, multiple = np.full(len(true), np.inf), np.full(len(true), np.inf)
    place = found.argmax(1)
    asker = true["q"].to_numpy()[row]
    np.minimum.at(rank, row[hit], place[hit] + 1.0)
    np.minimum.at(multiple, row[hit], (dist[asker, place] / np.maximum(dist[asker, 0], 1e-6))[hit])
    return rank, multiple


def fitted(vectors: DataFrame, k: int, list_size: int, replicas: int, spread: float, lists: int, ratio: float, beam: int, centroid_bytes: int) -> tuple[Graph, int, float, int]:
    """A graph, and the lists, ratio and beam with which a sample of the table meets RECALL of its true neighbours. Lists are made longer
    first, up to a group, so that what is shuffled stays; then more of them are taken. Nothing that is given is made less."""
    while True:
        graph = build_graph(vectors, list_size, centroid_bytes=centroid_bytes)
        n = len(graph.centroids)
        if not n:
            return graph, lists, ratio, beam
        beam = max(beam, lists)
        rank, multiple = needed(vectors, graph, k, replicas, spread, beam)
        if not len(rank) or ((rank <= lists) & (multiple <= ratio)).mean() >= RECALL:
            return graph, lists, ratio, beam
        wide, far = needed(vectors, graph, k, replicas, spread, n) if beam < n else (rank, multiple)
        want = float(np.quantile(wide, RECALL + 0.01, method="higher"))
        if want > lists and list_size < GROUP // 2:
            list_size = min(GROUP // 2, max(int(list_size * want / lists), 5 * list_size // 4))
            continue
        lists, ratio = min(n, max(int(want), lists + lists // 4)), max(ratio, 1.05 * float(np.quantile(far, RECALL + 0.02, method="higher")))
        beam = max(2 * beam, lists)
        if lists >= n:  # all of them
            return graph, n, np.inf, n


def _by_list(lists: pd.Series) -> dict[int, np.ndarray]:
    """For each list the rows that name it."""
    row = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    number = np.frombuffer(b"".join(lists), np.int32)
    order = np.argsort(number, kind="stable")
    number, first = np.unique(number[order], return_index=True)
    return dict(zip(number.tolist(), np.split(row[order], first[1:])))


def _nearer(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two tables of ids and distances the k nearest in each row, each id once, by distance and id; infinite ones are none."""
    ids, d = np.hstack((a, b)), np.hstack((da, db))
    order = np.lexsort((d, ids), axis=1)
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    d[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def neighbours(rows: DataFrame, k: int = K, list_size: int = LIST_SIZE, replicas: int = REPLICAS, spread: float = SPREAD, lists: int = LISTS, ratio: float = RATIO, beam: int = BEAM, centroid_bytes: int = CENTROID_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour, distance): the k nearest that are found for every vector, by cosine distance. Other columns are ignored."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = prepared(rows)
    made, lists, ratio, beam = fitted(vectors, k, list_size, replicas, spread, lists, ratio, beam, centroid_bytes)
    n, total = vectors.count(), max(1, len(made.centroids))
    held = np.zeros(total, np.int64)  # the task of each list
    for t, rows_ in enumerate(bisected(made.centroids, max(1, WHOLE * total // max(1, n))) if len(made.centroids) else []):
        held[rows_] = t
    tasks = int(held.max()) + 1
    parts = max(1, -(-n * min(lists, tasks) // tasks // ASKING))  # of the queries of a task
    graph = spark.sparkContext.broadcast(made)

    def by_task(f: pd.DataFrame, row: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Rows, the tasks that hold the lists they need, and those lists."""
        task = held[where]
        order = np.lexsort((where, task, row))
        row, where, task = row[order], where[order].astype(np.int32), task[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (task[1:] != task[:-1])))) if len(row) else np.zeros(0, np.int64)
        return row[first], task[first], [x.tobytes() for x in np.split(where, first[1:])] if len(row) else []

    def posted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                row, task, chosen = by_task(f, *_chosen(graph.value, _matrix(f["v"]), replicas, spread))
                for part in range(parts):
                    yield pd.DataFrame({"task": task * parts + part, "id": f["id"].to_numpy()[row], "v": f["v"].to_numpy()[row], "lists": chosen})

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ids, dist = graph.value.search(_matrix(f["v"]), max(beam, lists))
                ids, dist = ids[:, :lists], dist[:, :lists]
                row, col = np.nonzero((ids >= 0) & (dist <= ratio * dist[:, :1] + 1e-6))
                row, task, chosen = by_task(f, row, ids[row, col])
                who = f["id"].to_numpy()[row]
                yield pd.DataFrame({"task": task * parts + who % parts, "id": who, "v": f["v"].to_numpy()[row], "lists": chosen})

    def answered(key, postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(postings) or not len(queries):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "near": [], "d": []})
        x, p, at, who = _matrix(queries["v"]), _matrix(postings["v"]), postings["id"].to_numpy(), queries["id"].to_numpy()
        own, wants = _by_list(postings["lists"]), _by_list(queries["lists"])
        near, far = np.full((len(x), k), -1), np.full((len(x), k), np.inf, np.float32)
        for number, asking in wants.items():
            mine = own.get(number)
            if mine is None:
                continue
            step = max(64, (4 << 20) // len(mine))
            for i in range(0, len(asking), step):
                q = asking[i : i + step]
                d = 1 - x[q] @ p[mine].T
                d[who[q, None] == at[mine][None]] = np.inf
                best = np.argpartition(d, k - 1, 1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(q), 1))
                near[q], far[q] = _nearer(near[q], far[q], at[mine][best], np.take_along_axis(d, best, 1), k)
        found = np.isfinite(far)
        ends = np.cumsum(found.sum(1))[:-1]
        return pd.DataFrame({"q": who, "near": [v.tobytes() for v in np.split(near[found], ends)], "d": [v.tobytes() for v in np.split(far[found], ends)]})

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def best(f: pd.DataFrame) -> pd.DataFrame:
            n = np.array([len(x) // 8 for x in f["near"]])
            q, near, d = np.repeat(f["q"].to_numpy(), n), np.frombuffer(b"".join(f["near"]), np.int64), np.frombuffer(b"".join(f["d"]), np.float32)
            order = np.lexsort((d, near, q))
            first = np.ones(len(q), bool)
            first[1:] = (q[order][1:] != q[order][:-1]) | (near[order][1:] != near[order][:-1])
            order = order[first]
            order = order[np.lexsort((near[order], d[order], q[order]))]
            begin = np.searchsorted(q[order], q[order], "left")
            rank = np.arange(len(order)) - begin + 1
            order, rank = order[rank <= k], rank[rank <= k]
            return pd.DataFrame({"vec_id": q[order], "rank": rank.astype(np.int32), "neighbour": near[order], "distance": d[order].astype(np.float64)})

        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            both = pd.concat(held)
            whole = both["q"] != both["q"].iloc[-1]  # the last query may go on in the next batch
            if whole.any():
                yield best(both[whole])
            held = [both[~whole]]
        if held and len(held[0]):
            yield best(held[0])

    postings, queries = (vectors.mapInPandas(f, "task long, id long, v binary, lists binary") for f in (posted, asked))
    answers = postings.groupBy("task").cogroup(queries.groupBy("task")).applyInPandas(answered, "q long, near binary, d binary")
    return answers.repartition("q").sortWithinPartitions("q").mapInPandas(ranked, "vec_id long, rank int, neighbour long, distance double")
