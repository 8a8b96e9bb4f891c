"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is then parsed greedily into the longest matches
that the language's text contains anywhere; few long phrases mean a low cross entropy (Ziv and Merhav 1993), and the
language with the fewest phrases, normalised by the text's length, wins.

A greedy parse only ever goes forward from the automaton's root, so automaton and restarts together are one table
(state, symbol) -> (state, does a phrase begin). All texts of a batch are cut into lanes of equal length that are stepped
through the table at once. A lane begins as if a phrase began there; the true parse enters it in another state and is
followed until both begin a phrase at one place, from where they are the same. So the count is exact for whole texts.

Training uses a bounded sample of labelled rows: at most `train_bytes` normalised bytes from at most `train_docs` texts of
each label, those with the least hash of their doc_id; so the tables don't grow with the input.

A text is rejected (language null) if it has no letter, or if even its best language needs more than `max_rate` phrases
for each symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import release, small_batches, utf8

TRAIN_BYTES, TRAIN_DOCS, MAX_RATE = 24_000, 64, 0.45
LANES = 1024
#: Rounds over lanes together before they are followed one by one.
ROUNDS = 4
#: Texts are taken so many bytes at a time, or a single one.
PIECE = 2 << 20


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-case texts with each run of bytes that aren't letters made one space; where each text begins in them."""
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = letter[starts]  # no space before a text's first letter
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(keep, dtype=np.uint32)))
    return np.where(letter, data, np.uint8(32))[keep], sums[offsets].astype(np.int64)


def automaton(text: bytes, symbols: np.ndarray, width: int) -> np.ndarray:
    """The table of a text: at state * width + symbol the next state times 2, plus 1 if a phrase begins with the symbol.

    State 0 is the root. A symbol that the text lacks is a phrase by itself.
    """
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in symbols[np.frombuffer(text, np.uint8)].tolist():
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    begin = np.full(width, 1, np.int32)
    for c, s in to[0].items():
        begin[c] = 2 * s + 1
    table = np.tile(begin, (len(to), 1))
    for s, edges in enumerate(to[1:], 1):
        for c, t in edges.items():
            table[s, c] = 2 * t
    return table.reshape(-1)


def _follow_one_by_one(table: np.ndarray, width: int, by_step: np.ndarray, begins: np.ndarray, entered: dict[int, int]) -> None:
    """Puts right the lanes that are entered in the given states, and those after them, each after the one before: what phrases
    that are longer than several lanes need, as then each lane waits for another anyway."""
    steps, lanes = by_step.shape
    edges = memoryview(table)
    while entered:
        lane = min(entered)
        state = entered.pop(lane)
        symbols, was = by_step[:, lane].tolist(), begins[:, lane].tolist()
        for t in range(steps):
            nxt = edges[state * width + symbols[t]]
            state = nxt >> 1
            if nxt & 1 and was[t]:
                break
            was[t] = bool(nxt & 1)
        else:
            if lane + 1 < lanes:
                entered[lane + 1] = state
        begins[:, lane] = was


def phrases(table: np.ndarray, width: int, stream: np.ndarray, offsets: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """How many phrases each of the texts in the stream has. Symbols are below width - 1; width - 1 must be a symbol of no text."""
    stop = width - 1
    padded = np.insert(stream, offsets, stop)  # around each text a symbol that no phrase can contain
    steps = -(-len(padded) // lanes)
    lane = np.full(steps * lanes, stop, np.uint8)
    lane[: len(padded)] = padded
    by_step = np.ascontiguousarray(lane.reshape(lanes, steps).T)
    begins = np.empty((steps, lanes), bool)
    state = np.zeros(lanes, np.int32)
    for t in range(steps):
        nxt = table.take(state * width + by_step[t])
        begins[t] = nxt & 1
        state = nxt >> 1
    entry = np.concatenate(([0], state[:-1]))
    follow = np.flatnonzero(entry)
    now, t, rounds = entry[follow], 0, 0
    while len(follow):
        if t == steps:  # a phrase longer than a lane: the next lane was entered in another state
            ends = now
            follow, now, t, rounds = follow + 1, ends, 0, rounds + 1
            now, follow = now[follow < lanes], follow[follow < lanes]
            if not len(follow):
                break
            if rounds == ROUNDS:
                _follow_one_by_one(table, width, by_step, begins, dict(zip(follow.tolist(), now.tolist())))
                break
        nxt = table.take(now * width + by_step[t, follow])
        true = (nxt & 1).astype(bool)
        same = true & begins[t, follow]
        begins[t, follow] = true
        follow, now = follow[~same], (nxt >> 1)[~same]
        t += 1
    found = np.add.reduceat(begins.T.reshape(-1), offsets + np.arange(len(offsets)), dtype=np.int64)
    return found[:-1] - 1  # without the symbol before each text


class Model:
    """The automata of some languages over one alphabet."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8)) if samples else np.zeros(0, np.uint8)
        self.width = len(seen) + 2  # one for bytes not seen, one that ends texts
        self.symbols = np.full(256, len(seen), np.uint8)
        self.symbols[seen] = np.arange(len(seen), dtype=np.uint8)
        self.tables = [automaton(samples[x], self.symbols, self.width) for x in self.languages]

    def rates(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each symbol, by text and language; and each text's number of symbols."""
        if len(column) > 1 and column.nbytes > PIECE:
            parts = [self.rates(column.slice(*x)) for x in ((0, len(column) // 2), (len(column) // 2,))]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        data, offsets = utf8(column)
        stream, offsets = normalised(data, offsets)
        stream = self.symbols[stream]
        lengths = np.diff(offsets)
        counts = [phrases(t, self.width, stream, offsets) for t in self.tables]
        rates = np.stack(counts, 1) / np.maximum(lengths, 1)[:, None] if counts else np.zeros((len(lengths), 0))
        return rates, lengths


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labels in the column lang. Rows without label, text or doc_id, and texts without a letter, train nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # ids first: of each label only train_docs from a partition are moved, and no text
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang").withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= train_docs).collect()
    chosen = sorted({r["doc_id"] for r in ids})
    texts = rows.where(F.col("doc_id").isin(chosen)).select("doc_id", "lang", F.substring("text", 1, train_bytes).alias("text")).collect() if chosen else []
    wanted = {(r["doc_id"], r["lang"]): r["rank"] for r in ids}
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts:
        if (r["doc_id"], r["lang"]) in wanted and r["text"]:
            data, offsets = utf8(pa.array([r["text"]]))
            parts.setdefault(r["lang"], []).append((wanted[r["doc_id"], r["lang"]], normalised(data, offsets)[0].tobytes()))
    share = max(1, train_bytes // 8)  # of one text, so that several are in the sample
    samples = {lang: b" ".join(x[:share] for _, x in sorted(p))[:train_bytes] for lang, p in parts.items()}
    return Model({lang: s for lang, s in samples.items() if s.strip()})


RESULT = "language string, rate double, second string, second_rate double, symbols long"


def identify_column(text: Column, model: Model, spark, max_rate: float = MAX_RATE) -> Column:
    """A struct for each text: the language or null, its rate, the runner-up and its rate, and the number of symbols."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.languages, None], object)
        for texts in batches:
            rates, lengths = m.rates(pa.array(texts, pa.string(), from_pandas=True))
            full = np.concatenate((rates, np.full((len(lengths), 2), np.inf)), 1)
            order = np.argsort(full, 1, kind="stable")  # a tie goes to the first label
            best, second = order[:, 0], order[:, 1]
            row = np.arange(len(lengths))
            name = lambda k: names[np.minimum(k, len(m.languages))]
            rate, second_rate = full[row, best], full[row, second]
            known = (lengths > 0) & (rate <= max_rate)
            out = pd.DataFrame({"language": name(best), "rate": rate, "second": name(second), "second_rate": second_rate, "symbols": lengths})
            out.loc[~known, "language"] = None
            out.loc[lengths == 0, ["second"]] = None
            for c in ("rate", "second_rate"):
                out[c] = out[c].where((lengths > 0) & np.isfinite(out[c]))
            yield out
        release()

    return identify(text)


def identify_languages(docs: DataFrame, labelled: DataFrame | None = None, max_rate: float = MAX_RATE, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, language, rate, second, second_rate, symbols) for every row of docs, repeated or not.

    A null or empty text, or one without a letter, has language null and symbols 0. Other columns are ignored. With no
    labelled text every language is null.
    """
    small_batches(docs.sparkSession)
    model = train(docs if labelled is None else labelled, train_bytes, train_docs)
    found = identify_column(F.col("text"), model, docs.sparkSession, max_rate)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", found.alias("found")).select("doc_id", "found.*")


def identified_only(docs: DataFrame, max_rate: float = MAX_RATE, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs without the rows whose text has no language; all columns stay as they are, whatever their names."""
    small_batches(docs.sparkSession)
    model = train(docs, train_bytes, train_docs)
    names = [f"_{k}" for k in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")]).cast("string")
    found = docs.toDF(*names).withColumn("language", identify_column(text, model, docs.sparkSession, max_rate)["language"])
    return found.where("language is not null").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
