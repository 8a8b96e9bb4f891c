"""Every operator and stage over one table of odd rows: nulls in every column, empty, very long and repeated texts, ties, and columns whose names clash with those inside."""

import collections

import corpus_pipeline
import pytest

from tessera.llm import ann, captures, jaccard, langid, mixing, packing, records, rules, sharding, tokens

PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that some operator uses inside.
CLASHING = ["_t", "_w", "_l", "_row", "_0", "_1", "_source", "_epochs", "_copy", "_times", "bits", "n_words", "node", "root", "doc", "key", "part", "language", "_tessera_language", "_tessera_doc", "shard", "copy", "piece", "bucket", "section", "size", "count", "h", "slice", "task", "list", "v", "id", "range", "run"]
WORDS = "the quick brown fox jumps over a lazy dog while nine others watch it from behind their old wooden fence"


def documents(spark, rows=None):
    text = [WORDS, WORDS, WORDS + " again", None, "", " \n\t ", "ünïcödé wörds, 日本語 🎉", "x" * 300_000, " ".join(f"{w}{k}" for k in range(4000) for w in WORDS.split()), "!!! ...", WORDS.upper()]
    if rows is None:
        rows = [(k, t, ["en", None][k % 2], ["a", "b", None][k % 3], len(t or "") if k % 4 else None) for k, t in enumerate(text)]
        rows += [(0, WORDS, "en", "a", 1), (0, WORDS, "en", "a", 1), (None, WORDS, None, None, None), (None, None, None, None, None), (-5, "a tie", "en", "a", 2), (5, "a tie", "en", "a", 2)]
    filled = [(*r, *[f"own {j} {k}" for j in range(len(CLASHING))]) for k, r in enumerate(rows)]
    return spark.createDataFrame(filled, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def counted(df):
    return collections.Counter(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["language_id", "quality_rules", "near_duplicates", "mix_sources"])
def test_stages_keep_columns_and_values(spark, name):
    docs = documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before, after = counted(docs), counted(out)
    assert after and set(after) <= set(before), "rows are those of the table, whole"
    if name != "mix_sources":
        assert all(n <= before[r] for r, n in after.items())


def test_near_duplicates_of_odd_rows(spark):
    kept = sorted(str(r["doc_id"]) for r in jaccard.one_of_each_group(documents(spark)).collect())
    # 0 stands for its equal rows, for 1, 2 and the upper-case 10; -5 for both rows of 5; rows without words or doc_id stay
    assert kept == sorted(map(str, [0, 3, 4, 6, 7, 8, 9, None, None, -5]))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_empty_tables(spark, stage):
    assert stage[1](spark, documents(spark, []), "").collect() == []


def test_rows_in_and_out(spark):
    """How many rows each operator returns for the odd table."""
    docs = documents(spark)
    n = docs.count()
    texts = [r["text"] for r in docs.collect()]
    assert rules.ledger(docs).count() == rules.with_policies(rules.stored_ledger(docs)).count() == n
    assert langid.identify_languages(docs).count() == n
    assert sharding.sharded(docs).count() == n
    assert tokens.attributed(docs).count() == sum(len(t.splitlines()) for t in texts if t)
    assert records.tokenized(docs).count() == n
    assert {r["doc_id"] for r in packing.packed(docs).collect()} == {r["doc_id"] for r in docs.collect() if r["text"]}
    assert mixing.sampled(docs).select("source").distinct().count() <= 3
    assert all(r["doc_a"] < r["doc_b"] for r in jaccard.jaccard_join(docs).collect())
    pages = docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html", *[f"`{c}`" for c in CLASHING])
    assert captures.merged_index(captures.captures(pages)).count() == sum(r["source"] is not None for r in docs.collect())


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [float(k % 3), 1.0], "x", "y", "z", "w", "u") for k in range(9)] + [(None, [1.0, 0.0], "x", "y", "z", "w", "u"), (20, None, None, None, None, None, None), (3, [0.0, 1.0], "x", "y", "z", "w", "u")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, task string, lists string, id string, v string, label string")
    got = ann.neighbours(df, k=2).collect()
    assert len(got) == 18 and {r["vec_id"] for r in got} == set(range(9))
