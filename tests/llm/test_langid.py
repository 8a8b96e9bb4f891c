import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard, langid
from tessera.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, rate long"


def brute(reference: bytes, text: bytes) -> int:
    """Phrases of the greedy parse of text into longest substrings of reference."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in reference:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def plain(text: str) -> bytes:
    data, offsets = utf8(pa.array([text]))
    return langid.normalised(data, offsets)[0].tobytes()


@pytest.mark.parametrize("lanes", [1, 3, 64, 1024])
def test_phrases_against_brute_force(lanes):
    rng = random.Random(lanes)
    reference = plain("the cat sat on the mat and the dog ate the hat ünd das öl " * 3 + "xyzzy")
    model = langid.Model({"a": reference})
    texts = ["", "!!!", "the cat", "q", "THE CAT SAT", "ünd", "zzz" * 50] + ["".join(rng.choices("the catsmdogü ", k=rng.randrange(1, 400))) for _ in range(40)]
    data, offsets = utf8(pa.array(texts))
    stream, offsets = langid.normalised(data, offsets)
    got = langid.phrases(model.tables[0], model.width, model.symbols[stream], offsets, lanes)
    assert got.tolist() == [brute(reference, plain(t)) for t in texts]


@pytest.mark.parametrize("lanes", [7, 64, 300])
def test_phrases_longer_than_many_lanes(lanes):
    """Repeated text that the reference holds at length: no lane begins a phrase where the true parse does."""
    rng = random.Random(lanes)
    reference = plain("the house where nothing walks " * 40 + "and then another tale of something else")
    model = langid.Model({"a": reference})
    texts = ["the house where nothing walks " * n for n in (1, 60, 150)] + ["x " + "house where nothing walks the " * 90 + "".join(rng.choices("the walks", k=200)), "another tale " * 50]
    data, offsets = utf8(pa.array(texts))
    stream, offsets = langid.normalised(data, offsets)
    got = langid.phrases(model.tables[0], model.width, model.symbols[stream], offsets, lanes)
    assert got.tolist() == [brute(reference, plain(t)) for t in texts]


def test_normalised():
    assert [plain(t) for t in ("", "  A, b!", "a1b", "É-", "...")] == [b"", b"a b ", b"a b", "é ".encode(), b""]


def made(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 1, "x", 2) for d, t, lang in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    words = {"en": ["the", "house", "where", "nothing", "thing", "walks"], "de": ["das", "haus", "welches", "nichts", "ding", "geht"]}
    rows = [(2 * k + (lang == "de"), " ".join(rng.choices(words[lang], k=60)), lang) for k in range(20) for lang in words]
    return rows + [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, "qxqxqxvjvjkqzqzx" * 10, None), (None, "the house where nothing walks", None), (0, "das haus welches geht", None)]


def test_identified(spark):
    got = langid.identify_languages(made(spark, corpus())).collect()
    assert len(got) == len(corpus())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["language"])
    assert all(by[k] == [["en", "de"][k % 2]] for k in range(1, 40))
    assert sorted(by[0]) == ["de", "en"] and by[None] == ["en"]
    assert [by[k] for k in (100, 101, 102, 103)] == [[None]] * 4
    kept = langid.identified_only(made(spark, corpus()))
    assert kept.columns == made(spark, []).columns and kept.count() == 42


def test_empty_and_unlabelled(spark):
    assert langid.identify_languages(made(spark, [])).collect() == []
    assert [r["language"] for r in langid.identify_languages(made(spark, [(1, "the house", None)])).collect()] == [None]


def test_very_long_text(spark):
    rows = [(k, " ".join(["the house where nothing walks"] * (1 if k else 100_000)), "en") for k in range(3)]
    assert {r["language"] for r in langid.identify_languages(made(spark, rows)).collect()} == {"en"}


def test_held_out_accuracy(spark, sf_dir):
    """Trained on the even doc_ids, scored on the odd ones that resemble no even one. Some texts of the table are put together of two languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    alike = {x for r in jaccard.jaccard_join(docs, threshold=0.2).collect() for x in (r["doc_a"], r["doc_b"])}
    found = [r for r in langid.identify_languages(odd, even).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["doc_id"] not in alike]
    assert len(found) > 50
    assert np.mean([r["language"] == r["lang"] for r in found]) > 0.95
