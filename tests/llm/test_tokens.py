import random

import pytest

from tessera.llm import tokens

SCHEMA = "doc_id long, text string, section int, start long, tokens double, end string, sections array<struct<start:long,end:long>>"
TEXTS = [(1, "One line.\nAnother, with ünïcödé 日本語 🎉.\n\n\nLast"), (2, None), (3, ""), (4, "\n\n\n"), (5, "no newline"), (1, "One line.\nAnother, with ünïcödé 日本語 🎉.\n\n\nLast"), (None, "a\nb"), (6, " " * 50_000 + "\n" + "\t" * 3 + "x"), (7, "long words " * 100_000), (8, "🎉" * 40 + "\n" + "é" * 10)]


def made(spark, rows=TEXTS, spans=None):
    return spark.createDataFrame([(d, t, 1, 2, 3.0, "e", spans) for d, t in rows], SCHEMA)


def brute(tok, text, sections, rule):
    """Tokens by section: every token's characters, one by one."""
    ids, lengths = tok.encode(text), tok.byte_lengths()
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    at, out, crossing = 0, [0.0] * len(sections), [0] * len(sections)
    for t in ids:
        chars = sorted(set(of_byte[at : at + lengths[t]]))
        at += lengths[t]
        parts = [sum(a <= c < z for c in chars) for a, z in sections]
        touched = [k for k, n in enumerate(parts) if n]
        if not touched:
            continue
        if len(touched) > 1 or sum(parts) < len(chars):
            for k in touched:
                crossing[k] += 1
        if rule == "split":
            for k in touched:
                out[k] += parts[k] / sum(parts)
        else:
            out[touched[0] if rule == "start" else max(touched, key=lambda k: (parts[k], -k))] += 1
    assert at == len(of_byte)
    return out, crossing, len(ids)


def lines(text):
    out, at = [], 0
    for part in text.splitlines(keepends=True) if "\r" not in text else []:
        out.append((at, at + len(part)))
        at += len(part)
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_lines(spark, rule):
    tok = tokens.Tokenizer(spark)
    got = {}
    for r in tokens.attributed(made(spark), rule).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert set(got) == {d for d, t in TEXTS if t}
    assert len(got[1]) == 2 * len(lines(TEXTS[0][1]))
    for d, t in TEXTS:
        if t and d not in (1, 7):
            out, crossing, n = brute(tok, t, lines(t), rule)
            assert sorted(got[d]) == [(k, a, z, pytest.approx(out[k]), crossing[k], n) for k, (a, z) in enumerate(lines(t))]
            assert sum(out) == pytest.approx(n), "lines are all of a text"
    assert got[7][0][3] == len(tok.encode(TEXTS[8][1]))


@pytest.mark.parametrize("rule", tokens.RULES)
def test_given_sections(spark, rule):
    """Sections with gaps between them and ends inside of tokens."""
    tok, rng = tokens.Tokenizer(spark), random.Random(3)
    for text in ("internationalization of tokenizers", "ab 日本語 🎉🎉 straße ".strip() * 3):
        for _ in range(6):
            cuts = sorted(rng.choices(range(len(text) + 1), k=8))
            spans = list(zip(cuts[::2], cuts[1::2]))
            got = tokens.attributed(made(spark, [(1, text)], spans), rule, sections="sections").orderBy("section").collect()
            out, crossing, _ = brute(tok, text, spans, rule)
            assert [(r["tokens"], r["crossing"]) for r in got] == [(pytest.approx(a), b) for a, b in zip(out, crossing)]


def whole(tok, text):
    """The tokenizer's own encoding of a whole text."""
    return tokens._encoding(tok.ranks.value)[0].encode_ordinary(text)


@pytest.mark.parametrize("n", [999, 1000, 1001, 20_000, 60_000])
def test_long_white_space_as_in_whole_texts(spark, n):
    tok = tokens.Tokenizer(spark)
    for run in (" " * n, "\n" * n, " \n" * (n // 2), "\t \u2003\xa0" * (n // 4), "\u3000" * (n - 1) + " "):
        for text in (run, "a" + run, run + "b", f"a{run}b", f"a{run}'s{run} 1{run}", f"x {run}.{run}\x1c{run}y" * 2):
            assert tok.encode(text) == whole(tok, text)


def test_white_space_longer_than_the_pattern_matches(spark):
    tok = tokens.Tokenizer(spark)
    text = "a" + " " * 1_000_000 + "b"
    got = tokens.attributed(made(spark, [(1, text), (2, "\n" * 1_000_000 + "c")])).groupBy("doc_id").agg({"tokens": "sum"}).collect()
    assert len(got) == 2 and len(tok.encode(text)) == 1_000_001


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tok = tokens.Tokenizer(spark)
    got = {r["doc_id"]: r["n"] for r in tokens.attributed(docs).groupBy("doc_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert got == {r["doc_id"]: len(whole(tok, r["text"])) for r in docs.collect()}


def test_empty(spark):
    assert tokens.attributed(made(spark, [])).collect() == []
    with pytest.raises(ValueError):
        tokens.attributed(made(spark, []), "none")
