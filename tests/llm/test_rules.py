import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, rules

SCHEMA = "doc_id long, text string, bits long, n_words long, _t string, _0 string, lang string"
TEXTS = [
    (1, "This is a clean line of words.\nAnd here another one follows it."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "LOUD WORDS ARE ALL IN UPPER CASE HERE"),
    (6, "a$$$ b### c%%% d&&& e*** f$$$ g@@@"),
    (7, "same " * 60),
    (8, "line\nline\nline\nline\nline"),
    (9, "lorem Ipsum dolor sit amet"),
    (10, "x" * 2_000_000),
    (11, "- a b c d\n" * 8 + "- one two three four five six seven"),
    (12, "{ } { } { } and some code words"),
    (13, " ".join(str(k) for k in range(100, 150))),
    (None, "A row without any number of its own."),
    (1, "This is a clean line of words.\nAnd here another one follows it."),
]


def made(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, 5, 6, "x", "y", "en") for d, t in rows], SCHEMA)


def brute(text):
    """Names of the rules that a text fails."""
    t = text or ""
    words = [w for w in re.split(r"[ \t\n\r\f]+", t.lower()) if w]
    visible = len(re.sub(r"[ \t\n\r\f]", "", t))
    letters, lines = sum(c.isalpha() for c in t), t.split("\n")
    share = lambda a, b: a / b if b else None
    m = {
        "n_words": len(words),
        "mean_word": share(visible, len(words)),
        "letter_share": share(letters, visible),
        "upper_share": share(sum(c.isupper() for c in t), letters),
        "symbols_per_word": share(sum(c in "#$%&*!|@{}<>~^=+_\\/" for c in t), len(words)),
        "distinct_share": share(len(set(words)), len(words)),
        "repeated_line_share": 1 - len(set(lines)) / len(lines),
        "digit_share": share(sum(c in "0123456789" for c in t), visible),
        "bullet_share": sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines) / len(lines),
        "ellipsis_share": sum(x.endswith(("...", "…")) for x in lines) / len(lines),
        "braces": t.count("{") + t.count("}"),
        "placeholder": int("lorem ipsum" in t.lower()),
    }
    out = set()
    for r in rules.RULES:
        v = m[r.measure]
        if v is not None and len(words) >= r.above_words and ((r.least is not None and v < r.least) or (r.most is not None and v > r.most)):
            out.add(r.name)
    return out


def names(bits):
    return {r.name for k, r in enumerate(rules.RULES) if bits >> k & 1}


def test_ledger_against_brute_force(spark):
    got = sorted((str(r["doc_id"]), names(r["bits"])) for r in rules.ledger(made(spark)).collect())
    assert [x[0] for x in got] == sorted(str(d) for d, _ in TEXTS)
    want = {}
    for d, t in TEXTS:
        want.setdefault(str(d), brute(t))
    assert all(want[d] == n for d, n in got), [(d, n, want[d]) for d, n in got if want[d] != n]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: names(r["bits"]) for r in rules.ledger(docs).collect()} == want


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = rules.passing(docs).select("doc_id").join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in labels.join(docs, "doc_id").groupBy("quality").count().collect()}
    k = {r["quality"]: r["count"] for r in kept}
    assert k[1] >= 0.99 * n[1] and k.get(0, 0) <= 0.2 * n[0]


def test_passing(spark):
    kept = rules.passing(made(spark))
    assert kept.columns == made(spark, []).columns
    keep = [str(d) for d, t in TEXTS if not brute(t) & {r.name for r in rules.RULES if rules.POLICIES["v1"].mask & rules.mask(r.name)}]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(keep)
    assert kept.where("doc_id = 1").first()["_t"] == "x"
    assert rules.passing(made(spark, [])).count() == 0


@pytest.mark.parametrize("version", ["v1", "v2", "v3"])
def test_ablations(spark, version):
    rows = rules.ledger(made(spark))
    bits = [r["bits"] for r in rows.collect()]
    p = rules.POLICIES[version]
    keep = lambda m: sum((b & m).bit_count() <= p.tolerated for b in bits)
    got = {r["rule"]: (r["failing"], r["kept"], r["kept_without"]) for r in rules.ablations(rows).where(F.col("version") == version).collect()}
    want = {r.name: (sum(b >> k & 1 for b in bits), keep(p.mask), keep(p.mask & ~(1 << k))) for k, r in enumerate(rules.RULES) if p.mask >> k & 1}
    assert got == want
    assert rules.ablations(rules.ledger(made(spark, []))).count() == 0


def test_very_long_clean_texts_stay(spark):
    """Distinct words of prose grow with about the root of its length; the same 500 words over and over are repetition at any length."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k + 1000))
    clean = lambda n: " ".join(word(k // 7 if k % 7 == 0 else k % 300) + ("\n" if k % 20 == 19 else "") for k in range(n))
    again = " ".join(word(k % 500) for k in range(500_000))
    rows = [(1, clean(100_000)), (2, clean(500_000)), (3, clean(1_200_000)), (4, again)]
    assert sorted(r["doc_id"] for r in rules.passing(made(spark, rows)).select("doc_id").collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", ["op3_quality_rules", "op3_rule_ablations"])
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert len(want) and plain(got.collect()) == plain(want)
