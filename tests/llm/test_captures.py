import random

import pytest

from tessera.llm import captures

SCHEMA = "page_id long, url string, html string, key string, range int, timestamp string"


def made(spark, rows):
    return spark.createDataFrame([(p, u, h, "k", 1, "t") for p, u, h in rows], SCHEMA)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30), s, n) for n in range(rng.randrange(0, 40))) for s in range(k)]
    runs = [sorted(r, key=lambda x: x[0]) for r in runs]
    got = list(captures.LoserTree([iter(r) for r in runs]))
    assert [x[:2] for x in got] == sorted((x[:2] for r in runs for x in r))
    assert sorted(got) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com:80/a/b/?b=2&a=1#top", "com,example)/a/b?a=1&b=2"),
        ("https://user:pw@blog.example.org", "org,example,blog)/"),
        ("example.org/", "org,example)/"),
        ("HTTPS://Example.org:8080/X?", "org,example:8080)/x"),
        ("http://www2.example.org?q", "org,example)/?q"),
        ("", ")/"),
    ],
)
def test_url_key(spark, url, key):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(captures.url_key(F.col("u")).alias("k")).first()["k"] == key


def brute(rows):
    """(urlkey, timestamp, page, changed, capture) in global order."""
    rows = sorted(rows, key=lambda r: (r["urlkey"].encode(), r["timestamp"], r["page_id"] is not None, r["page_id"] or 0))
    out, key, n, digest = [], None, 0, None
    for k, r in enumerate(rows):
        n, digest = (n + 1, digest) if r["urlkey"] == key else (1, None)
        out.append((k, r["urlkey"], r["timestamp"], r["page_id"], r["digest"], n, digest != r["digest"]))
        key, digest = r["urlkey"], r["digest"]
    return out


def check(spark, rows, ranges, parts):
    found = captures.captures(made(spark, rows)).repartition(parts)
    got = captures.merged_index(found, ranges).orderBy("position").collect()
    assert [(r["position"], r["urlkey"], r["timestamp"], r["page_id"], r["digest"], r["capture"], r["changed"]) for r in got] == brute(captures.captures(made(spark, rows)).collect())
    return got


def test_merge_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK", 7)
    rng = random.Random(6)
    urls = [f"http://h{rng.randrange(5)}.example.com/{rng.randrange(12)}" for _ in range(30)]
    rows = [(k, rng.choice(urls), f"page {rng.randrange(3)}") for k in range(400)]
    rows += [(1000 + k, "http://hot.example.com/", f"v{k // 50}") for k in range(300)]  # one url over several ranges
    rows += [(None, "http://h1.example.com/x", "n"), (7, None, "no url"), (8, "http://h1.example.com/1", None), (9, "ünï.example/ö", ""), (3, rows[3][1], rows[3][2]), (-5, "http://h1.example.com/1", "before"), (5000, "http://long.example/" + "x" * 100_000, "y" * 1_000_000)]
    rng.shuffle(rows)
    for ranges, parts in ((1, 1), (4, 3), (9, 5)):
        assert len(check(spark, rows, ranges, parts)) == len(rows) - 1


def test_each_capture_moves_once(spark, monkeypatch):
    """Blocks are cut at the splitters: no more of them than full ones and one for each run and range."""
    monkeypatch.setattr(captures, "BLOCK", 50)
    rows = [(k, f"http://h{k * 7919 % 211}.example.com/{k % 17}", "page") for k in range(4000)]
    keyed = captures.keyed(captures.captures(made(spark, rows)).repartition(8))
    edges = captures.splitters(keyed, 40)
    assert 20 <= len(edges) < 40 and edges == sorted(edges)
    blocks = captures.runs(keyed, edges).drop("data").collect()
    assert sum(b["captures"] for b in blocks) == 4000 and max(b["captures"] for b in blocks) <= 50
    assert len(blocks) <= 4000 // 50 + 8 * (len(edges) + 1)
    assert len({(b["run"], b["block"]) for b in blocks}) == len(blocks)
    per_range = [sum(b["captures"] for b in blocks if b["range"] == r) for r in range(len(edges) + 1)]
    assert max(per_range) < 4 * 4000 / 40


def test_ranges_follow_from_bytes(spark, monkeypatch):
    keyed = captures.keyed(captures.captures(made(spark, [(k, f"http://h{k}.example.com/", "page") for k in range(1000)])))
    assert captures.splitters(keyed) == []
    monkeypatch.setattr(captures, "RANGE_BYTES", 20_000)
    assert 4 <= len(captures.splitters(keyed)) <= 20


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = captures.captures(pages).repartition(3)
    assert captures.merged_index(out, 4).count() == pages.count()


def test_empty(spark):
    assert captures.merged_index(captures.captures(made(spark, []))).collect() == []
    assert captures.merged_index(captures.captures(made(spark, [(1, None, "x")]))).collect() == []
