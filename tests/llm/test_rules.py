import collections
import random
import re

import pytest

from headwater.llm import quality, url_rules, warc

pytest.importorskip("public_tokenizers")
from headwater.llm.queries import GIVEN_RULES  # noqa: E402


def test_given_rules(spark):
    expected = {
        "http://EXAMPLE.com/en/x?q": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://b.net/es/1#f": ("b.net", "/es/1", "net/es/", "block"), "x://b.net/es": ("b.net", "/es", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"), "http://a.com?x=/en/": ("a.com", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://b\nc.com/\n": ("b\nc.com", "/\n", "com/", "allow"), "http://É.com/a://b": ("É.com", "/a://b", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(expected)] * 2, "page_id long, url string, host string")
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    rows = url_rules.judge_urls(pages, GIVEN_RULES, none).collect()
    assert len(rows) == 2 * len(expected)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == list(expected.values())[r.page_id]


def test_mined_rules_equal_brute_force(spark):
    pick = random.Random(1)
    rows = []
    for i in range(600):
        parts = [pick.choice(["shop", "blog", "news"]), pick.choice(["win", "list"]), str(i)]
        bad = parts[0] == "shop" and parts[1] == "win" and pick.random() < 0.9 or pick.random() < 0.05
        rows.append((f"http://{parts[0]}.example.org/{parts[1]}/{parts[2]}", bad))
    rows.append((None, True))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = {tuple(r.tokens): (round(r.confidence, 6), round(r.support, 6)) for r in url_rules.mine_rules(labelled, 0.05, 0.6).collect()}
    hits = [bad for url, bad in rows if url and "shop." in url and "/win/" in url]
    assert mined == {("host=shop", "path=win"): (round(sum(hits) / len(hits), 6), round(sum(hits) / len(rows), 6))}
    pages = spark.createDataFrame([(1, "http://a.shop.io/x/win"), (2, "http://shop.io/list"), (3, None)], "page_id long, url string")
    rules = url_rules.mine_rules(labelled, 0.05, 0.6)
    assert {r.page_id: r.verdict for r in url_rules.judge_urls(pages, GIVEN_RULES, rules).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert url_rules.mine_rules(labelled.limit(0)).count() == 0


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)]


def test_features_equal_brute_force():
    pick = random.Random(2)
    texts = ["".join(pick.choice(["a ", "b ", "é", "\n", "\u00a0", "# ", "a b c d e f g h ", "\t", "\x1c"]) for _ in range(pick.randint(0, 60))) for _ in range(400)]
    found = quality.count_features(texts)
    assert [[found[f][i] for f in quality.FEATURES] for i in range(len(texts))] == [brute_features(t) for t in texts]


def test_quality_verdicts(spark):
    pick = random.Random(3)
    good = [" ".join(pick.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(pick.randint(0, 999)) for _ in range(80)) for _ in range(300)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else "t", 1) for i, t in enumerate(good)]
    rows += [(1000, None, "en", "s", 1), (1001, "too short", "en", "s", 1), (1002, "word### " * 3 + good[0].replace(" ", "$$$ "), "en", "s", 1),
             (1003, "one two three four five six seven eight " * 9, "xx", None, 1), (None, good[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    found = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(found) == len(rows)
    assert {i for i, r in found.items() if not r.kept} == {1000, 1001, 1002, 1003}
    assert {i for i, r in found.items() if r.base_failed} == {1000, 1001, 1003}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_sketch_bounds_merge(spark):
    rows, name = quality.with_features(spark.createDataFrame([(f"w{i} " * 30, "en", "s") for i in range(40)], "text string, lang string, source string"))
    whole = quality.sketches(rows, name, "lang", "source")
    halves = [quality.sketches(rows.where(f"text {op} 'w2'"), name, "lang", "source") for op in ("<", ">=")]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "measure", "bucket").sum("n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", 0), (2, None, "<p>é</p>", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "x" * 200_000 + "\r\n\r\nWARC/1.1", 0),
            (None, "u", "", 0), (6, "u", "z", 0), (6, "u", "z", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert found == sorted([
        ("1", 9, "revisit", 2), ("2", 9, "response", None), ("3", 0, "revisit", 4), ("4", 0, "response", None), ("5", 200_012, "response", None),
        ("None", 0, "revisit", 4), ("6", 1, "response", None), ("6", 1, "response", None),
    ])
    folder = warc.write_archives(warc.page_records(pages, least_bytes=1), f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-of-a-lost-attempt.warc.gz").write_bytes(b"junk")
    back = warc.read_archives(spark, folder)
    assert back.where("record_type = 'revisit'").count() == 1
    one = back.where("record_id = '<urn:page:5>'").first()
    assert bytes(one.payload).endswith(b"WARC/1.1") and one.target_uri == "u"
    assert back.where("target_uri IN ('u', 'v') AND record_type = 'response'").count() == 6
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_plain_warc_is_read_too(spark, tmp_path):
    record = warc.record_bytes({"record_type": "response", "record_id": "<urn:page:1>", "target_uri": "a"}, b"body", 4)
    (tmp_path / "x.warc").write_bytes(record + record)
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [bytes(r.payload) for r in rows] == [b"body"] * 2


def test_pages_are_labelled_by_the_document_they_hold(spark):
    docs = spark.createDataFrame([(1, "one two three four\nsame line"), (2, "five six & seven\nsame line\nmore of it"), (3, "eight nine ten")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, False), (2, True)], "doc_id long, bad boolean")
    pages = spark.createDataFrame([
        (1, "http://b.example/", "<p>five six &amp; seven<br>more  of it</p><i>same line</i>"), (2, "http://a.example/", "<p>one two three four</p>"),
        (3, "http://c.example/", "<b>eight nine ten</b><b>same line</b>"), (4, "http://d.example/", None), (5, None, "other"),
    ], "page_id long, url string, html string")
    found = {r.url: r.bad for r in url_rules.label_pages(pages, docs, labels).collect()}
    assert found == {"http://b.example/": True, "http://a.example/": False}
