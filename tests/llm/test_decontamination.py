"""Decontamination against a brute-force search of windows."""

import random
import re

import pytest

from pyspark.sql import functions as F

from headwater.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = "doc_id long, text string, words string, row int, ITEM string, sha string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        found = WORD.findall(lowered(text))
        for i in range(max(1, len(found) - 9)):
            if found:
                windows.setdefault(tuple(found[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        found, hit, names = WORD.findall(lowered(text)), set(), set()
        for n in range(1, 11):
            for i in range(len(found) - n + 1):
                owners = windows.get(tuple(found[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    names |= owners
        out.append((key, len(found), len(hit), len(names), sorted(names), bool(hit), hit))
    return out


def cases():
    pick = random.Random(11)
    vocabulary = ["a", "B", "The", "é", "É", "straße", "x1", "42", "日本", "İ", "ſ", "of"]
    prose = lambda n, end=" ": end.join(pick.choice(vocabulary) for _ in range(n))
    long_item = prose(30)
    items = [
        (1, long_item), (2, long_item), (10, long_item.upper() if long_item.isascii() else long_item), (3, "short Item"), (4, None), (5, ""), (6, "..."), (None, prose(12)),
        (7, prose(10)), (7, prose(10)), (8, "one two three four five six seven eight nine"), (9, "a " * 10),
    ]
    docs = [
        (0, f"{prose(5)} {long_item} {prose(4)}"), (1, None), (2, ""), (3, "?!"), (4, "...SHORT, item\n\nend"), (5, "a-" * 25), (5, "a-" * 25), (None, prose(40)),
        (6, " ".join(long_item.split()[3:13])), (7, " ".join(long_item.split()[3:12])), (8, "One\0two three\tfour five six, seven (eight) NINE ten"),
        (9, prose(20_000, ", ") + " " + long_item), *[(100 + i, prose(pick.randrange(60))) for i in range(60)],
    ]
    return docs, items


def frames(spark, docs, items):
    wide = spark.createDataFrame([(k, t, "w", 1, "i", "s") for k, t in docs], FIELDS)
    return wide, spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, window string")


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_BYTES, 0])
def test_hits_and_items(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bound)
    docs, items = cases()
    found = decontamination.contamination(*frames(spark, docs, items))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "NestedLoop" not in plan
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted((row[:-1] for row in brute(docs, items)), key=str)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_PLACES", 64)
    monkeypatch.setattr(decontamination, "MOST_PLACES", 64)
    docs, items = cases()
    found = decontamination.contamination(*frames(spark, docs, items))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(row[:-1]) for row in brute(docs, items))


def test_removal(spark):
    docs, items = cases()
    table, benchmark = frames(spark, docs, items)
    cleaned = decontamination.decontaminate(table, benchmark)
    assert cleaned.dtypes == table.dtypes
    expected = []
    for (key, text), (*_, hit) in zip(docs, brute(docs, items)):
        pieces = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text or "")
        head = re.match(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text or "")[0]
        expected.append((key, text if not hit else head + "".join(p for i, p in enumerate(pieces) if i not in hit)))
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == sorted(expected, key=str)
    left = decontamination.decontaminate(table, benchmark, "documents")
    clean = [(k, t) for (k, t), row in zip(docs, brute(docs, items)) if not row[-1]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)
    with pytest.raises(ValueError):
        decontamination.decontaminate(table, benchmark, "lines")


def test_empty_tables(spark):
    docs, items = cases()
    table, benchmark = frames(spark, docs, items)
    assert decontamination.contamination(table.limit(0), benchmark).count() == 0
    clean = decontamination.contamination(table, benchmark.limit(0))
    assert clean.count() == len(docs) and clean.where(F.expr("contaminated OR n_items > 0")).count() == 0
