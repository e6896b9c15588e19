"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from headwater.llm import spelling

FIELDS = "doc_id long, text string, word string, m int, piece string, N long"


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def brute(rows, letters=7):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(pick):
    base = ["interesting", "eranenes", "aaaaaaa", "éclairée", "ÉCLAIRÉE", "abababab", "station", "stations", "straßen", "naïveté"]
    words = Counter({w: pick.choice([3, 30, 300]) for w in base})
    for _ in range(150):
        w = pick.choice(base)
        for _ in range(pick.choice([1, 1, 2])):
            i, c = pick.randrange(len(w) + 1), pick.choice("aeébÿ×")
            w = pick.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        words[w] += pick.choice([2, 2, 5])
    words |= {"remember": 400, "remembers": 30, "rememberss": 3, "rememberxs": 2}
    every = [w for w, c in words.items() for _ in range(c)]
    pick.shuffle(every)
    rows = [(i, pick.choice([" ", "-", "ā", "1"]).join(every[i : i + 37])) for i in range(0, len(every), 37)]
    return rows + [(None, None), (5, ""), (None, "Interesting STATION"), (3, "q" * 50_000 + " " + "q" * 49_999), (4, "q" * 50_000 + " " + "q" * 49_999), (4, "q" * 50_000)]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "w", 1, "p", 2) for d, t in rows], FIELDS)
    found = spelling.spelling_variants(docs, **kw)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("limit", [spelling.LIST_WORDS, 3])
def test_variants(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "LIST_WORDS", limit)
    rows = rows_of(random.Random(4))
    short = [(d, t) for d, t in rows if len(t or "") < 40_000]
    expected = brute(short)
    assert any(r[2] not in (r[0], r[1]) for r in expected)  # a chain of forms
    long_words = [("q" * 49_999, None, "q" * 49_999, 2, 1, None), ("q" * 50_000, None, "q" * 50_000, 3, 1, None)]
    assert run(spark, rows) == sorted(expected + long_words)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "one two")]) == []


def test_near_pairs_of_sorted_lists():
    pick = random.Random(8)
    for _ in range(60):
        lists = [sorted({"".join(pick.choice("ab") for _ in range(pick.randrange(1, 8))) for _ in range(pick.randrange(2, 30))}) for _ in range(4)]
        lists = [x for x in lists if len(x) > 1]
        words = [w for x in lists for w in x]
        group = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        table, lengths = spelling.code_points(words)
        a, b = spelling.near_pairs(table, lengths, group, np.arange(len(words)))
        expected = {(i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and edits(words[i], words[j]) == 1}
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(expected)
