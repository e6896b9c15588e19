"""The Merkle manifest against a brute-force tree."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from pyspark.sql import functions as F

from headwater.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def root_and_siblings(nodes, fan):
    """Root, and per node the texts left and right of its ancestors, level by level."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            start = at - at % fan
            paths[i].append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + fan])))
        nodes = [h(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        where = [at // fan for at in where]
    return nodes[0], paths


def brute(rows, fan=2):
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    found = {v: root_and_siblings([leaf(r) for r in trees[v]], fan) for v in langs}
    root, top = root_and_siblings([found[v][0] for v in langs], fan)
    out = []
    for v, above in zip(langs, top):
        for row, below in zip(trees[v], found[v][1]):
            path = below + above
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf(row, int(tampered))
            for left, right in path:
                node = h([left, node, right])
            out.append((row[0], leaf(row), found[v][0], root, h([a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "rank": F.lit("x"), "KEY": F.lit(None).cast("string"), "path": F.lit(2)})
    seven = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.verified_proofs(docs, seven)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_trees_of_every_shape(spark):
    pick = random.Random(5)
    for sizes in ([1], [3, 1, 256], [257, 5, 1, 700]):
        rows = []
        for lang, size in zip(["en", None, "é", ""], sizes):
            rows += [(pick.randrange(10**6), pick.choice([None, "", "s"]), lang, pick.choice([None, 0, 9]), "t" * pick.randrange(4)) for _ in range(size)]
        assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (7, "a", "-", 1, ""), (7, "a", "-", 1, None), (-3, "é" * 9, "-", 2**63 - 1, "x" * 200_000),
        *[(11, "s", "de", 4, "same")] * 700, *[(i, "s", "fr", None, "\0\n") for i in range(40)],
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


@pytest.mark.parametrize("fan, levels", [(3, 2)])
def test_other_fans(spark, fan, levels):
    rows = [(i, "s", "en" if i % 5 else "fr", i, "t") for i in range(100)]
    trees, top = merkle.build(spark.createDataFrame(rows, SCHEMA), fan=fan, levels=levels)
    found = merkle.proofs(trees, top, fan, levels)
    got = {(r.key, r.leaf, r.subroot, r.root, merkle_text(r.siblings)) for r in found.collect()}
    assert got == {(r[0], r[1], r[2], r[3], r[4]) for r in brute(rows, fan)}
    assert found.where(merkle.folded(F.col("leaf"), F.col("siblings")) == F.col("root")).count() == 100


def merkle_text(siblings):
    return h([s.left + s.right for s in siblings])


def test_a_false_record_is_found():
    good = ["aa" * 32, "bb" * 32]
    head = bytes.fromhex(merkle.levels_of(good, 1, 2)[-1][0])
    children = [bytes.fromhex(c) for c in good]
    assert merkle._segment(head, 1, children, 2) == [[("", good[1])], [(good[0], "")]]
    with pytest.raises(ValueError):
        merkle._segment(head, 1, children[::-1], 2)
