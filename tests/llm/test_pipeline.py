import os

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from headwater.llm.queries import ORACLES, QUERIES  # noqa: E402

import compare  # noqa: E402

FOLDER = f"{compare.ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.compare(spark, compare.connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, texts = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, FOLDER))
        assert docs.dtypes == columns and 0 < docs.count() <= texts
        texts = docs.count()
    assert docs.select("text").distinct().count() == texts
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == texts
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(str, packed.select("doc_id", "piece", "ids_crc32").collect())
    )


def test_stages_remove_what_brute_force_removes(spark, tmp_path):
    import random

    pick = random.Random(6)
    prose = lambda n: [f"word{pick.randrange(3000)}" for _ in range(n)]
    shared, near = prose(60), prose(200)
    changed = [*near[:100], "other", *near[101:]]
    words = {i: prose(150) for i in range(1, 9)}
    words |= {10: prose(19), 11: prose(5) * 40, 12: ["|", *prose(1)] * 5 + prose(20), 20: words[1], 21: near, 22: changed}
    words |= {23: prose(70) + shared + prose(70), 24: prose(70) + shared + prose(70), 25: prose(90) + near[20:70] + prose(90)}
    words[26] = shared  # loses every word, and goes
    rows = [(i, " ".join(w), "en", "web", len(" ".join(w))) for i, w in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    # By rule: too short, repeated; symbols above 150 per mille.
    left = {i: w for i, w in words.items() if len(w) >= 20 and i != 11 and 1000 * w.count("|") // len(w) <= 150}
    left = {i: w for i, w in left.items() if i == max(j for j, v in left.items() if v == w)}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in left.items()}
    like = lambda a, b: 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])
    left = {i: w for i, w in left.items() if not any(j < i and like(i, j) for j in left)}
    expected = {}
    for i, w in left.items():
        runs = {tuple(v[k : k + 25]) for j, v in left.items() if j < i for k in range(len(v) - 24)}
        gone = {k + x for k in range(len(w) - 24) if tuple(w[k : k + 25]) in runs for x in range(25)}
        if len(gone) < len(w):
            expected[i] = [x for k, x in enumerate(w) if k not in gone]
    assert set(expected) == {*range(2, 9), 20, 21, 23, 24, 25} and len(expected[24]) == 140 and len(expected[25]) == 180

    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, out, str(tmp_path)))
    assert {r.doc_id: r.text.split() for r in out.collect()} == expected
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(expected)
