import random

import numpy as np
import pytest

from headwater.llm import banding, exact_dedup, near_dedup, paragraphs
from headwater.llm.components import components
from headwater.llm.shingles import band_keys, bands_for, shingle_set, similar

WORDS = [f"w{i}" for i in range(3000)]


def prose(pick, n):
    return [pick.choice(WORDS) for _ in range(n)]


def test_binary_fuse_filter():
    pick = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000, 60_000):
        keys = pick.integers(0, 2**63, n).astype(np.uint64)
        built = exact_dedup.build_filter(keys)
        assert exact_dedup.may_contain(keys, *built).all()
        others = pick.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
        assert exact_dedup.may_contain(others, *built).mean() < 0.02


def test_circulant_minhash_estimates_similarity():
    pick = np.random.default_rng(2)
    shared, a, b = (pick.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = (near_dedup.circulant_minhash(np.concatenate([shared, s]), 1024) for s in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.06
    many = near_dedup.circulant_minhash_of([shared, a], 30)
    assert (many[1] == near_dedup.circulant_minhash(a, 30)).all()
    assert len(band_keys(many[0], 10, 3)) == 10 and 1 - (1 - 0.8**4) ** bands_for(0.8, 0.999, 4) >= 0.999


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (300, 300), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(spark):
    rows = [(1, "x", "en"), (2, "x", "de"), (3, None, "en"), (4, "", "en"), (5, "X", None), (7, "y", "en"), (7, "y", "en"), (None, "z", "en"), (9, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    found = exact_dedup.exact_duplicates(docs, exact_dedup.older_half(docs)).collect()
    assert len(found) == len(rows)
    seen = {r.doc_id: (r.keep_id, r.group_size) for r in found}
    assert seen == {1: (9, 3), 2: (9, 3), 9: (9, 3), 3: (4, 2), 4: (4, 2), 5: (5, 1), 7: (7, 2), None: (None, 1)}
    assert sorted(str(r.doc_id) for r in found if r.kept) == ["4", "5", "7", "9", "None"]
    kept = exact_dedup.drop_exact_duplicates(docs, exact_dedup.older_half(docs))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "7", "9", "None"]
    assert exact_dedup.exact_duplicates(docs.limit(0), exact_dedup.older_half(docs.limit(0))).count() == 0


def test_small_and_large_groups_give_the_components_of_all_pairs(spark):
    pick = random.Random(3)
    base = prose(pick, 60)
    texts = []
    for _ in range(60):  # a dense group around the threshold
        words = list(base)
        for at in pick.sample(range(60), pick.randint(0, 3)):
            words[at] = pick.choice(WORDS)
        texts.append(" ".join(words))
    texts += [" ".join(base[:30] + prose(pick, 30)) for _ in range(30)]  # half alike: no links
    texts += ["A b c", "a B c", "", None, "a b c d", "x " * 5000, "x " * 4000, " ".join(prose(pick, 20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [shingle_set(t, 4) for _, t in rows]
    above = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if above[i] != above[j] and similar(a, sets[j], 80):
                    above[i] = above[j] = min(above[i], above[j])
    small = banding.SMALL
    try:
        for banding.SMALL in (2, 16):
            found = near_dedup.near_duplicates(docs).collect()
            assert len(found) == len(rows)
            by_id = {r.doc_id: r for r in found}
            for (number, _), s, top in zip(rows, sets, above):
                assert by_id[number].n_shingles == len(s)
                if number is not None:
                    assert by_id[number].component_id == top and by_id[number].kept == (top == number)
    finally:
        banding.SMALL = small
    kept = near_dedup.drop_near_duplicates(docs, k=4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.distinct().collect()) == sorted({a for a in above if rows[a][0] == a})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_passages(spark):
    pick = random.Random(4)
    passage, line = prose(pick, 60), prose(pick, 80)
    near = list(line)
    near[40] = "other"
    texts = {
        1: " ".join(prose(pick, 100) + passage + prose(pick, 90)), 2: " ".join(prose(pick, 30) + passage + prose(pick, 41)),
        3: " ".join(prose(pick, 200)), 4: "head\n" + " ".join(line) + "\ntail", 5: "top words\n" + " ".join(near) + "\nend",
        6: None, 7: "", 8: "same " * 400, 9: " ".join(prose(pick, 20)),
    }
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in texts.items()] + [(3, texts[3], 5, "s")], "doc_id long, text string, n_chars long, spans string")
    rows = {r.doc_id: r for r in paragraphs.substring_duplicates(docs).collect()}
    assert {i for i, r in rows.items() if not r.kept} == {2, 5}
    assert rows[2].kept_in == [1] and rows[2].component_id == 1 and 25 <= rows[2].removed_words <= 60
    assert rows[5].kept_in == [4] and rows[5].removed_words == 80
    clean = paragraphs.drop_repeated_passages(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    out = {r.doc_id: r for r in clean.collect()}
    assert out[5].text == "top words\n\nend" and out[5].n_chars == len(out[5].text)
    assert all(out[i].text == t for i, t in texts.items() if i not in (2, 5))
    assert " ".join(passage) not in out[2].text and set(out[2].text.split()) >= set(texts[2].split()[:30])
    assert paragraphs.substring_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("before", [0, 7, 300])
def test_a_passage_of_fifty_words_is_found_anywhere(before):
    from headwater.llm.shingles import shingle_hashes, word_hashes

    pick = random.Random(before)
    passage = [w.encode() for w in prose(pick, 50)]
    found = []
    for _ in range(20):
        words = [w.encode() for w in prose(pick, before)] + passage + [w.encode() for w in prose(pick, 40)]
        found.append({d.tobytes() for d in paragraphs.anchored_paragraphs(shingle_hashes(word_hashes(b" ".join(words).decode()), 5))[1]})
    assert set.intersection(*found)


def test_passages_go_to_their_ends_and_near_copies_of_short_paragraphs_go_too(spark):
    pick = random.Random(5)
    exact, changed, added, short, wrapped, notice = (prose(pick, n) for n in (51, 50, 44, 25, 60, 20))
    other = changed[:25] + ["other"] + changed[26:]
    longer = added[:22] + ["more"] + added[22:]
    broken = list(wrapped)
    broken[30] = "other"

    def inside(words):
        return " ".join(prose(pick, 70) + words + prose(pick, 70))

    def folded(words):
        return "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))

    texts = {
        1: inside(exact), 2: inside(exact), 3: inside(changed), 4: inside(other), 5: inside(added), 6: inside(longer),
        7: inside(short), 8: inside(short), 9: "a\n\n" + folded(wrapped) + "\n\nb", 10: "c\n\n" + folded(broken) + "\n\nd",
        11: inside(notice * 5), 12: inside(notice * 5), 13: inside(short[:24]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    removed = {r.doc_id: r.removed_words for r in paragraphs.substring_duplicates(docs).collect() if not r.kept}
    assert removed == {2: 51, 4: 50, 6: 45, 8: 25, 10: 60, 12: 100}
    clean = {r.doc_id: r.text for r in paragraphs.drop_repeated_passages(docs).collect()}
    for i, n in ((2, 51), (4, 50), (6, 45), (8, 25), (12, 100)):
        words = texts[i].split()
        assert clean[i].split() == words[:70] + words[70 + n :]
    assert clean[10].split() == ["c", "d"]


@pytest.mark.parametrize("period", range(1, 25))
def test_seeds_of_a_text_with_a_period_leave_no_gap(period):
    from headwater.llm.shingles import shingle_hashes, word_hashes

    text = " ".join(prose(random.Random(period), period) * (200 // period))
    starts, _ = paragraphs.anchored_paragraphs(shingle_hashes(word_hashes(text), 5))
    assert np.diff(starts).max() <= paragraphs.SEED_WORDS


def test_texts_in_a_row_give_the_shingles_and_seeds_of_each():
    from headwater.llm.shingles import distinct, shingle_hashes, shingles_of, word_hashes

    pick = random.Random(7)
    texts = [" ".join(pick.choice(WORDS[:many]) for _ in range(n)) for n in (0, 1, 4, 5, 11, 12, 15, 16, 60, 200, 0) for many in (1, 3, 3000)]
    hashes = [word_hashes(t) for t in texts]
    found, sizes = shingles_of(np.concatenate(hashes), np.array([len(h) for h in hashes]), 5)
    apart = [shingle_hashes(h, 5) for h in hashes]
    assert sizes.tolist() == [len(x) for x in apart] and (found == np.concatenate(apart)).all()
    first = np.cumsum(sizes) - sizes
    places, digests = paragraphs.anchored_paragraphs(found, sizes)
    expected = [(f + s, d) for x, f in zip(apart, first.tolist()) for s, d in zip(*(y.tolist() for y in paragraphs.anchored_paragraphs(x)))]
    assert list(zip(places.tolist(), digests.tolist())) == expected and len(expected) > 100
    assert all((distinct(x) == np.unique(x)).all() for x in apart)


def test_chains_of_one_stretch_share_the_steps_of_its_growth(monkeypatch):
    pick, steps, one = random.Random(8), [], paragraphs.next_run
    own = np.array([pick.randrange(2**32) for _ in range(600)], np.uint32)
    theirs = np.concatenate([part for i in range(0, 600, 30) for part in (own[i : i + 30], [i])]).astype(np.uint32)
    monkeypatch.setattr(paragraphs, "next_run", lambda a, b: steps.append(1) or one(a, b))
    chains = [(i, i + i // 30, 12) for i in range(0, 600, 30)]
    assert paragraphs.grown(own, theirs, chains, 80)
    assert len(steps) <= 2 * len(chains) + 2
