"""Substring, exact and near dedup against plain versions."""

import corpus
import pytest

from lendlens.llm import exact_dedup, near_dedup, substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus.rows()]


@pytest.mark.parametrize("crowded", [1000, 2])
def test_substring_dedup(docs, pairs, crowded, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == corpus.without_repeats(pairs)
    assert all(corpus.sha(r.kept_text) == r.kept_sha256 for r in got)


def test_substring_dedup_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(None, text), (3, text), (3, text), (4, text + " more"), (3, "other")]
    got = substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [
        (-1, 30, 0), (3, 1, 0), (3, 30, 30), (3, 30, 30), (4, 31, 30)
    ]
    assert substring_dedup.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block_bytes", [2048, 16])
def test_exact_dedup(docs, pairs, block_bytes):
    got = exact_dedup.groups(docs, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == corpus.equal_texts(pairs)


def test_exact_dedup_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (3, ""), (5, "b" * 5000), (4, "b" * 5000), (6, "b" * 4999)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, place string")
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs).collect())
    assert got == [
        (-1, 1, 3, False), (-1, 3, 2, False), (1, 1, 3, False), (1, 1, 3, True), (3, 3, 2, True),
        (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True),
    ]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_near_dedup(docs, pairs):
    got = near_dedup.near_duplicates(docs).collect()
    expected = corpus.near_groups(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in expected.items() if d == c}


def test_near_dedup_links_across_the_smallest(spark):
    """Documents unlike the smallest of their key still link with each other."""
    words = [f"u{k}" for k in range(300)]

    def changed(places):
        return " ".join(f"y{k}" if k in places else w for k, w in enumerate(words))

    rows = [(10, changed(range(0, 60))), (11, changed(range(60, 66))), (12, changed(range(60, 70))), (13, changed(()))]
    rows += [(None, changed(())), (14, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    expected = {d: c for d, (_, c) in corpus.near_groups([r for r in rows if r[0]]).items()}
    assert got == {**expected, None: None}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_confirms_few_pairs_of_a_family(spark, monkeypatch):
    """Documents that are all a little too unlike each other: no step confirms pairs by the square of their number."""
    import random

    rng, n, asked = random.Random(11), 60, []
    words = [f"f{k}" for k in range(600)]

    def member(d):
        places = set(rng.sample(range(600), 14))
        return " ".join(f"m{d}x{k}" if k in places else w for k, w in enumerate(words))

    rows = [(d, member(d)) for d in range(n)] + [(n, member(0)), (n + 1, " ".join(words))]
    confirmed = near_dedup._confirmed

    def counted(pairs, *args):
        pairs = near_dedup.written(pairs)
        asked.append(pairs.count())
        assert pairs.distinct().count() == asked[-1]
        return confirmed(pairs, *args)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    for some in (rows[:n], rows):  # without and with the document that all others come from
        docs = spark.createDataFrame(some, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
        assert got == {d: c for d, (_, c) in corpus.near_groups(some).items()}
    assert max(asked) <= near_dedup.LEADERS * len(rows)


def test_near_dedup_judges_each_text_of_a_repeated_id(spark):
    """Ids with several texts: no link is missed and no unrelated text is lost."""
    one = " ".join(f"p{k}" for k in range(200))
    two = " ".join(f"q{k}" for k in range(200))
    other = " ".join(f"r{k}" for k in range(50))
    rows = [(5, one), (5, two), (5, two), (7, two + " end"), (3, one + " end"), (5, other), (5, None), (9, other + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [
        (3, 197, 3), (5, 0, 5), (5, 46, 5), (5, 196, 3), (5, 196, 5), (5, 196, 5), (7, 197, 5), (9, 47, 5)
    ]
    kept = sorted((r.doc_id, r.text or "") for r in near_dedup.deduplicate(docs).collect())
    assert kept == [(3, one + " end"), (5, ""), (5, two), (5, two), (5, other)]


def test_signature_radius():
    """Signatures within the radius share a key, wherever they differ."""
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (200, near_dedup.POSITIONS), dtype=np.uint16)
    b = a.copy()
    for r in range(len(b)):
        b[r, rng.choice(near_dedup.POSITIONS, near_dedup.RADIUS, replace=False)] ^= 1
    x, y = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(x, y))


def test_near_duplicates_refuse_a_similarity_that_keys_would_miss(spark):
    table = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="75"):
        near_dedup.near_duplicates(table, percent=74)
