"""Spelling variants, fingerprints and importance resampling against plain versions."""

import random

import corpus
import numpy as np
import pytest

from lendlens.llm import importance, simhash, spelling
from lendlens.llm.common import bounds, table


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus.rows()]


@pytest.fixture(scope="module")
def spellings():
    """Texts whose words are edits of one another, with accents and very long words."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(12)]
    stems += ["aaaaaa", "aaaaaaa", "abababab", "x" * 5000, "x" * 4999 + "y", "ÿÀÿÀÿ", "×÷×÷×"]
    out = []
    for d in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            k = rng.randrange(len(w))
            w = rng.choice([w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + "c" + w[k + 1 :]])
            words.append(rng.choice([w, w.title() if w[0] in "abcde" else w]))
        out.append((d, rng.choice([" ", "\n", ", 7-"]).join(words)))
    chain = ["chainword"] * 40 + ["chainwor"] * 16 + ["chainwo"] * 6 + ["hainwo"] * 3
    out += [(200 + k, " ".join(chain)) for k in range(3)]
    return [*out, (None, out[0][1]), (3, out[3][1]), (99, None), (98, "")]


def _variants(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(frame, **kw).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("cells", [spelling.CELLS, 40])
def test_spelling_variants(spark, spellings, cells):
    expected = corpus.spelling_variants(spellings)
    assert sum(e[0] is not None and e[0] != e[1] for e in expected.values()) >= 2  # chains of forms
    assert _variants(spark, spellings, cells=cells) == expected


def test_spelling_variants_of_the_corpus(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    expected = corpus.spelling_variants([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents).collect()}
    assert got == expected
    assert spelling.variants(documents.limit(0)).count() == 0


def test_one_edit_in_a_block_is_found_where_it_is():
    """All pairs of a block by products of counts, as by edits, each at one span only."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(90)})
    encoded = [w.encode() for w in words]
    long = np.array([len(w) - 6 for w in words])
    want = {
        frozenset((a, b)) for a in words for b in words if corpus.one_edit(a, b) and min(len(a), len(b)) == 6
    }
    found = []
    for lo, hi in [(0, 3), (3, 4), (4, 6)]:
        one, two = spelling.near_in_block(encoded, long, 6, lo, hi)
        found += [frozenset((words[a], words[b])) for a, b in zip(one, two)]
    assert len(found) == len(set(found)) and set(found) == want


def _prints(docs):
    got = simhash.near_duplicates(docs).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got)


def test_simhash(docs, pairs):
    prints = corpus.fingerprints(pairs)
    ids = [d for d, _ in pairs]
    assert _prints(docs) == sorted(zip(ids, prints, corpus.hamming_components(ids, prints)))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_ids(spark):
    rows = [(5, "a b c d e"), (5, None), (4, ""), (None, "a b c d e"), (None, "u v w x y z"), (7, "A b  c\td e"), (9, "q")]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, fingerprint int")
    prints = corpus.fingerprints(rows)
    ids = [d for d, _ in rows]
    expected = zip([-1 if d is None else d for d in ids], prints, corpus.hamming_components(ids, prints))
    got = simhash.near_duplicates(frame).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, int(r.fingerprint, 16), r.component_id or 0) for r in got) == sorted(
        (d, p, c or 0) for d, p, c in expected
    )


def test_fingerprint_of_a_text_in_parts(monkeypatch):
    text = corpus.sentence(random.Random(2), 400)
    whole = corpus.fingerprints([(1, text)])[0]
    assert simhash.fingerprint(text.encode()) == whole
    blocks = simhash.word_blocks
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "word_blocks", lambda t, size=size: blocks(t, size))
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"one  two") == corpus.fingerprints([(1, "one two")])[0]


@pytest.mark.parametrize("long", [simhash.LONG, 6])
def test_fingerprint_links(spark, long):
    """Links join just what lies within the radius, also over lists that are split and tiled."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base[:20]:
        for bits in (1, 2, 3, 4, 4, 5, 6):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), bits)))
    for k in range(60):  # one family that shares many bytes
        prints.add(base[0] ^ rng.getrandbits(16) << 8)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint long")
    found = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, long=long).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(p) for p in prints] == corpus.hamming_components(prints, prints)


def test_a_long_list_is_spanned():
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    members = np.array(
        sorted({centre ^ sum(1 << k for k in rng.sample(range(20), 3)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(60)}),
        dtype=np.uint64,
    )
    kept = simhash._spanning_in_long(members)
    ints = members.tolist()
    component = corpus.hamming_components(ints, ints)
    assert len(kept) == len(ints) - len(set(component))
    assert all(component[a] == component[b] for a, b in kept)


def test_digest_is_that_of_the_engine(spark):
    from pyspark.sql import functions as F

    words = ["größe", "a", "b", "日本", "x" * 50]
    got = spark.createDataFrame([(" ".join(words[:4]),), (" ".join(words[1:]),)], "t string").select(F.xxhash64("t")).collect()
    made = simhash._digests([w.encode() for w in words], 4).view(np.int64).tolist()
    assert [r[0] for r in got] == made


def _drawn(got):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in got)


@pytest.mark.parametrize("share", [(5, 100), (60, 100), (1, 1)])
def test_resample(spark, docs, pairs, share):
    items = [(1, "w1x w2x w3x w4x w5x"), (2, None), (3, pairs[20][1])]
    target = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((*r[:4], r[4] or 0) for r in corpus.draw(pairs, items, share=share))
    assert _drawn(importance.resample(docs, target, share=share).collect()) == expected
    assert importance.resample(docs.limit(0), target).count() == 0
    empty = sorted((*r[:4], r[4] or 0) for r in corpus.draw(pairs, [], share=share))
    assert _drawn(importance.resample(docs, target.limit(0), share=share).collect()) == empty


def test_resample_of_the_corpus(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    expected = sorted((*r[:4], r[4] or 0) for r in corpus.draw(rows, items))
    assert sum(r[4] > 0 for r in expected) > 5
    assert _drawn(importance.resample(documents, benchmark).collect()) == expected


def test_resample_ties_and_ids(spark):
    text = " ".join(f"t{k}" for k in range(25))
    rows = [(7, text)] * 30 + [(8, text)] * 3 + [(None, text), (9, "short"), (10, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = importance.resample(frame, frame.limit(0), share=(1, 2)).collect()
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, 17))  # 33 rows are long enough and have an id
    assert len(got) == len(rows)
    assert all(r.score is None and r.rank is None and r.weight is not None for r in got if r.doc_id is None)
    assert [(r.n_features, r.weight) for r in got if r.doc_id == 10] == [(0, 0)]


def test_features_of_a_text_in_parts(monkeypatch):
    text = corpus.sentence(random.Random(6), 300).encode()
    whole = sorted(np.concatenate([f for _, f in importance.buckets(text)]).tolist())
    blocks = importance.word_blocks
    for size in (1, 9, 200):
        monkeypatch.setattr(importance, "word_blocks", lambda t, size=size: blocks(t, size))
        parts = list(importance.buckets(text))
        assert sorted(np.concatenate([f for _, f in parts]).tolist()) == whole
        assert sum(n for n, _ in parts) == 300


def test_bounds():
    assert bounds(np.array([3, 3, 5])).tolist() == [0, 2, 3]
    assert bounds(np.array([])).tolist() == [0]
