"""Held-out accuracy of the classifiers, their edge cases, and the pipeline against plain versions."""

import os
import zlib

import corpus
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lendlens.llm import bpe, language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality(docs, labels):
    rows = quality.report(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted == r.quality for r in held)
    assert right >= 0.95 * len(held) > 0


def test_quality_learns_from_all_pairs(docs, labels):
    """The weights are stationary for the loss over every pair, steps and threshold are those of all rows."""
    import numpy as np

    model = quality.learn(docs, labels)
    got = quality.labelled(docs, labels).toPandas()
    x, good = np.stack(got.x), got.good.to_numpy()
    assert np.allclose(model.steps, np.quantile(x, np.linspace(0.1, 0.9, 9), axis=0).T, rtol=1e-12, atol=1e-12)
    design = model.design(x)
    z = design @ model.weights
    lost = 1 / (1 + np.exp(z[good][:, None] - z[~good][None, :]))
    gradient = quality.PENALTY * model.weights - (
        lost.sum(1) @ design[good] - lost.sum(0) @ design[~good]
    ) / lost.size
    assert np.abs(gradient).max() < 1e-6
    ordered, bad = np.sort(z), (~good).sum()
    assert model.threshold == (ordered[bad - 1] + ordered[bad]) / 2
    assert np.isclose(model.scale, 2 / np.median(np.abs(z - model.threshold)))


def test_quality_edges(spark, docs, labels):
    model = quality.learn(docs, labels)
    table = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    out = quality.scored(table, model).collect()
    assert len(out) == table.count() and all(0 <= r.score <= 1 for r in out)
    by_text = {r.text or "": r.score for r in out}
    assert all(by_text[r.text or ""] == r.score for r in out)
    none = labels.limit(0)
    assert {r.score for r in quality.report(table, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 1), (3, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.report(table, odd).collect()} == {0.5}
    assert quality.report(table.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(docs, labels):
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")
    ).otherwise(F.col("quality")))
    a, b = (dict((r.doc_id, r.score) for r in quality.report(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_language(docs):
    rows = language.report(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.text and len(r.text) > 40]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    model = language.learn(docs)
    table = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    got = {r.doc_id: r for r in language.predicted(table, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3
    assert got[3].lang_pred in model.languages
    assert got[3].score > 0 and got[0].score == 0
    signs = spark.createDataFrame([(1, "½ ☃ 12 —"), (None, "the the")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language.predicted(signs, model).collect()} == {1: True, None: False}
    bare = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.report(bare).collect()} == {"und"}
    assert language.report(docs.limit(0)).count() == 0


def test_language_of_very_long_texts(spark, docs):
    """Natural English of 400 KB in one text, and texts of one language joined, keep their language."""
    from pydoc_data.topics import topics

    model = language.learn(docs)
    english = "\n".join(topics[k] for k in sorted(topics))[:400_000]
    assert len(english) == 400_000
    texts = [(0, english, "en"), (1, english[:100_000], "en"), (2, english[-20_000:], "en")]
    for r in docs.filter("lang is not null").groupBy("lang").agg(F.array_join(F.collect_list("text"), "\n").alias("t")).collect():
        texts.append((len(texts), (r.t * (1 + 1_000_000 // len(r.t)))[:1_000_000], r.lang))
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in language.predicted(table, model).collect())


def test_blocks_hold_each_ngram_once():
    """Short texts are one block; a longer text's blocks mark all its n-grams and no others."""
    import numpy as np
    import pyarrow as pa

    short = pa.array(["Abc abd", None, "", "日本"])
    assert np.array_equal(language.features(short), language.normed(language.presence(short)))
    long = pa.array(["ab", "".join(chr(97 + k * k % 23) for k in range(3 * language.BLOCK + 7)), "yz"])
    marked = np.zeros((3, language.BUCKETS), dtype=bool)
    blocks = [(t, x) for text, rows in language.blocks(long) for t, x in zip(text, rows)]
    for t, x in blocks:
        marked[t] |= x > 0
    assert [t for t, _ in blocks] == [0, 1, 1, 1, 1, 2]
    assert np.array_equal(marked, language.presence(long) > 0)


def test_kernel_is_what_it_says():
    """Presence products equal sets of hashed n-grams counted one by one."""
    import numpy as np
    import pyarrow as pa

    texts = ["Abc abd", "", "bcd", "日本"]
    x = language.presence(pa.array(texts))
    for r, text in enumerate(texts):
        data = text.encode().lower()
        grams = {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}
        assert x[r].sum() == len(grams)  # no two of these few share a bucket
    k = language.normed(x) @ language.normed(x).T
    assert np.isclose(k[0, 0], 1) and 0 < k[0, 2] < 1 and k[1].sum() == 0


def test_pipeline(spark, docs, tmp_path):
    """Stage by stage: quality by its own scores, the other stages by plain versions."""
    awkward = spark.createDataFrame(
        [(100_000 + r[0], r[1], "en", "s", 1, "x", "y") for r in corpus.rows()],
        "doc_id long, text string, lang string, source string, n_chars long, found string, score string",
    )
    table = docs.limit(300).withColumns({"found": F.lit("x"), "score": F.lit("y")}).unionByName(awkward)
    table.write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    functions = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in table.collect()}

    model = quality.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(table, model, score="s").filter("s >= 0.5").collect()}
    stage = functions["quality classifier"](spark, table, SF)
    assert stage.columns == table.columns
    assert {r.doc_id for r in stage.collect()} == good

    stage = functions["exact dedup"](spark, table, SF)
    assert stage.columns == table.columns
    expected = {d for d, v in corpus.equal_texts(before.items()).items() if v[2]}
    assert {r.doc_id for r in stage.collect()} == expected

    stage = functions["near dedup"](spark, table, SF)
    assert stage.columns == table.columns
    expected = {d for d, (_, c) in corpus.near_groups(before.items()).items() if d == c}
    assert {r.doc_id for r in stage.collect()} == expected

    stage = functions["benchmark decontamination"](spark, table, SF)
    assert stage.columns == table.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {d for d, (_, hit, _) in corpus.benchmark_hits(before.items(), items).items() if not hit}
    assert {r.doc_id for r in stage.collect()} == expected

    ranks = bpe.ranks_of(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in functions["byte-level BPE"](spark, table, SF).collect()}
    assert got == {d: plain.encode_ordinary(t or "") for d, t in before.items()}


def test_pipeline_as_a_whole(spark, tmp_path):
    """run() is its stages applied to documents in order, and an empty table stays empty."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    for name, table in (("some", source.limit(200)), ("none", source.limit(0))):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            os.symlink(f"{SF}/{other}.parquet", f"{folder}/{other}.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()}
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, str(folder)).write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
        assert got == {r.doc_id for r in docs.collect()}
        assert bool(got) == (name == "some")
