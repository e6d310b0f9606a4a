"""Decontamination, secrets and byte-level BPE against plain versions."""

import hashlib
import random
import re

import corpus
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lendlens.llm import bpe, decontaminate, secret_scan


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3)


def items():
    rng = random.Random(5)
    passage = corpus.sentence(rng, 60).split()
    return [
        (1, " ".join(passage[5:30]).upper()), (2, " ".join(passage[10:22])), (10, "a, b; C!"), (11, "la"), (12, None),
        (13, "..."), (None, "w1x w2x"), (14, " ".join(passage[40:50])), (14, " ".join(passage[40:50])),
    ]


@pytest.mark.parametrize("at_once", [50_000, 7])
def test_decontamination(spark, docs, at_once, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_PATTERNS", at_once)
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    found = decontaminate.search(docs, benchmark).withColumn("n_hit", decontaminate.n_hit())
    assert found.columns == [*[c for c in docs.columns if c != "found"], "found", "n_hit"]
    got = {r.doc_id: (r.found.n_words, r.n_hit, set(map(int, r.found["items"]))) for r in found.collect()}
    assert got == corpus.benchmark_hits([(r[0], r[1]) for r in corpus.rows()], items())


def test_decontamination_report(spark, docs):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    expected = corpus.benchmark_hits([(r[0], r[1]) for r in corpus.rows()], items())
    for r in decontaminate.report(docs, benchmark).collect():
        words, hit, found = expected[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (words, hit, len(found), digest, hit > 0)
    nothing = decontaminate.report(docs, benchmark.limit(0))
    assert nothing.filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0


SECRETS = [
    (1, 'password = "hunter2hunter2" and Token:abcdefghijkl'), (2, "AKIAABCDEFGHIJKLMN AKIASHORT"), (3, "deadbeef" * 2 + " deadbeef"),
    (4, None), (5, ""), (6, 'é SECRET="0123456789abcdef0123"; secret=short'), (7, "API_KEY = x apikey:'abcdefghijklmnop'"),
    (8, "authorization: qZx81LkP0vTr99sWmY3eUjA and then authorization: configuration_environment"),
    (9, "paſſword=abcdefghijklmn toKen=abcdefghijklmn"), (9, "AKIAABCDEFGHIJKLMN"), (None, "tokentoken=aaaaaaaaaaaa"),
]


def test_secrets(spark):
    docs = spark.createDataFrame([(*r, "x") for r in SECRETS], "doc_id long, text string, secrets string")
    assign = re.compile(
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    )
    got = {(r.doc_id, r.base_sha256): r for r in secret_scan.report(docs).collect()}
    for doc_id, text in SECRETS:
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        told = [f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(found)]
        r = got[doc_id, corpus.sha(",".join(told))]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == told
    (eighth,) = (r for r in got.values() if r.doc_id == 8)
    assert [x for x in eighth.spans.split(",") if x.startswith("novel")] == ["novel:15:38"]
    assert secret_scan.report(docs.limit(0)).count() == 0


def test_novelty():
    assert secret_scan.novelty("qZx81LkP0vTr99sWmY3eUj", "auth: ", "") > 0.9
    assert secret_scan.novelty("configuration_environment", "auth: ", "") < 0.5


KEYS = ["q7Zt9LxW2vB8mN4pR6sK", "Hc3YwD0fJg5TkU1oXe8S", "Vb6nQ2rMz7LiPa4GyEd9"]


@pytest.mark.parametrize("text", [
    "<password>{0}</password>", '"token", "{0}"', "my secret is {0}", "passwd {0}", 'credentials = load_credentials_from_env("{0}")',
    "auth({0}, {1}, {2})", "authorization:\n    {0}\n", "bearer\r\n\r\n{0} {1}", "session_key={0}", "password {0}\npassword {0}",
    "cookie {0} " + "filler " * 40 + "cookie {0}", "auth {0}=", "é credential\n" + "{0}{1}{2}\n" * 40,
    "key " + "{0}" * 30 + " {1}", "the " * 24 + "key" + " of it" * 21 + " {0}",
])
def test_strings_in_a_sensitive_context_are_measured(text):
    told = text.format(*KEYS)
    found = [told[a:b] for a, b, kind in secret_scan.spans(told) if kind == "novel"]
    found = [s for s in found if any(k in s for k in KEYS)]  # a name in the call may be novel, too
    strings = [s for s in re.findall("[A-Za-z0-9]{16,}=?", told) if any(k in s for k in KEYS)]
    assert found == [s for s in strings if s.count(KEYS[0]) < 9]


def test_strings_out_of_context_are_not_candidates():
    for text in ("{0} {1}", "{0} and then the key", "key" + " of it" * 22 + " {0}", "password: {0}", "key " + "deadbeef" * 2):
        assert not [s for s in secret_scan.spans(text.format(*KEYS)) if s[2] == "novel"]


def test_redaction():
    text = SECRETS[0][1]
    assert "hunter2" not in secret_scan.redacted(text, secret_scan.spans(text))


EXTRA = [
    "it's I'LL we'll\r\n\r\n\t\t  end  ", "<|endoftext|> ½²³ ٣٤ ́̀ ﻿ \x7f\x85z",
    "héé   x  \x1c\x1d ZZ", "a" * 300 + "=" * 257, "日本語のテキスト \U0001F3F3️‍\U0001F308",
]


def test_byte_bpe(spark, docs):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = docs.select("doc_id", "text", F.col("key").alias("ids"))
    more = spark.createDataFrame([(1000 + k, t, "x") for k, t in enumerate(EXTRA)], table.schema)
    table = table.unionByName(more)
    encoded = tokenizer.encode(table, most=500).select("*", tokenizer.decode(F.col("ids")).alias("back")).collect()
    for r in encoded:
        assert r.ids == plain.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.report(table.limit(12), tokenizer).collect()}
    by_id = {r.doc_id: r for r in encoded}
    for doc_id, r in digests.items():
        assert r.n_tokens == len(by_id[doc_id].ids)
        assert r.ids_sha256 == corpus.sha(",".join(map(str, by_id[doc_id].ids)))
        assert r.decoded_sha256 == corpus.sha(by_id[doc_id].text or "")
    assert bpe.report(table.limit(0), tokenizer).count() == 0


def test_texts_under_one_key(spark, monkeypatch):
    """A text's key is short; texts that happen to share one, also with as many rare words, keep their own ids."""
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.KEY_BITS <= 48
    monkeypatch.setattr(bpe, "KEY_BITS", 1)
    texts = ["qzxv the wkjy", "wkjy the qzxv", "the qzxv", "the the qzxv", "the", "", None, "vvkq wkjy qzxv the", "qzxv the wkjy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 2, 500):
        for r in tokenizer.encode(rows, most=most).collect():
            assert r.ids == plain.encode_ordinary(r.text or "")


def test_long_runs(spark):
    """Unbroken runs of many bytes, whose equal pairs overlap, in one step each."""
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["=" * 50_000, "a" * 20_001, " " * 9_999 + "x", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))]
    texts += ["".join(rng.choices(s, k=n)) for s in ("aab", "-=", "anbé", "xyxX") for n in (33, 64, 65, 200, 801)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in tokenizer.encode(rows, most=0).collect():
        assert r.ids == plain.encode_ordinary(r.text)


def test_vocabulary_with_a_token_below_its_parts(spark):
    ranks = {bytes([k]): k + 10 for k in range(256)} | {b"ab": 300, b"abab": 5, b"ba": 299, b"aba": 298}
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["ab" * 40 + "a", "ba" * 40, "aabb" * 30, "abb" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokenizer.encode(rows, most=0).collect():
        assert r.ids == plain.encode_ordinary(r.text)
