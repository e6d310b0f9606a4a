"""Chat windows and archives: round trips and plain versions."""

import hashlib
import os

import corpus
import pytest
from pyspark.sql import functions as F

from lendlens.llm import chat, warc

SCHEMA = "conv_id long, turn long, role string, text string, span string, tokens long"


def conversations():
    out = []
    words = "one two three four five "
    for conv, n in ((1, 40), (2, 3), (3, 1), (None, 2)):
        for t in range(n):
            role = "system" if t == 0 and conv in (1, 3) else ("user" if t % 2 else "assistant")
            out.append((conv, t, role, f"{t}: {words * (t % 40)} [/TURN]</s>%3C%25[ROLE", "x", 1))
    out += [(4, None, "user", None, "x", 1), (4, 2, None, "", "x", 1), (4, 2, "assistant", "b", "x", 1), (4, 2, "assistant", "b", "x", 1)]
    out += [(5, 0, "user", "word " * 5000, "x", 1), (5, 1, "assistant", "é\U0001F600" * 3000, "x", 1), (5, 2, "user", "", "x", 1)]
    out += [(6, k // 3, "assistant", "y " * 30, "x", 1) for k in range(900)]
    return out


def test_windows(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    made = chat.windows(table)
    windows = made.collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, turns in by_conv.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        own = sorted((w for w in windows if w.conv_id == conv), key=lambda w: w.span)
        loss = "".join(
            w.formatted[s.begin : s.end] for w in own for s in w.loss_spans
        ).replace("%5B", "[").replace("%3C", "<").replace("%25", "%")
        assert loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        for w in own:
            assert w.formatted.startswith("<s>") and w.formatted.endswith("</s>")
            assert all(s.begin >= w.context_chars for s in w.loss_spans)
            assert ("[TURN]system[/ROLE]" in w.formatted) == (turns[0][2] == "system")
    assert sum(w.conv_id == 1 for w in windows) > 1 and sum(w.conv_id == 6 for w in windows) > 10
    # a later window repeats the end of the one before
    second = sorted((w for w in windows if w.conv_id == 6), key=lambda w: w.span)[1]
    assert 0 < second.formatted[: second.context_chars].count("[TURN]") <= chat.HISTORY // 34 + 1


def test_report(spark):
    rows = conversations()
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), corpus.sha(said), len(loss), corpus.sha(loss))
    assert chat.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted(spark):
    table = chat.with_planted(spark.createDataFrame([], SCHEMA))
    (r,) = chat.report(table).collect()
    text = chat.PLANTED_TEXT
    assert (r.conv_id, r.n_turns, r.loss_sha256) == (-7, 2, corpus.sha(text))
    assert r.turns_sha256 == corpus.sha(f"user\n{text}\nassistant\n{text}\n")


PAGES = [(k, f"http://x/{k}", "<p>" + "é" * 600) for k in range(5)]
PAGES += [(5, "http://y\r\nX: 1", "small"), (6, None, "small"), (7, "u", None), (8, "u", ""), (9, "u", "z" * 200_000)]
PAGES += [(9, "u", "z" * 200_000), (None, "u", "z" * 200_000), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
PAGE_SCHEMA = "page_id long, url string, html string, digest string, part string"


def files(folder):
    out = {}
    for name in sorted(os.listdir(folder.removeprefix("file://"))):
        if name.endswith(".warc.gz"):
            with open(os.path.join(folder.removeprefix("file://"), name), "rb") as f:
                out[name] = f.read()
    return out


def test_archives(spark, tmp_path):
    table = spark.createDataFrame([(*p, "d", "p") for p in PAGES], PAGE_SCHEMA).repartition(3)
    folder = warc.write(table, str(tmp_path / "one"), roll_bytes=300)
    records = warc.read(spark, folder).collect()
    owner = {}
    for page_id, _, html in PAGES:
        if len((html or "").encode()) >= 1000:
            owner[html] = max(owner.get(html, -1), -1 if page_id is None else page_id)
    expected = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        first = owner.get(html, page_id)
        refers = str(first) if first != page_id else None
        expected.append((
            "" if page_id is None else str(page_id), len(payload), hashlib.sha1(payload).hexdigest(),
            "revisit" if refers else "response", refers, None if refers else payload,
        ))
    got = [
        (r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
        for r in records
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    written = files(folder)
    assert len(written) > 3 and not [f for f in os.listdir(tmp_path / "one") if f.startswith(".part") and not f.endswith(".crc")]
    # the same pages give the same bytes
    again = warc.write(table, str(tmp_path / "two"), roll_bytes=300)
    assert b"".join(files(again).values()) == b"".join(written.values())
    with pytest.raises(ValueError):
        warc.write(table, folder)


def test_only_listed_and_whole_files_count(spark, tmp_path):
    table = spark.createDataFrame([(*p, "d", "p") for p in PAGES], PAGE_SCHEMA)
    folder = warc.write(table, str(tmp_path / "one"))
    path = folder.removeprefix("file://")
    (name, data), *_ = files(folder).items()
    with open(f"{path}/part-999999-000000.warc.gz", "wb") as f:
        f.write(data)
    assert warc.read(spark, folder).count() == len(PAGES)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data[:-20])
    with pytest.raises(Exception, match="cut off|damaged"):
        warc.read(spark, folder).collect()


def test_empty_archive(spark):
    assert warc.report(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def test_report_of_pages(spark):
    got = warc.report(spark.createDataFrame([(*p, "d", "p") for p in PAGES], PAGE_SCHEMA)).filter(F.col("page_id") < 5)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [
        (0, "revisit", 4), (1, "revisit", 4), (2, "revisit", 4), (3, "revisit", 4), (4, "response", None)
    ]
