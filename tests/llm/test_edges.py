"""Chat formatting, decontamination, archives and sharding on odd rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import chat, decontam, ring, warc

LONG = "<turn x>\\ é" * 20_000


def test_chat_of_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", LONG), (1, None, "system", "first"), (1, 1, "assistant", LONG), (1, 2, None, "who"),
        (2, 0, "assistant", None), (2, 1, "assistant", ""), (None, 0, "assistant", "\\b\\l\\g<>"), (None, 0, "user", "</turn>\n"),
        (3, 5, "a>\nb", "x\n\n"), (3, 5, "a>\nb", "a"),
    ]
    names = "pos string, seq string, kind string, nth string, learn string, size string, start string, piece string, c string"
    df = spark.createDataFrame([(*r, *"qrstuvwxy") for r in rows], f"conv_id long, turn long, role string, text string, {names}")
    formatted = chat.rendered(chat.folded(chat.log_of(df))).cache()
    got = {r.conv_id: r for r in chat.digests(chat.read_back(formatted), formatted).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        # null turns first; equal turns by role and text
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(learnt)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(got[c].formatted_chars == len(texts[c]) for c in texts)
    assert texts[3].count("<turn ") == texts[3].count("</turn>\n") == 2


def test_items_of_odd_sizes_and_places(spark):
    item = "seven wizards boxed the quick brown fox that jumped over lazy dogs"
    texts = [(1, f"a {item} b {item.replace('boxed', 'bxed')} c"), (None, item), (None, "nothing"), (2, item.upper()), (2, item), (3, "Q"), (4, "zzz")]
    names = "item_id string, errors string, _key string, _text string, match_end string"
    d = spark.createDataFrame([(*t, *"vwxyz") for t in texts], f"doc_id long, text string, {names}")
    b = spark.createDataFrame([(9, item, "x"), (5, "q", "x"), (6, "", "x"), (None, "nothing", "x")], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id, r.errors) for r in decontam.leaks(d, b).collect())
    # an item of one letter has no error to spend and is found wherever the letter is
    want = [(1, 9, 0), (None, 9, 0), (2, 9, 0), (2, 9, 0), (None, None, 0)]
    want += [(k, 5, 0) for k, t in texts if "q" in decontam.normal(t)]
    assert got == Counter(want)
    best = next(r for r in decontam.leaks(d.where("doc_id = 1"), b.where("item_id = 9")).collect())
    assert decontam.normal(texts[0][1])[best.match_start : best.match_end] == decontam.normal(item)


def test_archive_of_long_pages_and_clashing_columns(spark):
    long = "<p>é" * 500_000
    rows = [(1, "http://a.b/1", long), (2, "http://a.b/2", long), (3, "http://a.b/3", "x" * 1500), (4, None, "y" * 1500), (4, None, "y" * 1500)]
    names = "key string, file string, size string, digest string, last string, of string"
    a = warc.Archive(spark.createDataFrame([(*r, *"uvwxyz") for r in rows], f"page_id long, url string, html string, {names}"))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, str(r.refers_to), r.payload_digest) for r in a.lookup(a.captures).collect())
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == [
        (1, 2_500_000, "revisit", "2", digest(long)), (2, 2_500_000, "response", "None", digest(long)),
        (3, 1500, "response", "None", digest("x" * 1500)), *[(4, 1500, "response", "None", digest("y" * 1500))] * 2,
    ]
    assert a.parts >= 1


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_of_equal_and_missing_texts(spark, shards):
    rows = [(i % 40 if i % 3 else None, None if i % 5 == 0 else "same" if i % 2 else f"t{i}é") for i in range(200)]
    names = "shard string, slot string, size string, text_crc32 string, _shard string"
    d = spark.createDataFrame([(*r, *"vwxyz") for r in rows], f"doc_id long, text string, {names}")
    got = ring.placed(d, shards).collect()
    n = Counter(r.shard for r in got)
    assert sum(n.values()) == 200 and set(n) <= set(range(shards)) and max(n.values()) - min(n.get(s, 0) for s in range(shards)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)
    assert Counter(r["size"] for r in got) == Counter(len((t or "").encode()) + 1 for _, t in rows)
    assert re.fullmatch(r"\d+", str(got[0].text_crc32)) and ring.placed(d.select(F.col("doc_id"), F.col("text")), shards).count() == 200
