import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arborank.llm import packing, warc

from . import brute
from .rows import documents, documents_df, ordered, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 700
PAGES = [(1, LONG), (2, LONG), (3, "small"), (4, "small"), (5, None), (6, ""), (7, LONG + "x"), (8, "y" * 1000), (9, "y" * 1000), (10, "z" * 999), (11, "z" * 999), (9, "y" * 1000), (None, LONG), (None, "q" * 2000), (12, prose(60000, 1))]


def pages_df(spark, rows):
    return spark.createDataFrame([(p, None if p == 3 else f"http://h/{p}\r\nX: y", h, "d", 5) for p, h in rows], "page_id long, url string, html string, digest string, page long")


def test_warc_round_trip(spark):
    rows = warc.round_trip(pages_df(spark, PAGES)).collect()
    assert ordered(tuple(r) for r in rows) == ordered(brute.warc(PAGES))
    assert warc.round_trip(pages_df(spark, [])).collect() == []


def test_payloads_stay_where_they_are_read(spark, monkeypatch):
    """With few revisits no payload is moved; with many the result is the same."""
    plan = warc.with_revisits(pages_df(spark, PAGES), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(warc, "SENT_REVISITS", 0)
    rows = warc.round_trip(pages_df(spark, PAGES)).collect()
    assert ordered(tuple(r) for r in rows) == ordered(brute.warc(PAGES))


def test_files_are_bounded_by_their_bytes(spark, tmp_path):
    assert warc.records_for(pages_df(spark, [])) == 2000
    assert warc.records_for(pages_df(spark, [(1, "x" * 100)])) == 2000
    assert warc.records_for(pages_df(spark, [(1, "x" * 100_000)] * 3)) == (64 << 20) // 100_000
    assert warc.records_for(pages_df(spark, [(1, "x" * 20_000_000), (2, "y")])) == 6


def test_a_payload_behind_many_pages(spark, monkeypatch):
    """Its rows are dealt over several tasks; the result is the same."""
    from arborank.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    pages = [(k, LONG if k % 3 else LONG + str(k % 50)) for k in range(120)] + [(None, LONG)]
    rows = warc.round_trip(pages_df(spark, pages)).collect()
    assert ordered(tuple(r) for r in rows) == ordered(brute.warc(pages))


def test_warc_records_are_whole(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(warc.with_revisits(pages_df(spark, PAGES), 1000), path)
    found = [x for f in (tmp_path / "archive").glob("*.gz") for x in warc.parsed(f.read_bytes())]
    assert len(found) == len(PAGES)
    ids = {f["warc-record-id"] for f, _ in found}
    for fields, block in found:
        assert int(fields["content-length"]) == len(block)
        assert block.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["warc-type"] == "revisit":
            assert fields["warc-refers-to"] in ids and block.endswith(b"\r\n\r\n")


def test_a_damaged_archive_is_noticed():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parsed(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))


@pytest.mark.parametrize("size", [4096, 64, 7])
def test_packing(spark, size):
    rows = documents() + [(50, "a <|endoftext|> b<|EndOfText|>c don't ,. x., 3.5.")]
    found = packing.pack(documents_df(spark, rows), PATH, size).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert ordered(tuple(r)[:5] for r in found) == ordered(brute.pieces(rows, tokenizer, size))
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    total = sum(r.length for r in found)
    assert len(by) <= 1.05 * total / size + 2
    assert packing.pack(documents_df(spark, []), PATH, size).collect() == []


def strange_texts():
    """Random strings of letters with and without marks, capitals, digits, signs, spaces of all kinds and special tokens."""
    r = random.Random(11)
    signs = [chr(k) for k in (*range(0x20, 0x250), *range(0x300, 0x370), *range(0x370, 0x600), *range(0x1E00, 0x2070), *range(0xFB00, 0xFB10), *range(0x1F600, 0x1F610))]
    common = list("aabcdeeestWJTHYıİſßÅéσΣ'.,-_09 \t\u0308\u030a\u030c\u0331") + ["'s", "'LL", "<|endoftext|>", "<|", "\u00a0", "\x1c", "\x85"]
    for _ in range(400):
        yield "".join(r.choice(signs if r.random() < 0.2 else common) for _ in range(r.randrange(1, 40)))


def test_words_have_the_ids_of_the_whole_text():
    import pyarrow as pa

    tokenizer, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = ["", "W\u030a J\u030c T\u0308 H\u0331 Y\u030a", "It's 3.14, naïve ÀB e\u0301. x\u00a0y <|startoftext|>a <|STARTOFTEXT|> \u2028 ΑΣ Σ. ..., a.b,", prose(300, 3), "\t\x1c a\x85b \ufeff,"]
    texts += ["straße éàü ñandú ǆ ŉ ﬁ 漢字 हिन्दी ªº ǅ İi ı ſ ᾳ ა ⅷ ͅ a\u0301b", "".join(chr(k) + " " for k in range(0x21, 0x600)), *strange_texts()]
    for kind in (pa.string(), pa.large_string()):
        for text, got in zip(texts, packing.ids_of_texts(pa.array(texts, kind), ids), strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_fullest_combination():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        room = r.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == max(sums)
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_uses_every_piece():
    r = random.Random(3)
    counts = {r.randrange(1, 100): r.randrange(1, 2000) for _ in range(60)}
    plan = packing.plan_of(counts, 100)
    used = {}
    for times, made in plan:
        assert sum(k * n for k, n in made.items()) <= 100
        for k, n in made.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    assert len(plan) <= 2 * len(counts)
