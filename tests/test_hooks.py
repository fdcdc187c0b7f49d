"""Hooks, readers, streamed chunks."""

from __future__ import annotations

import io
import random
import time

import pytest

from lodestar.operators import chunking, entities, hooks
from lodestar.sources import files


def test_extractors(spark):
    rows = [("a/b.TXT", b"plain"), ("c.html", b"<p>one</p><script>x</script>two &amp; 3"), ("d.pdf", b"%PDF"), ("e.bin", None), ("f.odd", b"x")]
    table = spark.createDataFrame(rows, "path string, content binary")

    def broken(data):
        raise RuntimeError("no")

    got = {r["path"]: (r["text"], r["problem"]) for r in hooks.extracted(table, {"pdf": lambda data: f"{len(data)} bytes", "odd": broken}).collect()}
    assert got == {"a/b.TXT": ("plain", None), "c.html": ("one two & 3", None), "d.pdf": ("4 bytes", None), "e.bin": (None, "no content"), "f.odd": (None, "RuntimeError: no")}
    assert {r["path"]: r["problem"] for r in hooks.extracted(table).collect()}["d.pdf"] == "no reader"


def test_rerank(spark):
    found = spark.createDataFrame([(q, i, 1.0 / (i + 1), i + 1) for q in (1, 2) for i in range(5)], "query_id long, id long, score double, rank int")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, text string")
    queries = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")

    def judge(query, candidates):
        if query == "two":
            raise ValueError("no answer")
        return list(range(len(candidates)))[::-1]

    rows = hooks.reranked(found, texts, queries, judge, most=3).collect()
    order = lambda q: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert order(1) == [2, 1, 0, 3, 4] and order(2) == [0, 1, 2, 3, 4]


def test_taggers_and_entities(spark):
    rows = spark.createDataFrame([(1, "Ann met Bob"), (2, None)], "id long, text string")
    assert {r["id"]: r["tags"] for r in hooks.tagged(rows).collect()} == {1: [], 2: []}
    assert {r["id"]: r["tags"] for r in hooks.tagged(rows, lambda x: ["A", " a ", "b", ""]).collect()} == {1: ["a", "b"], 2: ["a", "b"]}
    mentions = hooks.found_entities(rows, lambda x: [(w, "PERSON") for w in x.split() if w[:1].isupper()])
    assert {tuple(r) for r in entities.linked(mentions).collect()} == {("ann", 1, 1.0), ("bob", 1, 1.0)}


def test_streamed_chunks_cover_the_text_and_hold_little():
    chooser = random.Random(1)
    text = "".join(chooser.choice(["word ", "Ends. ", "long" * 9, "\n\n", " "]) for _ in range(4000))
    for size, overlap in ((40, 0), (64, 16), (512, 64)):
        found = list(chunking.streamed(io.StringIO(text, newline="").read, size, overlap))
        covered = set()
        for start, piece, _ in found:
            assert text[start : start + len(piece)] == piece and len(piece) <= size
            covered |= set(range(start, start + len(piece)))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert chunking.by_stream("") == [] and chunking.by_stream(" \n ") == []
    with pytest.raises(ValueError):
        list(chunking.streamed(io.StringIO("x").read, 8, 8))


def test_chunkers_take_linear_time():
    text = "Some words make a sentence. " * 40_000  # 1.1 million characters
    for chunker in (chunking.by_sentence, chunking.by_token, chunking.by_markdown, chunking.by_stream):
        start = time.process_time()
        assert chunker(text)
        assert time.process_time() - start < 6


def test_http_connectors(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    feed.write_text("<rss><channel><item><title>A</title><link>http://x/1</link><description>d</description></item><item><title>B</title></item></channel></rss>")
    page, items = tmp_path / "page.html", tmp_path / "items.json"
    page.write_text("<html><script>x</script><p>Hello</p></html>")
    items.write_text('{"data": [{"id": 1}, {"id": 2}]}')
    allowed = {"schemes": ("file",)}
    assert [(r["title"], r["link"]) for r in files.connected(spark, "rss", url=feed.as_uri(), **allowed).collect()] == [("A", "http://x/1"), ("B", None)]
    assert files.connected(spark, "web-scraper", url=page.as_uri(), **allowed).first()["text"] == "Hello"
    assert {r["item"] for r in files.connected(spark, "rest-api-poll", url=items.as_uri(), items="$.data", **allowed).collect()} == {'{"id":1}', '{"id":2}'}
    assert files.connected(spark, "rss", url=(tmp_path / "none").as_uri(), **allowed).collect() == []
    with pytest.raises(ValueError):
        files.connected(spark, "web-scraper", url=page.as_uri())
    (tmp_path / "hooks").mkdir()
    (tmp_path / "hooks" / "a.json").write_text('{"id":"1","text":"t"}\n')
    assert files.connected(spark, "webhook", path=str(tmp_path / "hooks")).first()["text"] == "t"
