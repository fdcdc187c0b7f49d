"""Chunkers: sentences, tokens, Markdown blocks; word offsets.

Chunking runs along one text, so it is plain Python on Arrow batches of whole rows; it
never moves a text between tasks.
"""

from __future__ import annotations

import io
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Chunk = tuple[int, str, str]  # start, text, heading

_SENTENCE = re.compile(r"[.!?][\"')\]]*(?:\s+|\Z)|\n\s*\n")
_WORD = re.compile(r"\S+")


def sentence_ends(text: str) -> list[int]:
    """Places behind each sentence, the text's end last."""
    found = [m.end() for m in _SENTENCE.finditer(text)]
    return found if found and found[-1] == len(text) else [*found, len(text)]


def by_sentence(text: str, size: int = 512, overlap: int = 64) -> list[Chunk]:
    """Chunks of up to ``size`` characters that end with a sentence if one ends there;
    the next begins about ``overlap`` before, at a sentence if one begins there."""
    if not text.strip():
        return []
    ends = sentence_ends(text)
    found, start = [], 0
    while start < len(text):
        limit = start + size
        if limit >= len(text):
            stop = len(text)
        else:
            k = bisect_right(ends, limit)
            blank = text.rfind(" ", start + 1, limit)
            stop = ends[k - 1] if k and ends[k - 1] > start else blank + 1 if blank > start else limit
        if piece := text[start:stop].strip():
            found.append((start, piece, ""))
        if stop >= len(text):
            break
        k = bisect_left(ends, max(start + 1, stop - overlap))
        start = ends[k] if k < len(ends) and ends[k] < stop else stop
    return found


def by_token(text: str, size: int = 128, overlap: int = 16) -> list[Chunk]:
    """Whole sentences of up to ``size`` words; a longer sentence is cut by words."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if not words:
        return []
    ends = sentence_ends(text)
    bounds, k = [], 0
    for i, (_, stop) in enumerate(words):
        while k < len(ends) and ends[k] < stop:
            k += 1
        if i + 1 == len(words) or (k < len(ends) and ends[k] <= words[i + 1][0]):
            bounds.append(i + 1)
    found, start = [], 0
    while start < len(words):
        k = bisect_right(bounds, start + size)
        stop = bounds[k - 1] if k and bounds[k - 1] > start else min(len(words), start + size)
        found.append((words[start][0], text[words[start][0] : words[stop - 1][1]], ""))
        if stop >= len(words):
            break
        start = max(start + 1, stop - overlap)
    return found


def streamed(read: Callable[[int], str], size: int = 512, overlap: int = 64) -> Iterator[Chunk]:
    """Chunks of a text that is read piece by piece (``read`` gives up to n characters, none
    at the end): a chunk ends with a sentence in its second half if one ends there, else
    with a word; the next begins ``overlap`` before. No more than two chunks are held."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("an overlap is shorter than its chunk")
    window, offset, more = "", 0, True
    while True:
        while more and len(window) <= size:
            piece = read(size)
            more, window = bool(piece), window + piece
        if not window:
            return
        stop = len(window)
        if stop > size:
            sentence = [m.end() for m in _SENTENCE.finditer(window, size // 2, size + 1) if m.end() <= size]
            blank = window.rfind(" ", size // 2, size)
            stop = sentence[-1] if sentence else blank + 1 if blank >= 0 else size
        if piece := window[:stop].strip():
            yield offset + len(window) - len(window.lstrip()) if window[:stop] else offset, piece, ""
        if stop >= len(window) and not more:
            return
        step = max(1, stop - overlap)
        window, offset = window[step:], offset + step


def by_stream(text: str, size: int = 512, overlap: int = 64) -> list[Chunk]:
    """The streamed chunks of a text that is there."""
    return list(streamed(io.StringIO(text, newline="").read, size, overlap))


_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")


def blocks(text: str) -> list[tuple[int, str, str, str]]:
    """(start, kind, text, heading): fenced code, headings, rules, tables, quotes, lists, paragraphs."""
    found: list[tuple[int, str, str, str]] = []
    stack: list[tuple[int, str]] = []
    kind, begin, lines, at, fence = "", 0, [], 0, ""

    def close() -> None:
        nonlocal lines, kind
        if lines:
            found.append((begin, kind, "\n".join(lines), " > ".join(h for _, h in stack)))
        lines, kind = [], ""

    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            lines.append(line)
            if bare.startswith(fence):
                close()
                fence = ""
        elif m := _FENCE.match(line):
            close()
            fence, kind, begin, lines = m.group(1), "code", at, [line]
        elif m := _HEADING.match(line):
            close()
            level = len(m.group(1))
            stack[:] = [(n, h) for n, h in stack if n < level] + [(level, m.group(2))]
            found.append((at, "heading", line, " > ".join(h for _, h in stack)))
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            close()
            found.append((at, "rule", line, " > ".join(h for _, h in stack)))
        elif not bare:
            close()
        else:
            own = "table" if bare.startswith("|") else "quote" if bare.startswith(">") else "list" if re.match(r"([-*+]|\d+[.)])\s", bare) else "paragraph"
            if kind == "list" and own == "paragraph" and line[:1].isspace():
                own = "list"
            if own != kind:
                close()
                kind, begin = own, at
            lines.append(line)
        at += len(line) + 1
    close()
    return found


def by_markdown(text: str, size: int = 2500, overlap: int = 200) -> list[Chunk]:
    """Whole blocks up to ``size`` characters; only an oversized block is split. A chunk
    begins with the last ``overlap`` characters of the one before, from a word on."""
    found: list[Chunk] = []
    held: list[tuple[int, str, str]] = []
    width = 0

    def close() -> None:
        nonlocal width
        if held:
            found.append((held[0][0], "\n\n".join(b for _, b, _ in held), held[0][2]))
            held.clear()
        width = 0

    for start, _, body, heading in blocks(text):
        if held and (width + len(body) > size or (heading != held[0][2] and body.lstrip().startswith("#"))):
            close()
        if len(body) <= size:
            held.append((start, body, heading))
            width += len(body) + 2
        else:
            close()
            found += [(start + s, piece, heading) for s, piece, _ in by_sentence(body, size, 0)]
    close()
    if overlap:
        tails = [""] + [t[-overlap:].partition(" ")[2] if len(t) > overlap else "" for _, t, _ in found[:-1]]
        found = [(s, f"{tail}\n\n{body}" if tail else body, h) for (s, body, h), tail in zip(found, tails, strict=True)]
    return found


CHUNKERS: dict[str, Callable[..., list[Chunk]]] = {"sentence": by_sentence, "token": by_token, "markdown": by_markdown, "stream": by_stream}


def chunked(docs: DataFrame, chunker: str | Callable[..., list[Chunk]] = "sentence", **options) -> DataFrame:
    """id, chunk, start, text, heading: the chunks of id, text, in order."""
    split = CHUNKERS[chunker] if isinstance(chunker, str) else chunker

    @F.pandas_udf("array<struct<chunk:int,start:int,text:string,heading:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk": i, "start": s, "text": t, "heading": h} for i, (s, t, h) in enumerate(split(text, **options))] for text in texts], dtype=object)

    return docs.select("id", F.explode(cut(F.coalesce("text", F.lit("")))).alias("c")).select("id", "c.*")


def parents(docs: DataFrame, parent: str = "markdown", child: str = "sentence", **options) -> DataFrame:
    """Children with their parent chunk's number and text."""
    big = chunked(docs, parent, **options).select(F.col("id"), F.col("chunk").alias("parent"), F.col("text").alias("parent_text"))
    key = big.select(F.xxhash64("id", "parent").alias("id"), F.col("id").alias("doc"), "parent", "parent_text", F.col("parent_text").alias("text"))
    small = chunked(key.select("id", "text"), child).select("id", "chunk", F.col("text").alias("child_text"))
    return small.join(key.select("id", "doc", "parent", "parent_text"), "id").select(F.col("doc").alias("id"), "parent", "chunk", "child_text", "parent_text")


def word_offsets(docs: DataFrame) -> DataFrame:
    """id, word, start, end of the words of id, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, m.group(), m.start(), m.end()) for i, text in zip(frame["id"], frame["text"], strict=True) for m in re.finditer(r"\w+(?:['’]\w+)*", text)]
            yield pd.DataFrame(rows, columns=["id", "word", "start", "end"])

    return docs.select("id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("id").isNotNull()).mapInPandas(run, "id long, word string, start long, end long")


def estimated(size: int) -> int:
    """Characters that are about so many tokens."""
    return size * 4
