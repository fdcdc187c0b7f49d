"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks with offsets. Two
neighbouring encodings are spliced at a boundary that is proven stable: a place
between a character that isn't white space and white space after it. The
pre-tokenizer's pattern takes white space only at the start of a piece or in runs
of nothing else, so a piece ends there whatever surrounds it; merges stay within
pieces; what it looks ahead to is white space behind the piece; and the strings of
added tokens hold no white space. Left of the place the left chunk's tokens are
those of the whole text, right of it the right chunk's. If the overlap has no such
place where both encodings have a boundary, the overlap is widened (twice as long
each time) up to the whole rest of the text, which needs no splice.

A text of a chunk or less needs no splice. It is cut at all its stable places: the
segments between them recur, so a worker encodes each once (by the library, too) and
adds up their counts. Both ways count what the library does; the second is for speed
only, as overlaps and offsets would cost a short text more than its own encoding. Texts
with other white space than the pattern's go to the library whole, and so do all texts
if the file isn't of the shape that these proofs are about.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table, text_of
from lodestar.llm.tokenizers_io import BYTE_BPE, library, path_of, shape

#: Characters of a chunk, and of the first overlap.
CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024
#: White space as the pre-tokenizer's pattern has it.
STABLE = regex.compile(r"[^\s\x1c-\x1f](?=[ \t\n\r\x0b\x0c])")


#: White space and what follows it up to the next: what lies between stable places.
SEGMENT = regex.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space that a segment may end with, so that its end would not be stable.
ODD = regex.compile(r"[^\S \t\n\r\x0b\x0c]|[\x1c-\x1f]")
CACHE_SEGMENTS = 300_000
CACHED_CHARS = 48


class Segments:
    """Token counts of short texts from those of their segments."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if ODD.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        segments = SEGMENT.findall(text)
        got = list(map(self.known.get, segments))
        if None in got:
            new = list({x for x, n in zip(segments, got, strict=True) if n is None})
            found = {x: len(e) for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
            got = [found[x] if n is None else n for x, n in zip(segments, got, strict=True)]
            if len(self.known) > CACHE_SEGMENTS:
                self.known.clear()
            self.known.update((x, n) for x, n in found.items() if len(x) <= CACHED_CHARS)
        return sum(got)


@functools.lru_cache(maxsize=2)
def segments_of(path: str) -> Segments:
    return Segments(library(path))


def stable_places(text: str, start: int, stop: int) -> list[int]:
    """Places in [start, stop) between other characters and white space, last first."""
    return [m.end() for m in STABLE.finditer(text, max(0, start - 1), stop + 1)][::-1]


class Spliced:
    """Ids of a long text from its chunks' encodings."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("an overlap is shorter than its chunk")
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and each token's first character."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, [a for a, _ in found.offsets]

    def spans(self, n_chars: int) -> list[tuple[int, int]]:
        step = self.chunk - self.overlap
        return [(a, min(a + self.chunk, n_chars)) for a in range(0, max(1, n_chars - self.overlap), step)]

    def ids(self, text: str) -> list[int]:
        spans = self.spans(len(text))
        if len(spans) == 1:
            return self.encoded(text)[0]
        result: list[int] = []
        begin, end = spans[0]
        ids, starts = self.encoded(text[begin:end])
        done = last = 0  # tokens of this chunk that the one before has given, up to this place
        k = 1
        while k < len(spans):
            right_begin, right_end = spans[k]
            right_ids, right_starts = self.encoded(text[right_begin:right_end])
            width = self.overlap
            while True:
                place = self.common(text, max(right_begin, last), end, begin, starts, right_begin, right_starts, ids, right_ids)
                if place is not None:
                    break
                if end == len(text):
                    break  # the left chunk has been widened to the text's end
                # Widen: the left chunk reaches further into (and past) the right one.
                width *= 2
                end = min(len(text), end + width)
                ids, starts = self.encoded(text[begin:end])
                while k + 1 < len(spans) and spans[k + 1][0] < end - self.overlap:
                    k += 1
                right_begin, right_end = spans[k]
                right_end = max(right_end, min(len(text), end + self.overlap))
                right_ids, right_starts = self.encoded(text[right_begin:right_end])
            if place is None:
                result += ids[done:]
                return result
            result += ids[done : self.before(starts, place - begin)]
            done, last = self.before(right_starts, place - right_begin), place
            begin, end, ids, starts = right_begin, right_end, right_ids, right_starts
            k += 1
        return result + ids[done:]

    @staticmethod
    def before(starts: list[int], place: int) -> int:
        """Tokens that start before a stable place: what is left of it isn't white
        space, so that no trimmed offset of a token on its left reaches it."""
        return bisect_left(starts, place)

    def common(self, text, low, high, begin, starts, right_begin, right_starts, ids, right_ids) -> int | None:
        """The last stable place of the overlap where both encodings have a boundary
        and agree on the tokens of the piece before it."""
        for place in stable_places(text, low + 1, high):
            i, j = self.before(starts, place - begin), self.before(right_starts, place - right_begin)
            if i and j and ids[i - 1] == right_ids[j - 1] and i < len(ids) and j < len(right_ids) and ids[i] == right_ids[j]:
                return place
        return None


def counts(docs: DataFrame, path: str = BYTE_BPE, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: bytes, tokens, whether the tokens exceed the limit.

    A null text counts as empty: 0 bytes, 0 tokens; a null id stays null; repeated
    rows give repeated results; columns beyond the two named are not read.
    """
    place = path_of(path)
    known = shape(place) == "byte"

    @F.pandas_udf("n_tokens long")
    def counted(column: pd.Series) -> pd.DataFrame:
        tokenizer = library(place)
        if not known:
            return pd.DataFrame({"n_tokens": [len(e) for e in tokenizer.encode_batch_fast(column.tolist(), add_special_tokens=False)]})
        spliced = Spliced(tokenizer, chunk, overlap)
        segments = segments_of(place)
        return pd.DataFrame({"n_tokens": [segments.count(x) if len(x) <= chunk else len(spliced.ids(x)) for x in column]})

    text = text_of(docs, text_column)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("found"))
    return rows.select("doc_id", "n_bytes", "found.n_tokens", (F.col("found.n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return counts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
