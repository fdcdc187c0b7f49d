"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line with a word) is hashed to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two. Sums don't
depend on the order, so two documents have equal fingerprints if they have the same
paragraphs, as often each; a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text.

The vector has two parts. EXACT lanes of 64 bits are uniformly random for each
paragraph (512 bits of a cryptographic hash): they tell different multisets apart,
however often a paragraph recurs. SKETCH lanes of 32 bits, read as signed, hold any
sum of fewer than 2^31 shingles. They are sparse: each five-word shingle of the paragraph adds +1 or -1 to one lane, both
chosen by its hash. The difference of two sums is the sketch of what the documents
don't share, its squared length estimates how much that is, and so the likeness of
two documents follows from their fingerprints alone::

    likeness = 1 - |A - B|^2 / (|A|^2 + |B|^2), at least 0; 1 for equal fingerprints,
    0 for different ones whose sketches are both zero

Paragraphs are taken as their words joined by one blank: other white space and
empty lines don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table, text_of
from lodestar.llm.shingles import WORDS, shingle_hashes, word_hashes, words

EXACT, SKETCH = 8, 160
LANES = EXACT + SKETCH
#: Documents of a range of ids, as long as there are no more than RANGES ranges or so.
ROWS_EACH = 512
RANGES = 65_536


def paragraphs(text: str) -> list[list[str]]:
    """The words of each line with a word."""
    return [found for line in text.split("\n") if (found := words(line))]


def fingerprint(text: str) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs: LANES numbers, the sketch's modulo 2^32."""
    found = paragraphs(text)
    total = np.zeros(LANES, dtype=np.uint64)
    if not found:
        return total
    digests = b"".join([hashlib.blake2b(" ".join(p).encode(), digest_size=8 * EXACT).digest() for p in found])
    total[:EXACT] = np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    # All words at once; then windows that would span two paragraphs are left out.
    hashes = word_hashes([w for p in found for w in p])
    sizes = np.array([len(p) for p in found])
    ends = np.cumsum(sizes)
    grams = []
    if len(hashes) >= WORDS:
        windows = shingle_hashes(hashes)
        start = np.arange(len(windows))
        grams.append(windows[start + WORDS <= ends[np.searchsorted(ends, start, side="right")]])
    grams += [shingle_hashes(hashes[e - n : e]) for e, n in zip(ends[sizes < WORDS], sizes[sizes < WORDS], strict=True)]
    gram = np.concatenate(grams)
    lane = ((gram >> np.uint64(32)) % np.uint64(SKETCH)).astype(np.int64)
    plus = np.bincount(lane, minlength=SKETCH)
    minus = np.bincount(lane[(gram & np.uint64(1)).astype(bool)], minlength=SKETCH)
    total[EXACT:] = (plus - 2 * minus).astype(np.uint64)
    return wrapped(total)


def wrapped(total: np.ndarray) -> np.ndarray:
    """The lanes of a sum within their moduli."""
    total[EXACT:] &= np.uint64(0xFFFFFFFF)
    return total


def insert(total: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint with one more paragraph."""
    return wrapped(total + fingerprint(paragraph.replace("\n", " ")))


def delete(total: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint with one paragraph less."""
    return wrapped(total - fingerprint(paragraph.replace("\n", " ")))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much two documents share, from their fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    length = float(x @ x + y @ y)
    if length == 0:
        return 0.0
    return min(1.0, max(0.0, 1 - float((x - y) @ (x - y)) / length))


def to_text(total: np.ndarray) -> str:
    return (total[:EXACT].astype("<u8").tobytes() + total[EXACT:].astype("<u4").tobytes()).hex()


def of_text(text: str) -> np.ndarray:
    data = bytes.fromhex(text)
    return np.concatenate([np.frombuffer(data, "<u8", EXACT), np.frombuffer(data, "<u4", SKETCH, 8 * EXACT).astype(np.uint64)])


def placed(docs: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """The documents dealt in ranges of the id, each with its successor's copy.

    Columns: range, tail, doc_id, text. Cuts of the id make ranges of about ``rows_each``
    rows (more where that would be over RANGES ranges; a range is sorted and streamed, never
    held); an id of many rows is cut by the hash of the text. The first row of a range also goes,
    marked as tail, to the range before, that of the first range to the last. Then
    one shuffle moves each text once, and a task that holds a range has every
    document's successor.
    """
    text = text_of(docs)
    # A null id sorts before all others: it is in the first ranges.
    least = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), least.alias("least"), F.xxhash64(text).alias("h"))
    keys = slim.select("least", "h")
    n_rows = keys.count()
    each = max(rows_each, -(-n_rows // RANGES))
    parts = max(1, -(-n_rows // each))
    cuts = {(int(c), -(1 << 63)) for c in keys.approxQuantile("least", [i / parts for i in range(1, parts)], 0.1 / parts)} if parts > 1 else set()
    # An id of many rows (null, say) is cut by the hash of the text: few ids, of many rows each.
    for row in keys.groupBy("least").agg(F.count("*").alias("n")).where(F.col("n") > 4 * each).collect():
        pieces = -(-row["n"] // each)
        cuts |= {(row["least"], -(1 << 63) + (k << 64) // pieces) for k in range(1, pieces)}

    def dealer(bounds: list[tuple[int, int]]):
        """The number of bounds up to a row's (id, hash)."""
        ids, hashes = (np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1))

        @F.pandas_udf("int")
        def dealt(own: pd.Series, h: pd.Series) -> pd.Series:
            x, y = own.to_numpy(), h.to_numpy()
            low, high = np.searchsorted(ids, x, side="left"), np.searchsorted(ids, x, side="right")
            result = high.copy()
            for i in np.flatnonzero(high > low).tolist():
                result[i] = low[i] + np.searchsorted(hashes[low[i] : high[i]], y[i], side="right")
            return pd.Series(result.astype(np.int32))

        return dealt

    found = keys.withColumn("range", dealer(sorted(cuts))("least", "h")).groupBy("range").agg(F.min(F.struct("least", "h")).alias("head"))
    # Ranges without a row are left out: a head begins each range.
    heads = sorted((r["head"]["least"], r["head"]["h"]) for r in found.select("head").collect())
    n = max(1, len(heads))
    rows = slim.withColumn("range", dealer(heads[1:])("least", "h"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("tail"))
    marks = docs.sparkSession.createDataFrame([(*head, True) for head in heads], "least long, h long, is_head boolean")
    rows = rows.join(F.broadcast(marks), ["least", "h"], "left")  # about RANGES rows at most
    first = F.col("is_head")
    places = F.when(F.coalesce(first, F.lit(False)), F.array(own, before)).otherwise(F.array(own))
    rows = rows.withColumn("place", F.explode(places)).select("place.range", "place.tail", "doc_id", "text")
    return rows.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def fingerprints(docs: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the next document's, by ascending id (null ids first, equal ids by a hash
    of the text; after the last comes the first; a document alone is its own next).
    A null text counts as empty. Repeated rows follow each other. An empty table
    stays empty. Other columns are not read.
    """

    def row(key, text: str, mark: np.ndarray, after: str, after_mark: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_mark = fingerprint(edited)
        return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(mark), to_text(edited_mark), likeness(mark, edited_mark), likeness(mark, after_mark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # range, id, text, fingerprint
        for frame in frames:
            rows = []
            for at, tail, key, null, text in zip(frame["range"], frame["tail"], frame["doc_id"], frame["absent"], frame["text"], strict=True):
                if tail and (held is None or held[0] != at):
                    continue  # the range has its successor already
                mark = fingerprint(text)
                if held is not None and held[0] == at:
                    rows.append(row(held[1], held[2], held[3], text, mark))
                held = None if tail else (at, None if null else key, text, mark)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = placed(docs, rows_each).select("range", "tail", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_multiset_hash": op7_multiset_hash}
ORACLES: dict[str, str] = {}
