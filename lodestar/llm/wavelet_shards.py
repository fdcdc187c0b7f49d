"""Token ids as wavelet matrices, one succinct compressed file for each shard.

A wavelet matrix keeps a sequence as one bit-plane for each bit of an id, highest
first; each plane stably sorts the sequence by its bit for the next. With the
number of set bits before each block (the directory), a plane answers rank and
select, and the planes together give access to any token, the count of an id in
any range, and the places of its occurrences, without another index.

Each shard is a file of its own in the shared folder, written where its rows are. Its
name goes to a table that Spark's committer writes, so that what a lost executor or a
second attempt has left is never read. A file holds, little-endian throughout::

    b"LWM1" | bits u8 | documents u64 | tokens u64
    | doc ids i64 * documents | present u8 * documents | lengths u64 * documents
    | for each plane: zeros u64, blocks u32, then for each block:
      set bits before it u64, its bytes as stored u32 (the top bit: not compressed)
    | the blocks of all planes, in order

A block holds BLOCK_BYTES bytes of a plane, compressed by itself (zstandard), so that a
lookup in a file reads and opens only the blocks that it touches; counts of each
STRIDE bytes are made when a block is opened. Shards follow ascending document ids.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import shared_path, small, table, text_of
from lodestar.llm.tokenizers_io import WORD_BPE, byte_alphabet, library, path_of, shape

MAGIC = b"LWM1"
BLOCK_BYTES = 1 << 15
RAW = 1 << 31
#: Bytes of a block between two counts of its set bits.
STRIDE = 256
#: A shard is closed when it has so many tokens: packing then stays in a core's cache.
SHARD_TOKENS = 1_000_000
END_ID = 2
#: Shards that a task reads back, about.
FILES = 6
CACHE_WORDS = 700_000
CACHED_CHARS = 48

_HEAD = struct.Struct("<4sBQQ")
_PLANE = struct.Struct("<QI")


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """The file of one shard."""
    packer = zstandard.ZstdCompressor(level=1)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    heads = [
        _HEAD.pack(MAGIC, bits, len(doc_ids), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        present.tobytes(),
        np.array(lengths, dtype="<u8").tobytes(),
    ]
    bodies: list[bytes] = []
    values = ids
    for level in range(bits - 1, -1, -1):
        mask = (values & values.dtype.type(1 << level)) != 0
        # Places and take() are faster than a mask as an index.
        low, high = values.take(np.flatnonzero(~mask)), values.take(np.flatnonzero(mask))
        plane = np.packbits(mask, bitorder="little")
        blocks = [plane[i : i + BLOCK_BYTES] for i in range(0, len(plane), BLOCK_BYTES)]
        heads.append(_PLANE.pack(len(low), len(blocks)))
        before = 0
        directory = []
        for block in blocks:
            raw = block.tobytes()
            body = packer.compress(raw)
            stored = len(body)
            if stored >= len(raw):
                body, stored = raw, len(raw) | RAW
            directory.append(struct.pack("<QI", before, stored))
            bodies.append(body)
            before += int(np.bitwise_count(block).sum(dtype=np.int64))
        heads += directory
        values = np.concatenate([low, high])
    return b"".join(heads + bodies)


class WaveletMatrix:
    """A shard read back: access, rank, select, count, occurrences, whole decoding.

    Of bytes, or of an open file (read_at, size): then only what is asked for is read.
    """

    def __init__(self, data: bytes | pa.NativeFile):
        if isinstance(data, pa.NativeFile):
            file, size = data, data.size()
            self._read: Callable[[int, int], bytes] = lambda at, n: file.read_at(n, at)
        else:
            size = len(data)
            self._read = lambda at, n: data[at : at + n]
        if size < _HEAD.size:
            raise ValueError("not a shard of this format")
        magic, self.bits, self.n_docs, self.n = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEAD.size
        rows = self._read(at, 17 * self.n_docs)
        ids = np.frombuffer(rows, "<i8", self.n_docs)
        present = np.frombuffer(rows, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.lengths = np.frombuffer(rows, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        at += 17 * self.n_docs
        # For each plane: unset bits, set bits before each block, the blocks' places and sizes.
        self.planes: list[tuple[int, np.ndarray, list[tuple[int, int]]]] = []
        sizes: list[np.ndarray] = []
        for _ in range(self.bits):
            zeros, blocks = _PLANE.unpack(self._read(at, _PLANE.size))
            at += _PLANE.size
            directory = np.frombuffer(self._read(at, 12 * blocks), dtype=np.dtype([("before", "<u8"), ("size", "<u4")]))
            at += 12 * blocks
            self.planes.append((zeros, directory["before"].astype(np.int64), []))
            sizes.append(directory["size"])
        for plane, own in zip(self.planes, sizes, strict=True):
            for stored in own.tolist():
                plane[2].append((at, stored))
                at += stored & ~RAW
        self._block = functools.lru_cache(maxsize=64)(self._counted)

    def _open(self, level: int, k: int) -> np.ndarray:
        at, size = self.planes[level][2][k]
        body = self._read(at, size & ~RAW)
        if not size & RAW:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=BLOCK_BYTES)
        return np.frombuffer(body, dtype=np.uint8)

    def _counted(self, level: int, k: int) -> tuple[np.ndarray, list[int]]:
        """A block, and the set bits before each of its strides."""
        block = self._open(level, k)
        ones = np.add.reduceat(np.bitwise_count(block).astype(np.int64), np.arange(0, len(block), STRIDE))
        return block, [0, *np.cumsum(ones).tolist()]

    def _bit(self, level: int, i: int) -> int:
        block, _ = self._block(level, i // (8 * BLOCK_BYTES))
        i %= 8 * BLOCK_BYTES
        return int(block[i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place i."""
        zeros, before, _ = self.planes[level]
        if i >= self.n:
            return self.n - zeros
        block, strides = self._block(level, i // (8 * BLOCK_BYTES))
        found = int(before[i // (8 * BLOCK_BYTES)])
        i %= 8 * BLOCK_BYTES
        stride = (i >> 3) // STRIDE
        found += strides[stride] + int(np.bitwise_count(block[stride * STRIDE : i >> 3]).sum(dtype=np.int64))
        return found + (int(block[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()

    def _places(self, level: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) set or unset bits of a plane, for ascending ks.

        The directory tells each k's block; a block is opened once for all its ks.
        """
        _, before, blocks = self.planes[level]
        counts = before if bit else np.arange(len(blocks), dtype=np.int64) * (8 * BLOCK_BYTES) - before
        own = np.searchsorted(counts, ks, side="right") - 1
        result = np.empty(len(ks), dtype=np.int64)
        for k in np.unique(own).tolist():
            here = own == k
            start = k * 8 * BLOCK_BYTES
            bits = np.unpackbits(self._block(level, k)[0], bitorder="little", count=min(8 * BLOCK_BYTES, self.n - start))
            result[here] = start + np.flatnonzero(bits == bit)[ks[here] - counts[k]]
        return result

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (zeros, _, _) in enumerate(self.planes):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id before place i."""
        start, end = self._range(symbol, i)
        return end - start

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        if symbol >> self.bits:
            return 0, 0
        start, end = 0, min(end, self.n)
        for level, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (zeros + a, zeros + b) if symbol >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, symbol: int) -> int:
        """Occurrences of an id in the shard."""
        return self.rank(symbol, self.n)

    def _climbed(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """From places below the last plane up to places in the sequence."""
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            places = self._places(level, bit, places - self.planes[level][0] if bit else places)
        return places

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        start, end = self._range(symbol, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        return int(self._climbed(symbol, np.array([start + k]))[0])

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of an id, ascending: one walk down for their range, one up for all."""
        start, end = self._range(symbol, self.n)
        return self._climbed(symbol, np.arange(start, end))

    def decode(self) -> np.ndarray:
        """All tokens: the planes' sorts undone, the last first."""
        values = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            zeros, _, blocks = self.planes[level]
            packed = np.concatenate([self._open(level, k) for k in range(len(blocks))]) if blocks else np.zeros(0, np.uint8)
            mask = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(values)
            before[np.flatnonzero(~mask)] = values[:zeros]
            before[np.flatnonzero(mask)] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = before
        return values


_ODD = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[^ \t\n\r\x0b\x0c]+")


#: Words of ASCII and Latin letters that no composition and no context-dependent
#: lower case concerns; others, and such with an added token's start, go to the library whole.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+")
_PLAIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\w]|_)+")


class Words(dict):
    """Word -> its ids, learnt when first met; emptied when large."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        value = self.learn(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


def files(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(place) if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", place) else (fs.LocalFileSystem(), place)


def open_shard(place: str) -> WaveletMatrix:
    """One shard by its file; lookups read only the blocks that they touch."""
    system, path = files(place)
    return WaveletMatrix(system.open_input_file(path))


class WordEncoder:
    """Ids of texts by the library, word by word with a cache.

    The short cut holds for files of the shape "word" (see tokenizers_io): with any
    other the library gets whole texts. This tokenizer's file drops white space, composes characters (never over white
    space) and splits pieces within words, so a text's ids are its words' ids. A new
    word is mostly a known one with other punctuation or capitals, so its pieces are
    looked up as words.
    """

    def __init__(self, path: str):
        self.library = library(path)
        # Texts of plain words in lower case have a cache of their own: no word of theirs is looked at again.
        self.plain, self.odd = Words(self.learn_plain), Words(self.learn)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.kind = "<u2" if self.bits <= 16 else "<u4"
        self.typecode = "H" if self.kind == "<u2" else "I"
        self.model = self.library.model
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.by_words = shape(path) == "word"

    def words(self, text: str) -> tuple[list[str], bool]:
        """The words, and whether all are plain and in lower case already."""
        if (text.isascii() or _PLAIN_TEXT.fullmatch(text)) and "<|" not in text and not _ODD.search(text):
            return text.lower().split(), True  # in lower case as by the library: fewer words to know
        # U+001C to U+001F separate words for str.split() but not for the library.
        return _WORDS.findall(text) if _ODD.search(text) else text.split(), False

    def learn_plain(self, word: str) -> bytes:
        """A plain word in lower case: a piece, or pieces that are words themselves."""
        if not word.isalpha():
            found = [word[:-1], word[-1]] if word[:-1].isalpha() else _PIECES.findall(word)
            if len(found) > 1:
                return b"".join([self.plain[p] for p in found])
        spelt = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
        return array(self.typecode, [x.id for x in self.model.tokenize(spelt)]).tobytes()

    def learn(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return self.plain[word.lower()]
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        result = []
        for text in texts:
            row, plain = self.words(text)
            result.append(b"".join(map((self.plain if plain else self.odd).__getitem__, row)))
        return result


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, out: str, path: str = WORD_BPE, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write them as shards, in ascending order of the id: a file
    each in ``out``/files, and their table in ``out``/shards. A very long text is in one
    shard, whole.

    A null text counts as empty and still gets the end id; null ids come first;
    rows with one id stay together, ordered by a hash of their text; an empty table
    gives an empty folder of shards; other columns are not read.
    """
    place, folder = path_of(path), f"{out}/files"
    system, local = files(folder)
    system.create_dir(local, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = word_encoder(place)
        end = np.array([end_id], dtype=own.kind).tobytes()
        width = len(end)
        part = TaskContext.get().partitionId()
        pieces: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        seq = held = 0

        def shard() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(pieces), dtype=own.kind)
            # A name of its own for each attempt: the table lists the committed one.
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.lwm"
            system, path = files(name)
            with system.open_output_stream(path) as file:
                file.write(pack(ids, doc_ids, lengths, own.bits))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)], "file": [name]})

        for frame in frames:
            texts, keys, null = frame["text"].tolist(), frame["doc_id"].tolist(), frame["absent"].tolist()
            for k in range(0, len(texts), 256):
                for i, body in enumerate(own.encode(texts[k : k + 256]), k):
                    pieces += (body, end)
                    doc_ids.append(None if null[i] else int(keys[i]))
                    lengths.append(len(body) // width + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield shard()
                        pieces, doc_ids, lengths, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # A null id would turn the batch's column into floating point: it goes as a flag.
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    ordered.mapInPandas(run, SHARD_SCHEMA).write.parquet(f"{out}/shards")


SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, file string"


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """One row a document from the shards: doc_id, start, n_tokens, ids_crc32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, seq, name in zip(frame["part"], frame["seq"], frame["file"], strict=True):
                system, path = files(name)
                with system.open_input_file(path) as file:
                    matrix = WaveletMatrix(file.read())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(matrix.doc_ids, dtype="Int64"), "part": part, "seq": seq, "place": starts, "n_tokens": matrix.lengths, "ids_crc32": crcs})

    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{out}/shards")
    # Prefix sums in two levels, so that no task sees the shards of all parts.
    sizes = shards.select("part", "seq", "n_tokens")
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("seq_start")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    n = sizes.count()
    # Names are short: dealt anew, so that a task reads a few files.
    rows = shards.select("part", "seq", "file").repartition(max(1, -(-n // FILES)), "part", "seq").mapInPandas(run, "doc_id long, part int, seq int, place long, n_tokens long, ids_crc32 long")
    joined = rows.join(small(starts, n, 32), ["part", "seq"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every whole text of ``documents`` as shards and read them back."""
    out = shared_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), out)
    return read_documents(spark, out)


QUERIES = {"op5_wavelet_shards": op5_wavelet_shards}
ORACLES: dict[str, str] = {}
