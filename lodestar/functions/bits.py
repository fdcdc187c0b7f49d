"""Tag filters, flags, hyperdimensional vectors."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.lineage import checkpointed

#: Bits of a tag filter, and bits that a tag sets.
FILTER_BITS, HASHES = 64, 3
#: Multipliers of the hash and of its second step, and the hash's first value. Fixed values.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2, GOLDEN = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tag_hash(tag: str) -> int:
    """64 bits of a tag's UTF-16 units."""
    h = OFFSET
    units = tag.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2], "little")) * PRIME & _MASK
        h = (h ^ h >> 33) * MIX_1 & _MASK
        h ^= h >> 33
    h = (h ^ h >> 33) * MIX_2 & _MASK
    return h ^ h >> 33


def tag_bits(tag: str) -> int:
    """The bits that a tag sets: places an odd step apart."""
    first = tag_hash(tag)
    step = first * GOLDEN & _MASK
    step = (step ^ step >> 33) * MIX_2 & _MASK
    step = (step ^ step >> 33) | 1
    found = 0
    for i in range(HASHES):
        found |= 1 << ((first + i * step) % FILTER_BITS)
    return found


def tag_filter(tags: Column) -> Column:
    """The filter of an array of tags, as a signed long."""

    @F.pandas_udf("long")
    def encoded(column: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        result = []
        for tags_ in column:
            value = 0
            for tag in tags_ if tags_ is not None else ():
                if tag is not None:
                    value |= known.get(tag) or known.setdefault(tag, tag_bits(tag))
            result.append(value - (1 << 64) if value >> 63 else value)
        return pd.Series(result, dtype="int64")

    return encoded(tags)


def overlap(mask: Column, query: int) -> Column:
    """Share of the query's bits that are set; 1 without a query."""
    if query == 0:
        return F.lit(1.0)
    return F.bit_count(mask.bitwiseAND(F.lit(query))) / F.lit(float(query.bit_count()))


#: Bits of the header's flags. Fixed values.
TOMBSTONE, TYPE_SHIFT, CONSOLIDATED, PINNED, RESOLVED = 0x01, 1, 0x08, 0x10, 0x20


def header_flags(tombstoned: Column, memory_type: Column, consolidated: Column, pinned: Column, resolved: Column) -> Column:
    """The flags of a header as one number."""
    kind = F.lit(0)
    for i, name in enumerate(("WORKING", "EPISODIC", "SEMANTIC", "PROCEDURAL")):
        kind = F.when(memory_type == name, F.lit(i << TYPE_SHIFT)).otherwise(kind)
    value = kind
    for flag, bit in ((tombstoned, TOMBSTONE), (consolidated, CONSOLIDATED), (pinned, PINNED), (resolved, RESOLVED)):
        value = value.bitwiseOR(F.when(flag, F.lit(bit)).otherwise(F.lit(0)))
    return value.cast("int")


def quantized_weight(weight: Column) -> Column:
    """0..1 as a byte."""
    return F.floor(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")


# ---- hyperdimensional vectors --------------------------------------------------------

DIMENSIONS = 10_000


def symbol(char: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A random vector of bits for a symbol, the same everywhere."""
    return np.random.default_rng(tag_hash(char) % (1 << 32)).integers(0, 2, dimensions, dtype=np.uint8)


def bind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ b


def permute(a: np.ndarray, by: int = 1) -> np.ndarray:
    return np.roll(a, by)


def bundle(vectors: list[np.ndarray]) -> np.ndarray:
    """The majority of each bit; a tie goes to the first vector."""
    total = np.sum(vectors, axis=0, dtype=np.int64) * 2
    return np.where(total == len(vectors), vectors[0], total > len(vectors)).astype(np.uint8)


@functools.lru_cache(maxsize=4096)
def gram_vector(gram: str) -> np.ndarray:
    """The symbols of a gram, their places bound by rotation."""
    value = np.zeros(DIMENSIONS, np.uint8)
    for k, char in enumerate(gram):
        value = bind(value, permute(symbol(char), len(gram) - 1 - k))
    return value


#: 64-bit words of a packed vector, characters whose symbols are kept, grams summed at a time.
WORDS, SYMBOLS, GRAMS = -(-DIMENSIONS // 64), 16_384, 1024


def packed_vector(vector: np.ndarray) -> np.ndarray:
    """The bits of a vector in words, zeros behind them."""
    return np.packbits(np.pad(vector, (0, WORDS * 64 - DIMENSIONS))).view(np.uint64)


class Symbols:
    """Packed symbols of the characters seen so far, rotated for each place of an n-gram,
    and room for the rows of a sum, so that no text asks for memory anew."""

    def __init__(self, n: int):
        self.n = n
        self.clear()
        self.found, self.spare, *self.summed = (np.empty((2 * GRAMS + 4, WORDS), np.uint64) for _ in range(4))

    def clear(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)
        self.used = 0
        self.rows = np.empty((self.n, 128, WORDS), np.uint64)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.used > SYMBOLS:
            self.clear()
        for code in np.unique(codes[self.number[codes] < 0]).tolist():
            if self.used == self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], axis=1)
            own = symbol(chr(code))
            for k in range(self.n):
                self.rows[k, self.used] = packed_vector(permute(own, self.n - 1 - k))
            self.number[code] = self.used
            self.used += 1
        return self.number[codes]

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Packed vectors of grams, a row of n numbers each, GRAMS at most; until the next call."""
        found, spare = self.found[: len(numbers)], self.spare[: len(numbers)]
        np.take(self.rows[0], numbers[:, 0], axis=0, out=found, mode="clip")
        for k in range(1, self.n):
            np.take(self.rows[k], numbers[:, k], axis=0, out=spare, mode="clip")
            found ^= spare
        return found


@functools.cache
def symbols(n: int) -> Symbols:
    return Symbols(n)


def _added(rows: np.ndarray, spare: np.ndarray, carries: np.ndarray) -> int:
    """Leaves the lowest bits of the columns' sums in the first row, and rows of twice the
    weight that hold the remainder in carries; returns how many. Three rows at a time become
    one of each."""
    k, n = len(rows), 0
    while k > 2:
        t = k // 3
        a, b, c, x = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t], spare[:t]
        np.bitwise_xor(a, b, out=x)
        np.bitwise_and(a, b, out=b)
        np.bitwise_and(c, x, out=a)
        np.bitwise_or(a, b, out=carries[n : n + t])
        np.bitwise_xor(x, c, out=a)
        if k > 3 * t:
            rows[t : k - 2 * t] = rows[3 * t : k]
        k, n = k - 2 * t, n + t
    if k == 2:
        np.bitwise_and(rows[0], rows[1], out=carries[n])
        rows[0] ^= rows[1]
        n += 1
    return n


def packed_text_vector(text: str, n: int = 3) -> np.ndarray:
    """The bundle of a text's character n-grams, packed; equal grams are counted, not repeated.

    Sums of all dimensions are kept as rows of bits, one for each power of two.
    """
    if len(text) <= n:
        return packed_vector(gram_vector(text))
    table = symbols(n)
    numbers = table.numbers(text)
    windows = np.lib.stride_tricks.sliding_window_view(numbers, n)
    if n <= 3:
        keys, counts = np.unique(windows.astype(np.int64) @ (1 << 21 * np.arange(n, dtype=np.int64)), return_counts=True)
        grams = keys[:, None] >> 21 * np.arange(n, dtype=np.int64) & (1 << 21) - 1
    else:
        grams, counts = np.unique(windows, axis=0, return_counts=True)
    sums: list[np.ndarray] = []
    room, other = table.summed
    for at in range(0, len(grams), GRAMS):
        rows, times, carried, power = table.grams(grams[at : at + GRAMS]), counts[at : at + GRAMS], 0, 0
        while carried or times.any():
            chosen = np.flatnonzero(times & 1)
            k = carried + len(chosen)
            np.take(rows, chosen, axis=0, out=room[carried:k], mode="clip")
            if power < len(sums):
                room[k] = sums[power]
                k += 1
            elif not k:
                room[0] = 0
            carried = _added(room[:k], table.spare, other)
            sums[power : power + 1] = [room[0].copy()]
            room, other, times, power = other, room, times >> 1, power + 1
    number = len(windows)
    half, above, equal = number // 2, np.zeros(WORDS, np.uint64), np.full(WORDS, ~np.uint64(0))
    for power in reversed(range(max(len(sums), half.bit_length()))):
        own = sums[power] if power < len(sums) else np.zeros(WORDS, np.uint64)
        if half >> power & 1:
            equal &= own
        else:
            above |= equal & own
            equal &= ~own
    # Of an even number half may have the bit; the first gram decides.
    return above if number % 2 else above | equal & table.grams(windows[:1])[0]


def text_vector(text: str, n: int = 3) -> np.ndarray:
    """The bundle of a text's character n-grams, a bit in a byte."""
    return np.unpackbits(packed_text_vector(text, n).view(np.uint8))[:DIMENSIONS]


#: Of time-sorted ids: 2020-01-01T00:00:00Z in milliseconds, bits of the node and of the sequence.
ID_EPOCH_MS, NODE_BITS, SEQUENCE_BITS = 1_577_836_800_000, 10, 12


def time_sorted_id(ts_ms: Column, node: Column, sequence: Column) -> Column:
    """A 64-bit id that sorts by time: milliseconds, node, sequence within them."""
    high = F.shiftleft((ts_ms - ID_EPOCH_MS).cast("long"), NODE_BITS + SEQUENCE_BITS)
    return high.bitwiseOR(F.shiftleft(F.pmod(node, F.lit(1 << NODE_BITS)).cast("long"), SEQUENCE_BITS)).bitwiseOR(F.pmod(sequence, F.lit(1 << SEQUENCE_BITS)).cast("long"))


def name_uuid(name: Column) -> Column:
    """A UUID that follows from a name (version 3), so that a retried write gets the same one."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hypervector_similarity(rows: DataFrame) -> DataFrame:
    """id, next_similarity: 1 - Hamming distance / dimensions to the text of the next id.

    The vectors are bytes in rows, made once and kept in the shared folder; their difference
    is counted in the row.
    """

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_text_vector(t or "").tobytes() for t in texts], dtype=object)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 - int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) / DIMENSIONS for x, y in zip(a, b, strict=True)], dtype=float)

    own = checkpointed(rows.select("id", encoded(F.lower("text")).alias("a")))
    after = own.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return own.join(after, "id").select("id", F.round(alike("a", "b"), 4).alias("next_similarity"))
