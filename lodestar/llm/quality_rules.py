"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The method looks across texts: lines are normalised
(lower case, white space collapsed) and hashed; for each host (here: the source)
the distinct documents that hold a line are counted; a line in at least
``MIN_DOCS`` documents and ``MIN_SHARE`` of its host's is removed; a document of
whose words less than ``MIN_LEFT`` is left is depleted and rejected.

Copies count once. Exact copies are one document by the digest of their text. Edited
copies are told from documents that share a block of lines by what is left of them
without the lines that reach the limits: an edited copy's own lines are versions of
its original's lines and so share most of their three-word windows with other copies'
lines, while documents that only share a block have own lines of their own. So each
text with a twentieth or more of its words in such lines gets eight keys, the least of
eight hashes of the windows of its own lines; a text that shares two keys or more with
earlier texts of its host (by digest) is an edited copy and does not count. What is
shared never enters a key, so a block of lines is counted right whatever its length.
A text without own lines is a document of shared lines and counts.

Shuffles: one row for each distinct line of a distinct text, summed before and after
(so a line that a third of all rows hold is no hot task). The removed lines of a
host are few whatever the size: no more than the mean number of lines of its
documents divided by MIN_SHARE. They meet the documents as one array a host,
broadcast if their counted size is below a bound, else by host and, where a host has
many documents, by a salt.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import by_host, checkpointed, internal, let, met, small, table, text_of, words_of, written


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the line rule."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    symbols: str = "#*$%&|<>"
    min_docs: int = 10
    min_share: float = 0.01
    min_left_percent: int = 20
    #: From this share of its words in lines that reach the limits, a text may be an edited copy.
    copy_percent: int = 5


RULES = Rules()

#: Words of a window of a text's own lines, its keys, and how many of them a copy shares.
SHINGLE, KEYS, SHARED_KEYS = 3, 8, 2
#: What is flipped of the windows' hashes (60 bits) for each key: the k-th multiple of an odd constant.
MASKS = tuple(k * 0x9E3779B97F4A7C1 % (1 << 60) for k in range(KEYS))


def n_covered(grams: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more.

    The sorted (hash, place) pairs put equal windows side by side; the places with
    an equal neighbour, in order, each add what they cover beyond the one before.
    """
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        kept = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda e: e["p"]))

    def covered(places: Column) -> Column:
        gains = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))).cast("long"))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(pairs, repeated), covered)


def n_repeat_words(words: Column, window: int) -> Column:
    """Words in windows of so many words that the text has twice or more."""

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        # A window from the pairs of its words, and from its last word if their number is odd.
        grams = let(pairs, lambda p: F.transform(p, lambda x, i: F.xxhash64(x, *[F.get(p, i + k) for k in range(2, window - 1, 2)], *([F.get(h, i + window - 1)] if window % 2 else []))))
        grams = F.slice(grams, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0)))
        none = F.lit(0).cast("long")
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(n_covered(g, window)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def normal(text: Column) -> Column:
    """In lower case, white space other than line feeds as one blank."""
    return F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")


def normal_lines(text: Column) -> Column:
    """The normalised lines with a word."""
    return F.filter(F.transform(F.split(normal(text), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")


def n_words_of(line: Column) -> Column:
    """The words of a normalised line."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def line_rows(text: Column) -> Column:
    """The lines with a word: (hash of the normalised line, its words)."""
    return F.transform(normal_lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), n_words_of(x).alias("w")))


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines of these hashes; the others stay as they are."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(hashes, F.xxhash64(F.btrim(normal(x)))))
    return F.array_join(kept, "\n")


def host_key(host: Column) -> Column:
    """A host as a text that isn't null: a null host is a host of its own."""
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host.cast("string")))


def text_digest(text: Column) -> Column:
    """60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def frequent_lines(docs: DataFrame, rules: Rules = RULES, text_column: str = "text", host_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """(host, h) of the lines above their hosts' limits, and (host, n) of the hosts' distinct texts."""
    rows = docs.select(host_key(docs[host_column]).alias("host"), text_of(docs, text_column).alias("text"))
    held = let(line_rows(F.col("text")), lambda x: F.array_distinct(x))
    # One row for each distinct line of a text and one for the text itself.
    each = rows.select("host", text_digest(F.col("text")).alias("t"), F.explode(F.array_append(held, F.lit(None))).alias("line"))
    lines = written(each.select("host", "t", F.col("line.h").alias("h"), F.col("line.w").alias("w")).distinct(), "lines")
    counted = checkpointed(lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("h").isNull() | (F.col("n") >= rules.min_docs)), lines.count() // rules.min_docs)
    texts = counted.where("h IS NULL").select("host", F.col("n").alias("n_docs"))
    limit = F.greatest(F.lit(float(rules.min_docs)), F.col("n_docs") * F.lit(rules.min_share))
    reached = counted.where("h IS NOT NULL").join(small(texts, texts.count(), 32), "host").withColumn("limit", limit).where(F.col("n") >= F.col("limit")).select("host", "h", "limit")
    reached = checkpointed(reached)
    many = reached.count()
    hosts = texts.withColumnRenamed("n_docs", "n")
    if not many:
        return reached.select("host", "h"), hosts
    asked = reached.groupBy("host").agg(F.collect_list("h").alias("asked"))
    copies = edited_copies(by_host(rows, asked, hosts, "host", 8 * many), rules)
    bearers = lines.where("h IS NOT NULL").join(small(reached, many, 40), ["host", "h"]).join(copies, ["host", "t"], "left_anti")
    above = bearers.groupBy("host", "h").agg(F.count("*").alias("n"), F.first("limit").alias("limit")).where(F.col("n") >= F.col("limit"))
    return above.select("host", "h"), hosts


def own_keys(text: Column, asked: Column, percent: int) -> Column:
    """The keys of a text's own lines; none if it has too few of the asked lines, or no own line."""

    def shares(lines: Column) -> Column:
        common = F.filter(lines, lambda x: F.array_contains(asked, F.xxhash64(x)))
        return let(common, lambda c: F.when(100 * total_of(F.transform(c, n_words_of)) >= percent * total_of(F.transform(lines, n_words_of)), F.array_except(lines, c)))

    def windows(words: Column) -> Column:
        grams = F.transform(words, lambda x, i: text_digest(F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, SHINGLE)])))
        return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))

    def flipped(mask: int) -> Callable[[Column], Column]:
        return lambda x: x.bitwiseXOR(F.lit(mask))

    def least(grams: Column) -> Column:
        # A constant's bits flipped give each key another order of the windows' hashes.
        return F.array(*[F.struct(F.lit(k).alias("k"), F.array_min(F.transform(grams, flipped(m))).alias("x")) for k, m in enumerate(MASKS)])

    own = let(F.array_distinct(normal_lines(text)), shares)
    return let(own, lambda x: F.when(F.size(x) > 0, let(let(F.split(F.concat_ws(" ", x), " "), windows), least)))


def edited_copies(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """host, text, asked -> (host, t) of the texts that share keys with earlier ones of their host."""
    keyed = rows.where(F.col("asked").isNotNull()).select("host", F.col("text"), own_keys(F.col("text"), F.col("asked"), rules.copy_percent).alias("keys"))
    keys = written(keyed.select("host", text_digest(F.col("text")).alias("t"), F.explode("keys").alias("key")).select("host", "t", "key.k", "key.x").distinct(), "keys")
    first = keys.groupBy("host", "k", "x").agg(F.min("t").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = met(keys, checkpointed(first, keys.count()), ["host", "k", "x"], 64).where("t > first")
    return checkpointed(later.groupBy("host", "t").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_KEYS).select("host", "t"))


def with_rules(docs: DataFrame, rules: Rules = RULES, text_column: str = "text", host_column: str = "source", out: str = "rules", cleaned: str | None = None) -> DataFrame:
    """The documents with a struct column of the counts and verdicts.

    With ``cleaned`` also a column of that name: the text without the lines above the
    limits; the other lines stay as they are, a text without such lines is unchanged.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words (long), base_failed, kept (boolean). A null text counts as empty:
    it has no words and fails the base rules. A null host is a host of its own.
    Repeated rows get the same verdict and don't add to a line's documents. An
    empty table stays empty. Other columns stay as they are.
    """
    above, hosts = frequent_lines(docs, rules, text_column, host_column)
    above = checkpointed(above)
    key, lines = internal(docs, "__host"), internal(docs, "__lines")
    sites = above.groupBy(F.col("host").alias(key)).agg(F.collect_list("h").alias(lines))
    joined = by_host(docs.withColumn(key, host_key(docs[host_column])), sites, hosts.withColumnRenamed("host", key), key, 8 * above.count())
    text = F.coalesce(joined[text_column].cast("string"), F.lit(""))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, "[" + re.escape(rules.symbols) + "]+", ""))).cast("long")

    def removed(rows: Column) -> Column:
        above = F.array_intersect(F.transform(rows, lambda e: e["h"]), joined[lines])
        none = F.lit(0).cast("long")
        return let(above, lambda a: F.when(F.size(a) > 0, F.aggregate(F.filter(rows, lambda e: F.array_contains(a, e["h"])), none, lambda s, e: s + e["w"])).otherwise(none))

    removed_words = F.when(joined[lines].isNull(), F.lit(0).cast("long")).otherwise(let(line_rows(text), removed))

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), n_repeat_words(words, rules.window).alias("n_repeat_words"))

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
        depleted = 100 * (c["n_words"] - c["removed"]) < rules.min_left_percent * c["n_words"]
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"), c["removed"].alias("removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        )

    counts = let(let(words_of(text), counted), lambda c: F.struct(c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_repeat_words"].alias("n_repeat_words"), removed_words.alias("removed")))
    found = joined.withColumn(out, let(counts, verdict))
    if cleaned:
        whole = F.col(f"`{text_column}`").cast("string")
        found = found.withColumn(cleaned, F.when(F.col(out)["removed_words"] > 0, without_lines(whole, F.col(lines))).otherwise(whole))
    return found.drop(key, lines)


def filtered(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The documents that the rules keep, their text without the lines above the limits.

    The other columns are the documents' own (a length as it was read, too).
    """
    out, text = internal(docs, "__rules"), internal(docs, "__text")
    kept = with_rules(docs, rules, out=out, cleaned=text).where(F.col(out)["kept"])
    return kept.select(*[F.col(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    r = with_rules(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    return r.select("doc_id", *[F.col("rules")[n].alias(n) for n in names])


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) >= 5),
gram AS (SELECT doc_id, p, words[p:p + 4] AS g FROM pos),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram),
gain AS (SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS g FROM twice WHERE n > 1),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gain GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM raw
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM raw),
hashed AS (SELECT doc_id, coalesce('+' || source, '-') AS host, line AS h, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM norm WHERE line <> ''),
t AS (SELECT DISTINCT coalesce('+' || source, '-') AS host, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS t FROM d),
host AS (SELECT host, count(*) AS n_docs FROM t GROUP BY host),
tl AS (SELECT host, t, unnest(string_split(text, chr(10))) AS line FROM t),
tn AS (SELECT DISTINCT host, t, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS h FROM tl),
tw AS (SELECT host, t, h, length(h) - length(replace(h, ' ', '')) + 1 AS n FROM tn WHERE h <> ''),
reached AS (SELECT tw.host, h, greatest(10.0::DOUBLE, n_docs * 0.01::DOUBLE) AS lim FROM tw JOIN host USING (host)
            GROUP BY tw.host, h, n_docs HAVING count(*) >= 10 AND count(*) >= n_docs * 0.01::DOUBLE),
heavy AS (SELECT tw.host, t FROM tw LEFT JOIN reached r ON tw.host = r.host AND tw.h = r.h GROUP BY tw.host, t
          HAVING count(r.h) > 0 AND 100 * sum(CASE WHEN r.h IS NOT NULL THEN n ELSE 0 END) >= 5 * sum(n)),
first_at AS (SELECT host, t, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS h, min(i) AS i
             FROM (SELECT host, t, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t) GROUP BY ALL),
own AS (SELECT o.host, o.t, string_split(string_agg(o.h, ' ' ORDER BY i), ' ') AS ws FROM first_at o JOIN heavy USING (host, t)
        LEFT JOIN reached r ON o.host = r.host AND o.h = r.h WHERE r.h IS NULL AND o.h <> '' GROUP BY o.host, o.t),
win AS (SELECT host, t, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM own),
gm AS (SELECT host, t, ('0x' || substr(md5(array_to_string(ws[p:p + 2], ' ')), 1, 15))::BIGINT AS m FROM win),
keys AS (SELECT host, t, k, min(xor(m, (k * 712544676207699905::HUGEINT % 1152921504606846976::HUGEINT)::BIGINT)) AS key
         FROM gm, (SELECT unnest(range(0, 8)) AS k) GROUP BY host, t, k),
firsts AS (SELECT host, k, key, min(t) AS t FROM keys GROUP BY host, k, key),
copies AS (SELECT keys.host, keys.t FROM keys JOIN firsts ON keys.host = firsts.host AND keys.k = firsts.k AND keys.key = firsts.key
           WHERE keys.t > firsts.t GROUP BY keys.host, keys.t HAVING count(*) >= 2),
above AS (SELECT tw.host, tw.h FROM tw JOIN reached r ON tw.host = r.host AND tw.h = r.h ANTI JOIN copies c ON tw.host = c.host AND tw.t = c.t
          GROUP BY tw.host, tw.h, lim HAVING count(*) >= lim),
gone AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM hashed
         JOIN above ON hashed.host = above.host AND hashed.h = above.h GROUP BY doc_id),
c AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
      FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
       NOT base_failed AND NOT 100 * (n_words - removed_words) < 20 * n_words AS kept
FROM v
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": OP2_SQL}
