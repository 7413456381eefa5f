"""Document fingerprints by one-permutation MinHash, on DataFrame functions alone.

Shingle hashes fall into 2**BITS bins once, by their top bits; the minimum of a
bin is one value of the sketch. An empty bin borrows from the non-empty bin that
a hash of both bin numbers ranks first, an independent choice for each empty bin
(optimal densification). The low byte of every value is stored; a likeness
subtracts the chance matches that bytes give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, steps

BITS, STORED = 7, 8
BINS = 1 << BITS
LOWEST = -(1 << 63)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def shingle_hashes(text: Column, k: int) -> Column:
    """Sorted hashes of the k-word shingles; of fewer words, of the whole sequence; empty without words."""
    words = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def made(w: Column) -> Column:
        n = F.size(w)
        long = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, long).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(let(words, made))


def sketch(text: Column, k: int) -> Column:
    """The stored bytes of a text's sketch as array<tinyint>; empty for a text without words."""

    def minima(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))

    def dense(m: Column) -> Column:
        def filled(bins: Column) -> Column:
            def value(i: Column) -> Column:
                at = F.array_position(bins, i).cast("int")
                lent = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x)), x.alias("x"))))["x"]
                return F.when(at > 0, F.get(m, at - 1)).otherwise(lent)

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: (value(i).bitwiseAND(F.lit((1 << STORED) - 1)) - (1 << (STORED - 1))).cast("tinyint"))

        return F.when(F.size(m) > 0, let(F.transform(m, _bin), filled)).otherwise(F.array().cast("array<tinyint>"))

    return let(let(shingle_hashes(text, k), minima), dense)


def packed(values: Column) -> Column:
    """The sketch as lower-case hex, two digits a bin."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.substring(F.hex(x.cast("int") + (1 << (STORED - 1)) + 256), 2, 2))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, corrected for chance matches of the stored bits; 1 for two empty sketches, 0 for one."""
    chance = 1.0 / (1 << STORED)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    both = F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def _ring(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, next): the next smaller id of the distinct ``ids``; after the smallest, the largest.

    Windows see the ids of one block of 4096 values; blocks are linked the same
    way, level by level, until one block is left.
    """
    lo, hi = ids.agg(F.min("id"), F.max("id")).first()
    one = lo is None or hi - lo < 4096
    up = F.lit(0).cast("long") if one else F.shiftright("id", 12)
    block = Window.partitionBy("up").orderBy(F.desc("id"))
    rows = ids.withColumn("up", up).withColumn("next", F.lead("id").over(block))
    if one:
        return rows.select("id", F.coalesce("next", F.lit(hi)).alias("next"))
    heads = ids.groupBy(up.alias("up")).agg(F.max("id").alias("head"))
    links = _ring(heads.select(F.col("up").alias("id")), scratch)
    top = links.join(heads.select(F.col("up").alias("next"), "head"), "next").select(F.col("id").alias("up"), "head")
    return rows.join(top, "up").select("id", F.coalesce("next", "head").alias("next"))


@steps("prints")
def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, scratch: Scratch) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of ``docs``.

    Words are separated by ASCII white space and compared in lower case. The
    edited text has its last floor(n_chars / 3) code points replaced by the first
    as many (or all) of the next row in descending order of id; after the last
    comes the first.

    Null text counts as empty. Null ids come after all others in the order. Rows
    that repeat an id follow each other in order of their text's digest. A single
    row is its own next. Texts without words have the empty fingerprint. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(LOWEST)))
    block = F.shiftright("k", 8)
    heads = scratch.write(rows.groupBy(block.alias("id")).agg(F.max("k").alias("k")), "heads")
    order = [F.desc("k"), F.sha2("text", 256)]
    first = rows.join(heads, "k").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("nth = 1")
    first = first.select("id", F.col("text").alias("head_text"), sketch(F.col("text"), shingle).alias("head_sketch"))
    ring = _ring(heads.select("id"), scratch)
    follow = scratch.write(ring.join(first.withColumnRenamed("id", "next"), "next").select(F.col("id").alias("block"), "head_text", "head_sketch"), "follow")
    window = Window.partitionBy("block").orderBy(*order)
    rows = rows.withColumn("sketch", sketch(F.col("text"), shingle)).withColumn("block", block)
    rows = rows.withColumns({"next_text": F.lead("text").over(window), "next_sketch": F.lead("sketch").over(window)})
    rows = rows.join(follow, "block", "left").withColumns({"next_text": F.coalesce("next_text", "head_text"), "next_sketch": F.coalesce("next_sketch", "head_sketch")})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), shingle)).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    held = scratch.write(rows, "sketches")
    scratch.close("sketches")
    return held.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("sketch")).alias("fingerprint"),
        packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
