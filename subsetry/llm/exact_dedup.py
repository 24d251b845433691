"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of one bitmap of bitmap_construct_agg.
BITMAP = 32768
#: The filter has at most so many bits (32 MB), whatever the input; beyond about 100 million
#: rows it lets more unique rows through to the exact comparison, and the result is the same.
MAX_BITS = 1 << 28
#: Copies of each group's row in the join back, so that a large group is spread.
SALTS = 8


def lowered(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _slots(hashed: Column, buckets: int) -> tuple[Column, Column, Column]:
    """Of a hash: the number of its bitmap and two positions in it, from different bits."""
    pos = [F.shiftrightunsigned(hashed, n).bitwiseAND(F.lit(BITMAP - 1)).cast("int") for n in (20, 40)]
    return F.pmod(hashed, F.lit(buckets)).cast("int"), pos[0], pos[1]


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.element_at(F.array(*[F.shiftright(byte, i).bitwiseAND(F.lit(1)) for i in range(8)]), pos % 8 + 1) == 1


def marked(docs: DataFrame, text_col: str, flag: str, bits_per_row: int = 16) -> DataFrame:
    """docs and a boolean column: False only where no other row has an equal text.

    First pass: each text's hash sets two slots of one small block; only slot numbers are
    counted, within each task first, and the slots hit twice or more form the filter, at most
    MAX_BITS bits. Second pass: a row is marked if both its slots are in the filter. The hash
    is of the fully lower-cased text: texts that are equal after lower-casing A-Z only are
    equal then as well.
    """
    rows = docs.count()
    buckets = 1
    while buckets * BITMAP < min(MAX_BITS, rows * bits_per_row):
        buckets *= 2
    hashed = F.xxhash64(F.lower(common.text_of(docs, text_col)))
    block, one, two = _slots(F.col("h"), buckets)
    hit = docs.select(hashed.alias("h")).select(block.alias("b"), F.explode(F.array(one, two)).alias("p"))
    filters = (
        hit.groupBy("b", "p").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
        .groupBy("b").agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bits"))
    )
    h, b, bits = common.unused(docs, "h", "b", "bits")
    block, one, two = _slots(F.col(h), buckets)
    return (
        docs.withColumn(h, hashed).withColumn(b, block)
        .join(F.broadcast(filters.select(F.col("b").alias(b), F.col("bits").alias(bits))), b, "left")
        .withColumn(flag, F.coalesce(_bit(F.col(bits), one) & _bit(F.col(bits), two), F.lit(False)))
        .drop(h, b, bits)
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z (null: empty). Of equal texts the
    row with the largest id stays; of several with that id, one; a null id is below all
    others. Only rows that the filter marks shuffle, as id and digest, never as text. An empty
    table gives no rows; other columns are ignored.
    """
    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    rows = common.staged(
        marked(own, "text", "maybe").select("id", F.sha2(lowered(F.col("text")), 256).alias("sha"), "maybe", F.monotonically_increasing_id().alias("tag")),
        "exact",
    )
    alone = rows.where("not maybe").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    maybe = rows.where("maybe")
    groups = (
        maybe.groupBy("sha").agg(F.max(F.struct("id", "tag")).alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        .select("sha", "top", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    joined = maybe.withColumn("salt", F.pmod(F.col("tag"), F.lit(SALTS)).cast("int")).join(groups, ["sha", "salt"], "left")
    return alone.unionByName(
        joined.select(
            F.col("id").alias(id_col),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("top.tag") == F.col("tag"), F.lit(True)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: all columns, one row of each group of equal texts.

    Rows that the filter does not mark pass without a shuffle. Of marked rows, tasks keep the
    best row of each group before they exchange rows, so that a large group costs one row for
    each task. Of rows with the same largest id, the one with the largest text stays.
    """
    flag, sha, best = common.unused(docs, "maybe", "sha", "best")
    rows = marked(docs, text_col, flag)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    chosen = (
        rows.where(F.col(flag)).withColumn(sha, F.sha2(lowered(common.text_of(rows, text_col)), 256))
        .groupBy(sha).agg(F.max_by(row, order).alias(best)).select(f"{best}.*")
    )
    return rows.where(~F.col(flag)).drop(flag).unionByName(chosen)
