"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are cut into chunks where their own content says so. Chunks are
deduplicated, and a chunk's 64-bit hash becomes its identifier once all chunks
with that hash have proved to be the same text; hashes that fail the proof are
told apart by the text itself. A document is then its recipe, the ordered list
of chunk identifiers, and equal recipes mean equal texts. Only distinct chunks
cross the network, once; documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: A chunk has this many characters, but for the last of a text.
MIN_CHUNK, MAX_CHUNK = 384, 4096
#: A cut may fall behind this pattern, met about every 50 characters of any text
#: in Latin letters or digits, with blanks or without.
CUT_AFTER = "[a-d0-2][a-m0-4][e-t3-9][b-l1-6]"
#: The same for all other scripts, where characters are four hexadecimal digits:
#: it goes by the last digit of each, so no alphabet is without cuts.
WIDE_CUT_AFTER = "...[0-3]...[0-7]...[4-9]...[8-D]"


def _wide(text: Column) -> Column:
    """Whether most of a text's characters are of other scripts than Latin."""
    return F.octet_length(text) > 1.5 * F.char_length(text)


def chunks_of(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The text as an array of content-defined chunks, in UTF-8, or in UTF-16 where it is wide; an empty text has none."""
    plain = F.regexp_extract_all(text, F.lit(f"(?s).{{{low},{high - 1}}}?(?<={CUT_AFTER})|.{{1,{high}}}"), F.lit(0))
    digits = F.hex(F.encode(text, "UTF-16BE"))
    wide = F.regexp_extract_all(digits, F.lit(f"(?:....){{{low},{high - 1}}}?(?<={WIDE_CUT_AFTER})|.{{1,{4 * high}}}"), F.lit(0))
    return F.when(_wide(text), F.transform(wide, F.unhex)).otherwise(F.transform(plain, lambda c: c.cast("binary")))


def recipes(df: DataFrame, id_col: str, text_col: str, hasher=F.xxhash64) -> DataFrame:
    """``(id, recipe, whole, text_sha256)``; equal (recipe, whole) mean equal texts.

    ``recipe`` lists chunk identifiers. ``whole`` is empty, but for texts with a
    chunk whose hash other chunks share too: those few are compared outright.
    ``hasher`` is a parameter so that tests can force this.
    """
    base = df.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    # The first entry tells how the text was cut, so chunks of one kind are never taken for the other.
    first = F.array(_wide(F.col("norm")).cast("long"))
    own = base.select("id", F.concat(first, F.transform(chunks_of(F.col("norm")), lambda c: hasher(c))).alias("recipe"), "norm", F.sha2("norm", 256).alias("text_sha256"))
    # The proof: group by hash and text, then count texts per hash. The first
    # step removes copies before anything is shuffled; the second moves hashes only.
    pieces = base.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")).select(hasher(F.col("chunk")).alias("h"), "chunk")
    distinct = pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    bad = materialise(distinct.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "chunk-collisions")
    if bad.isEmpty():
        return own.select("id", "recipe", F.lit("").alias("whole"), "text_sha256")
    marked = own.select("recipe").distinct().select("recipe", F.explode("recipe").alias("h")).join(bad, "h").select("recipe").distinct().withColumn("marked", F.lit(True))
    return own.join(marked, "recipe", "left").select("id", "recipe", F.when(F.col("marked"), F.col("norm")).otherwise("").alias("whole"), "text_sha256")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=F.xxhash64) -> DataFrame:
    """One row per row of ``df``: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the largest id stays. Rows that repeat an id with an
    equal text are one document and share its fate. A null id never stays
    beside others of its group; alone (or among nulls) it stays and keep_id is
    null. An empty table gives an empty result; extra columns are not read.
    """
    # Written once: the recipes are read twice below, the texts only here.
    own = materialise(recipes(df, id_col, text_col, hasher), "recipes")
    groups = own.groupBy("recipe", "whole").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # A group of one is its own answer, so only larger groups are joined back.
    # They have one row each and are written, so both sides of the join are shuffled rows
    # and a hot recipe is split on the other side (AQE skew join).
    groups = materialise(groups.filter("group_size > 1"), "recipe-groups")
    out = own.join(groups.hint("merge"), ["recipe", "whole"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns, whatever their names.

    Rows are matched by id and text digest. Of rows that repeat both, one
    stays, so no two rows that are left have equal texts.
    """
    key, sha, times = "_row_key", "_row_sha", "_row_times"
    keep = annotate(df, id_col, text_col).filter("kept").groupBy(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias(key), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(times))
    keep = materialise(keep, "kept-rows")
    # All columns travel in one struct, so no name of theirs can clash with ours.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias(key), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256).alias(sha))
    single = rows.join(keep.filter(f"{times} = 1").drop(times), [key, sha], "left_semi").select("row.*")
    repeated = keep.filter(f"{times} > 1").drop(times)
    if repeated.isEmpty():
        return single
    return single.unionByName(rows.join(repeated, [key, sha]).dropDuplicates([key, sha]).select("row.*"))
