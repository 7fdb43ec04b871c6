"""Token counts from flat, unindexed token files, by scanning for separators.

A token file is nothing but little-endian 16-bit token ids, a separator behind
every document. Every task writes its documents in the order in which it reads
them, and in the same attempt their ids to a file of the same name elsewhere, so
tokens are never shuffled. Files are searched block by block with vector operations. A
block reports how many tokens and separators it has and where its first and
last separator lie; a prefix scan over the blocks of a file then yields every
document's length, those that lie across blocks included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import library_codec
from .common import map_arrow, path_exists

#: The id free for a separator beside the 50,256 ranks of the public vocabulary.
SEPARATOR = 50256
#: Tokens per block of the scan.
BLOCK = 1 << 20
#: Documents to a file.
FILE_ROWS = 5_000
#: Bytes of text encoded before rows are handed on.
PART_BYTES = 4 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, file_rows: int = FILE_ROWS, vocab_path: str | None = None) -> DataFrame:
    """Write the tokens of all rows below ``path`` and return ``(shard, nth, id_col)``.

    A shard is one file of at most ``file_rows`` documents below
    ``kind=tokens``; the file of the same name below ``kind=ids`` lists their
    ids, which the returned table is read from. Null texts are empty documents.
    Rows that repeat are repeated, null ids are kept, extra columns are not
    read, and texts of any length are encoded whole. The separator ends each
    row, as the text writer's line end. An empty table gives no files.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    end = separator.to_bytes(2, "little")

    def run(batches):
        own = library_codec(vocab_path)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                tokens, size = [], 0
                while at + len(tokens) < batch.num_rows and size < PART_BYTES:
                    text = texts[at + len(tokens)].as_py() or ""
                    tokens.append(b"".join(np.array(x, dtype="<u2").tobytes() for x in own.blocks(text)))
                    size += len(text)
                ids = [b"-" if i is None else i.encode().hex().encode() for i in batch.column(0).slice(at, len(tokens)).to_pylist()]
                at += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"] * len(ids) + ["ids"] * len(ids)), pa.array(tokens + ids, pa.binary())], ["kind", "value"])

    coded = map_arrow(df.select(F.col(id_col).cast("string"), text_col), run, "kind string, value binary")
    before = spark.conf.get(_WRITERS, "0")
    # Both kinds are written side by side, so rows stay in order without a sort.
    spark.conf.set(_WRITERS, "2")
    try:
        rows = coded.select("kind", F.col("value").cast("string").alias("value"))
        rows.write.partitionBy("kind").option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", file_rows).text(path)
    finally:
        spark.conf.set(_WRITERS, before)
    if not path_exists(spark, f"{path}/kind=ids"):
        return df.select(F.lit("").alias("shard"), F.lit(0).cast("long").alias("nth"), id_col).limit(0)

    def listed(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [None if x == b"-" else bytes.fromhex(x.decode()).decode() for x in _ended(content, end)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.string())], ["shard", "nth", "id"])

    ids = map_arrow(_files(spark, f"{path}/kind=ids"), listed, "shard string, nth long, id string")
    return ids.select("shard", "nth", F.col("id").cast(id_type).alias(id_col))


def _ended(content: bytes, end: bytes) -> list[bytes]:
    """The parts of ``content``, each with ``end`` behind it. Ids are hexadecimal, so the end is told by what is no digit."""
    if not (set(end) - set(b"0123456789abcdef-")):
        raise ValueError("a separator must have a byte that is no hexadecimal digit")
    return content.split(end)[:-1]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, content)`` of the files below ``path``, by their names."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")


def scan_block(tokens: np.ndarray, separator: int = SEPARATOR) -> tuple[int, int, int, int, np.ndarray]:
    """Of one block: tokens, separators, first and last separator's position (-1), lengths within.

    The lengths are those of the documents between two separators of the block.
    """
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return len(tokens), 0, -1, -1, at
    return len(tokens), len(at), int(at[0]), int(at[-1]), np.diff(at) - 1


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """``(shard, nth, n_tokens)`` for each document of the token files below ``path/kind=tokens``.

    Documents are counted from 0 within each shard. Tokens behind the last
    separator of a file are a document too; a file of an odd number of bytes
    is refused. Files without tokens have no documents.
    """

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if data.size % 2:
                    raise ValueError("a token file must have an even number of bytes")
                tokens = np.frombuffer(data, dtype="<u2")
                for serial, at in enumerate(range(0, len(tokens), block)):
                    n, seps, first, last, inner = scan_block(tokens[at : at + block], separator)
                    values = [[shard], [serial], [n], [seps], [first], [last], [inner]]
                    kinds = [pa.string()] + [pa.int64()] * 5 + [pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    names = ["shard", "block", "n", "seps", "first", "last", "inner"]
    blocks = map_arrow(_files(spark, f"{path}/kind=tokens"), run, "shard string, block long, n long, seps long, first long, last long, inner array<long>")
    # The stitch: absolute positions, documents and the separator before a block are running sums and maxima.
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("shard")
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    placed = blocks.select("*", start.alias("start"), F.coalesce(F.sum("seps").over(earlier), F.lit(0)).alias("docs"), F.sum("n").over(whole).alias("total"))
    placed = placed.withColumn("end_at", F.when(F.col("seps") > 0, F.col("start") + F.col("last")))
    placed = placed.select("*", F.coalesce(F.max("end_at").over(earlier), F.lit(-1).cast("long")).alias("before"), F.max("end_at").over(whole).alias("final"), F.sum("seps").over(whole).alias("all_docs"))
    # A block's documents: the one that its first separator ends, then those within.
    lengths = F.concat(F.array(F.col("start") + F.col("first") - F.col("before") - 1), F.col("inner"))
    ended = placed.filter("seps > 0").select("shard", "docs", F.posexplode(lengths).alias("pos", "n_tokens")).select("shard", (F.col("docs") + F.col("pos")).alias("nth"), "n_tokens")
    tail = F.col("total") - 1 - F.coalesce("final", F.lit(-1).cast("long"))
    rest = placed.filter(F.col("block") == 0).filter(tail > 0).select("shard", F.col("all_docs").alias("nth"), tail.alias("n_tokens"))
    return ended.unionByName(rest)


def document_token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write token files for ``df``, scan them, and return ``(id_col, n_tokens)`` per row.

    Same rules as :func:`write_token_files`; an empty table gives an empty result.
    """
    places = write_token_files(df, path, id_col, text_col, **options)
    if not path_exists(df.sparkSession, f"{path}/kind=tokens"):
        return places.select(id_col, F.lit(0).cast("long").alias("n_tokens"))
    counts = count_tokens(df.sparkSession, path, options.get("separator", SEPARATOR))
    return counts.join(places, ["shard", "nth"]).select(id_col, "n_tokens")
