"""Line deduplication: passages that an earlier document has are deleted.

A passage is a run of neighbouring lines with at least ``block_words`` words
that stands likewise in an earlier document. Every such run is covered by
shortest runs: those that from one of its lines on, or up to one of its lines,
just reach the words asked for. Documents that overlap are found through the
hashes of these runs: each that several documents hold pairs the later ones
with its first holder. That is linear in the number of lines however frequent a
line is, and leaves out no pair that matters: whatever a document has in common
with any earlier one, the first holders of the runs have as well. A pair's
shared runs are aligned by patience, and the aligned blocks are deleted from
the later document. What one alignment leaves over, as passages that were moved
or said twice, is aligned again, so in the end every shared run is.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Words that a passage needs to be deleted.
BLOCK_WORDS = 20
#: Base of the hashes of runs, odd and 3 modulo 4, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C17
UNBASE = pow(BASE, -1, 1 << 64)
#: Lines looked at together in a worker; a document is never divided.
PART_LINES = 1 << 16

#: Scripts written without blanks: each of their letters, with its marks, counts as a word.
_UNSPACED = (
    r"\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    r"\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48f\ua980-\ua9df\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_LETTER = regex.compile(rf"(?V1)[[{_UNSPACED}]&&[\p{{L}}\p{{Nl}}]]\p{{M}}*")


def shortest_runs(words: np.ndarray, first: np.ndarray, end: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs that just reach ``block_words`` words, each once.

    ``first`` and ``end`` are, for every line, those of its document: no run leaves it.
    """
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    line = np.arange(len(words))
    upto = np.searchsorted(total, total[:-1] + block_words, "left")
    since = np.searchsorted(total, total[1:] - block_words, "right") - 1
    on, back = upto <= end, since >= first
    both = np.unique(np.stack([np.concatenate((line[on], since[back])), np.concatenate((upto[on], line[back] + 1))]), axis=1)
    return both[0], both[1]


def run_hashes(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of runs of line hashes, wherever the runs stand."""
    power = lambda base: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(lines), base, np.uint64), dtype=np.uint64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lines.astype(np.uint64) * power(BASE)[:-1], dtype=np.uint64)))
    return ((sums[ends] - sums[starts]) * power(UNBASE)[starts]).astype(np.int64)


def described(text: bytes) -> tuple[list[int], list[int]]:
    """Hash and number of words of every line. Blanks at a line's ends do not count."""
    lines = text.split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(x.strip(b" ")) for x in lines]
    if text.isascii() or not _LETTER.search(whole := text.decode("utf-8", "replace")):
        return hashes, [len(x.split()) for x in lines]
    return hashes, [len(_LETTER.sub(" x ", x).encode().split()) for x in whole.split("\n")]


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting with back pointers."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for n, x in enumerate(values):
        p = bisect_left(tops, x)
        back[n] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(x)
            piles.append(n)
        else:
            tops[p], piles[p] = x, n
    n, out = (piles[-1] if piles else -1), []
    while n >= 0:
        out.append(n)
        n = back[n]
    return out[::-1]


def increasing_parts(values: list[int]) -> list[list[int]]:
    """Positions of all values, dealt to as few strictly increasing subsequences as possible."""
    parts: list[list[int]] = []
    least: list[int] = []  # negated last values, ascending
    for n, x in enumerate(values):
        p = bisect_left(least, 1 - x)
        if p == len(parts):
            parts.append([n])
            least.append(-x)
        else:
            parts[p].append(n)
            least[p] = -x
    return parts


def align(starts: list[int], ends: list[int], others: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks ``(start, end, start in the earlier document)`` of one pair.

    Given are the shared runs of the later document, by start, and where each
    stands in the earlier one. A run that stands at one place there may be said
    several times here: first sayings are aligned with each other, then second
    ones, and so on. Of each, the longest run increasing on both sides is the
    alignment; moved runs that it leaves over are aligned in further ones.
    """
    said: dict[tuple[int, int], int] = {}
    turns: dict[int, list[int]] = {}
    for n, (s, e, o) in enumerate(zip(starts, ends, others, strict=True)):
        nth = said[o, e - s] = said.get((o, e - s), -1) + 1
        turns.setdefault(nth, []).append(n)
    blocks: list[tuple[int, int, int]] = []
    for own in turns.values():
        chosen = set(longest_increasing([others[n] for n in own]))
        left = [n for k, n in enumerate(own) if k not in chosen]
        chains = [[own[k] for k in sorted(chosen)], *[[left[k] for k in part] for part in increasing_parts([others[n] for n in left])]]
        for chain in chains:
            for n in chain:
                s, e, o = starts[n], ends[n], others[n]
                if blocks and chain[0] != n and s - o == blocks[-1][0] - blocks[-1][2] and s <= blocks[-1][1]:
                    blocks[-1] = (blocks[-1][0], max(e, blocks[-1][1]), blocks[-1][2])
                else:
                    blocks.append((s, e, o))
    return sorted(blocks)


def _named(batches, block_words: int):
    """``(id, mark, h, s, e)`` for the shortest runs of ``(id, mark, text)``."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            sizes, hashes, words, first = [], [], [], at
            while at < batch.num_rows and len(hashes) < PART_LINES:
                own = described(batch.column(2)[at].as_buffer().to_pybytes())
                sizes.append(len(own[0]))
                hashes += own[0]
                words += own[1]
                at += 1
            tops = np.concatenate(([0], np.cumsum(sizes)))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            starts, ends = shortest_runs(np.array(words, np.int64), tops[doc], tops[doc + 1], block_words)
            h = run_hashes(np.array(hashes, np.uint64), starts, ends)
            own = doc[starts]
            which = pa.array(own + first)
            columns = [batch.column(0).take(which), batch.column(1).take(which), pa.array(h), pa.array((starts - tops[own]).astype(np.int32)), pa.array((ends - tops[own]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "h", "s", "e"])


def _aligned(batches, block: pa.DataType):
    """``(id, mark, blocks)`` of ``(id, mark, runs)``, ``runs`` with the earlier document's id and place."""
    for batch in batches:
        out = []
        for runs in batch.column(2).to_pylist():
            pairs: dict = {}
            for r in sorted({(r["first"], r["s"], r["e"], r["o"]) for r in runs}, key=lambda r: r[1:]):
                pairs.setdefault(r[0], []).append(r[1:])
            out.append([dict(zip(("start", "end", "other", "other_start"), (s, e, other, o), strict=True)) for other, own in pairs.items() for s, e, o in align(*map(list, zip(*own, strict=True)))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(block))], ["id", "mark", "blocks"])


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def overlaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, mark, blocks)`` of the documents that share passages with earlier ones; see :func:`delete_repeats`.

    ``mark`` is the hash of the text, ``blocks`` an array of
    ``(start, end, other, other_start)``: lines ``start`` to before ``end`` stand
    likewise from line ``other_start`` on in the earlier document ``other``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = df.schema[id_col].dataType
    kind = id_field.simpleString()
    block = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other", to_arrow_type(id_field)), ("other_start", pa.int32())])
    usable = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text")).filter("id is not null and text is not null")
    runs = materialise(map_arrow(usable, lambda batches: _named(batches, block_words), f"id {kind}, mark long, h long, s int, e int"), "line-runs")
    # Written, so that the join below reads shuffled rows on both sides and a frequent run is split.
    shared = runs.groupBy("h").agg(F.min(F.struct("id", "s")).alias("held"), F.max("id").alias("last")).filter("held.id < last")
    shared = materialise(shared.select("h", F.col("held.id").alias("first"), F.col("held.s").alias("o")), "first-holders")
    met = runs.join(shared.hint("merge"), "h").filter("first < id").groupBy("id", "mark").agg(F.collect_list(F.struct("first", "s", "e", "o")).alias("runs"))
    return map_arrow(met, lambda batches: _aligned(batches, block), f"id {kind}, mark long, blocks array<struct<start:int,end:int,other:{kind},other_start:int>>")


def delete_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``df``: ``(id_col, text, n_lines, removed, blocks)``.

    Lines are equal when equal without blanks at their ends. ``removed`` lists
    the positions deleted, counted from 0, and ``text`` is what is left: all
    but the lines in runs of at least ``block_words`` words that stand likewise
    in an earlier document; ``blocks`` says where (see :func:`overlaps`). The
    smaller id is the earlier document. A null text stays null and has no
    lines; an empty text has one empty line. Rows with a null id neither lose
    lines nor take them from others. Rows that repeat an id are not compared
    with each other. Lines and texts may be of any length. An empty table gives
    an empty result; extra columns are not read.
    """
    found = overlaps(df, id_col, text_col, block_words).select("id", "mark", "blocks", F.array_sort(F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.sequence(b["start"], b["end"] - 1))))).alias("gone"))
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    out = base.join(found.hint("merge"), ["id", "mark"], "left")
    parts = _lines(F.col("text"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    none = F.array().cast("array<int>")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.coalesce("gone", none).alias("removed"),
        F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType)).alias("blocks"),
    )
