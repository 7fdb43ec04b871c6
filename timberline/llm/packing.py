"""Best-fit packing into sequences of several permitted lengths.

Pieces are placed from the longest down, each into the open bin, of whatever
length, that it fills best. Where none has room, a bin of the length with the
least cost per token that can still come into it is opened. At the end every
bin shrinks to the cheapest permitted length that holds its contents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library_codec
from .common import map_arrow, materialise

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces packed together, at least (but for the last group of a task); what is lost at a group's end is a few bins.
GROUP = 1 << 16


@dataclass(frozen=True)
class BinCosts:
    """Permitted lengths and the cost of a sequence: its length, plus attention, plus a fixed part."""

    lengths: tuple[int, ...] = LENGTHS
    attention: float = 1 / 32768
    fixed: float = 8.0
    cost: dict[int, float] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if not self.lengths or min(self.lengths) < 1:
            raise ValueError("lengths must be positive")
        object.__setattr__(self, "lengths", tuple(sorted(set(self.lengths))))
        object.__setattr__(self, "cost", {c: c + self.attention * c * c + self.fixed for c in self.lengths})

    def opened(self, size: int, waiting: int) -> int:
        """Length to open for a piece of ``size`` when ``waiting`` tokens, its own included, are unplaced."""
        return min((c for c in self.lengths if c >= size), key=lambda c: (self.cost[c] / min(c, waiting), -c))

    def shrunk(self, used: int) -> int:
        return min((c for c in self.lengths if c >= used), key=lambda c: (self.cost[c], c))


def pack(sizes, costs: BinCosts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and final length of the bin, for each size (1 to the greatest length)."""
    sizes = np.asarray(sizes, dtype=np.int64)
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(max(costs.lengths) + 1)]  # open bins by free tokens
    mask, used, waiting = 0, [], int(sizes.sum())
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        # Bit n of the mask says that a bin with n free tokens is open; the lowest from `size` on fits best.
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, own = costs.opened(size, waiting), len(used)
            used.append(0)
        bins[at], offsets[at] = own, used[own]
        used[own] += size
        waiting -= size
        if free > size:
            room[free - size].append(own)
            mask |= 1 << (free - size)
    final = np.array([costs.shrunk(u) for u in used], dtype=np.int64)
    return bins, offsets, final[bins] if len(used) else bins


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """``(id, n_tokens)`` per row by byte-level BPE; null counts as empty."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        own = library_codec(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.count(t or "") for t in batch.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    return map_arrow(df.select(F.col(id_col).alias("id"), text_col), run, f"id {id_type}, n_tokens long")


def pack_lengths(lengths: DataFrame, id_col: str = "id", length_col: str = "n_tokens", costs: BinCosts | None = None) -> DataFrame:
    """``(id_col, piece, start, length, bin_id, bin_offset, capacity)``: every token has its place.

    Documents longer than the greatest permitted length are cut into pieces of
    it. A document without tokens (or with a null length) is one row of length
    0 whose bin is null. Equal rows and null ids are packed like any other, ties
    in size go by the rows' order, extra columns are not read. An empty table
    gives an empty result. A task packs its rows in groups of GROUP pieces, so
    there is no shuffle and memory is bounded. Bins therefore depend on how rows
    lie in files; a written table as input keeps them the same when a task is
    run again.
    """
    costs = costs or BinCosts()
    top = max(costs.lengths)
    id_type = lengths.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, piece int, start long, length int, bin_id long, bin_offset int, capacity int"

    def run(batches):
        from pyspark import TaskContext

        place, serial = TaskContext.get().partitionId(), 0

        def packed(ids, n, groups):
            nonlocal serial
            pieces = np.maximum(1, -(-n // top))
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[owner] - piece * top, top)
            for part in np.array_split(np.stack([owner, piece, size]), groups, axis=1):
                full = part[2] > 0
                bins, offsets, capacity = pack(part[2][full], costs)
                spread = lambda values, full=full: pa.array(_scatter(values, full), mask=~full)
                serial += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(part[0])), pa.array(part[1].astype(np.int32)), pa.array(part[1] * top), pa.array(part[2].astype(np.int32)),
                        spread(bins + (place << 40) + (serial << 20)), spread(offsets.astype(np.int32)), spread(capacity.astype(np.int32)),
                    ],
                    [id_col, "piece", "start", "length", "bin_id", "bin_offset", "capacity"],
                )

        ids, sizes, waiting = [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            sizes.append(np.array([x or 0 for x in batch.column(1).to_pylist()], dtype=np.int64))
            waiting += int(np.maximum(1, -(-sizes[-1] // top)).sum())
            if waiting >= GROUP:
                yield from packed(pa.concat_arrays(ids), np.concatenate(sizes), waiting // GROUP)
                ids, sizes, waiting = [], [], 0
        if waiting:
            yield from packed(pa.concat_arrays(ids), np.concatenate(sizes), 1)

    return map_arrow(lengths.select(id_col, length_col), run, schema)


def _scatter(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), dtype=values.dtype)
    out[where] = values
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", costs: BinCosts | None = None, vocab_path: str | None = None) -> DataFrame:
    """:func:`pack_lengths` for the token counts of ``df``'s texts."""
    lengths = materialise(token_lengths(df, id_col, text_col, vocab_path).withColumnRenamed("id", id_col), "lengths")
    return pack_lengths(lengths, id_col, "n_tokens", costs)
