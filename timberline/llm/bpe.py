"""Byte-level BPE: encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a vocabulary entry costs one hash, one displacement and one comparison.
Tier two, for the rest, merges by rank with a heap over linked bytes, which is
O(n log n) however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import Memo, map_arrow

_MASK = (1 << 64) - 1
#: Odd multipliers of the splitmix64 finaliser (fixed values).
_GOLDEN, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * _MIX_A) & _MASK
    x = ((x ^ (x >> 27)) * _MIX_B) & _MASK
    return x ^ (x >> 31)


def _mix_many(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_B)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Hash-and-displace over a fixed set of byte strings: n keys, n slots.

    Keys fall into n/4 buckets. Buckets are placed from the largest down, each
    by the first displacement that sends all its keys to free slots; a bucket
    of one key stores its slot outright (as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        owner = ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(counts)))
        displace = np.zeros(self.buckets, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        slot_of = np.empty(n, dtype=np.int64)
        singles = []
        for b in np.argsort(-counts, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            first = 0
            while True:
                d = np.arange(first, first + 128, dtype=np.uint64)
                slots = (_mix_many(hashes[own][None, :] ^ (d * np.uint64(_GOLDEN))[:, None]) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    displace[b] = first + at
                    slot_of[own] = slots[at]
                    free[slots[at]] = False
                    break
                first += 128
        left = np.flatnonzero(free)
        for (b, key), slot in zip(singles, left, strict=True):
            displace[b] = -int(slot) - 1
            slot_of[key] = slot
        self.displace = displace.tolist()
        self.slot_of = slot_of

    def slot(self, key: bytes) -> int:
        """The slot of ``key``; for a stranger, some slot, so compare."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[(h >> 32) % self.buckets]
        return -d - 1 if d < 0 else _mix(h ^ ((d * _GOLDEN) & _MASK)) % self.size


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one rank file."""

    #: Pieces between spaces remembered per generation (two generations).
    MEMO = 500_000
    #: Pieces encoded at a time, which bounds memory for very long texts.
    BLOCK = 1 << 16

    def __init__(self, vocab_path: str, pattern: str):
        self.ranks = read_ranks(vocab_path)
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slots: list[tuple[bytes, tuple[int, ...]]] = [(b"", ())] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.slots[slot] = (key, (self.ranks[key],))
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for key, rank in self.ranks.items():
            self.token[rank] = key
        self.decimal = [str(i) for i in range(len(self.token))]
        self.pretokens = regex.compile(pattern).findall
        self.word = Memo(self._word, self.MEMO // 2)
        self.piece = Memo(self._piece, self.MEMO)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Tier two: repeatedly join the adjacent pair of least rank, leftmost first."""
        n, rank_of, push, pop = len(word), self.ranks.get, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank, start and end in one integer, so comparing is cheap.
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = []
        for i in range(n - 1):
            if (r := rank_of(word[i : i + 2])) is not None:
                heap.append((((r << bits) | i) << bits) | (i + 2))
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            end, i = entry & low, (entry >> bits) & low
            mid = after[i]
            if mid >= n or after[mid] != end:
                continue  # one of its parts has grown or is gone since
            after[mid], after[i] = n, end
            if end < n:
                before[end] = i
                if (r := rank_of(word[i : after[end]])) is not None:
                    push(heap, (((r << bits) | i) << bits) | after[end])
            if i and (r := rank_of(word[before[i] : end])) is not None:
                push(heap, (((r << bits) | before[i]) << bits) | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        key, ids = self.slots[self.hash.slot(data)]
        return ids if key == data else self.merge(data)

    def _run(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.word.__getitem__, self.pretokens(text))))

    def _piece(self, piece: str) -> tuple[int, ...] | str:
        """Ids of ``" " + piece``, or its text if spaces beside it could matter."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return piece
        return self._run(" " + piece)

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text``, in blocks.

        A single space between two other characters always starts a pre-token,
        so texts are cut there, and equal pieces are encoded once. Where a
        longer run of white space touches a cut, the pieces are joined again.
        """
        pieces = text.split(" ")
        held: list[str] | None = [pieces[0]]  # parts of a text that may still grow
        last = pieces[0][-1:]  # its last character
        for at in range(1, len(pieces), self.BLOCK):
            parts = list(map(self.piece.__getitem__, pieces[at : at + self.BLOCK]))
            if held is None and str not in set(map(type, parts)):
                yield list(chain.from_iterable(parts))
                continue
            out: list[int] = []
            for piece, ids in zip(pieces[at : at + self.BLOCK], parts, strict=True):
                if held is None:
                    if type(ids) is tuple:
                        out.extend(ids)
                    else:
                        held, last = [" ", piece], piece[-1:] or " "
                elif not last or last.isspace() or not piece or piece[0].isspace():
                    held += (" ", piece)
                    last = piece[-1:] or " "
                else:
                    out.extend(self._run("".join(held)))
                    if type(ids) is tuple:
                        out.extend(ids)
                        held = None
                    else:
                        held, last = [" ", piece], piece[-1:] or " "
            yield out
        if held:
            yield list(self._run("".join(held)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def count(self, text: str) -> int:
        return sum(map(len, self.blocks(text)))

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


class LibraryBPE(ByteBPE):
    """The same ids with the tiktoken library doing the merges: for operators that only need tokens.

    Runs of more than LONG characters without a single space between others go
    to the own encoder: the library fails on very long ones.
    """

    LONG = 1 << 16
    #: The library is fast enough for a smaller memo, which keeps workers small.
    MEMO = 150_000

    def __init__(self, vocab_path: str, pattern: str):
        import tiktoken

        self.ranks = read_ranks(vocab_path)
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._run = lambda text: tuple(encoding.encode_ordinary(text)) if len(text) <= self.LONG else codec(vocab_path, pattern)._run(text)
        self.piece = Memo(self._piece, self.MEMO)


@lru_cache(maxsize=2)
def library_codec(vocab_path: str | None = None, pattern: str | None = None) -> LibraryBPE:
    import public_tokenizers

    return LibraryBPE(vocab_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def codec(vocab_path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """One encoder per Python worker. Defaults: the installed public vocabulary."""
    import public_tokenizers

    return ByteBPE(vocab_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id_col, n_tokens, ids)`` for every row, ``ids`` as ``array<int>``; no shuffle.

    A null text is an empty one and has no tokens. Rows with equal or null ids
    are encoded one by one. A text of any length is encoded whole, in time in
    proportion to it. An empty table gives an empty result; extra columns are
    not read.
    """

    def run(batches):
        own = codec(vocab_path, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [id_col, "n_tokens", "ids"])

    slim = df.select(id_col, text_col)
    return map_arrow(slim, run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab_path: str | None = None) -> DataFrame:
    """``(id_col, data)``: the bytes that ``ids_col`` stands for; null ids give no bytes."""

    def run(batches):
        own = codec(vocab_path)
        for batch in batches:
            data = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    slim = df.select(id_col, ids_col)
    return map_arrow(slim, run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, data binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode again, and digest both: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``.

    Ids and decoded bytes are digested block by block where they are made, so
    neither leaves the worker. Same rules as :func:`encode_documents`; an empty
    text has 0 tokens and the digests of nothing.
    """

    def digest(own: ByteBPE, text: str) -> tuple[int, str, str]:
        n, ids_sha, data_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in own.blocks(text):
            if ids:
                ids_sha.update(((" " if n else "") + " ".join([own.decimal[i] for i in ids])).encode())
                data_sha.update(own.decode(ids))
                n += len(ids)
        return n, ids_sha.hexdigest(), data_sha.hexdigest()

    def run(batches):
        own = codec(vocab_path, pattern)
        for batch in batches:
            rows = [digest(own, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(id_col, text_col)
    return map_arrow(slim, run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
