import random

import numpy as np
import pytest

from timberline.llm import packing
from timberline.llm.bpe import codec


def naive(sizes, costs):
    """Best fit by looking at every open bin; of equal ones the last touched."""
    bins = []
    waiting = sum(sizes)
    for turn, size in enumerate(sorted(sizes, reverse=True)):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            own = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            own = [costs.opened(size, waiting), 0, 0]
            bins.append(own)
        own[1] += size
        own[2] = turn
        waiting -= size
    return sorted((costs.shrunk(b[1]), b[1]) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_same_bins_as_a_search_of_all_bins(seed):
    draw = random.Random(seed)
    costs = packing.BinCosts((10, 25, 60), fixed=draw.choice((0.0, 3.0)), attention=draw.choice((0.0, 0.01)))
    sizes = [draw.randrange(1, 61) for _ in range(draw.randrange(1, 200))]
    bins, offsets, capacity = packing.pack(sizes, costs)
    used = {}
    for s, b, o, c in zip(sizes, bins, offsets, capacity):
        used.setdefault(int(b), (int(c), []))[1].append((int(o), s))
    for c, parts in used.values():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at <= c and c == costs.shrunk(at)
    assert sorted((c, sum(s for _, s in p)) for c, p in used.values()) == naive(sizes, costs)


def test_lengths_are_used_together():
    costs = packing.BinCosts((512, 1024, 2048, 4096))
    rng = np.random.default_rng(1)
    sizes = np.minimum(4096, rng.lognormal(6, 1, 5000).astype(int) + 1)
    _, _, capacity = packing.pack(sizes, costs)
    bins, offsets, capacity = packing.pack(sizes, costs)
    total = sum(capacity[np.unique(bins, return_index=True)[1]])
    assert sizes.sum() / total > 0.98


def test_every_token_has_a_place(spark):
    rows = [(1, "a short text"), (2, None), (3, ""), (4, "word " * 9000), (None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bin_id int")
    out = packing.pack_documents(df).collect()
    for i, text in rows:
        n = codec().count(text or "")
        own = [r for r in out if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == n * sum(1 for x in rows if x[0] == i)
        assert all((r["bin_id"] is None) == (r["length"] == 0) for r in own)
    long = sorted((r for r in out if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert [r["start"] for r in long] == [4096 * i for i in range(len(long))] and len(long) > 1
    bins = {}
    for r in out:
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    for (_, c), parts in bins.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= c
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_groups_span_arrow_batches(spark):
    draw = random.Random(8)
    sizes = [draw.randrange(1, 900) for _ in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, n_tokens long").coalesce(1)
        out = packing.pack_lengths(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    _, _, capacity = packing.pack(sizes, packing.BinCosts())
    bins, _, _ = packing.pack(sizes, packing.BinCosts())
    assert len({r["bin_id"] for r in out}) == len(set(bins.tolist()))
    assert sum({r["bin_id"]: r["capacity"] for r in out}.values()) == sum(capacity[np.unique(bins, return_index=True)[1]])


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.BinCosts(())
