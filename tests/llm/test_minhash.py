import random
import re

import numpy as np

from timberline.llm import minhash


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    """Component of each row by comparing everything with everything."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(shingles(t, k)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows), key=str)


def corpus(n, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnop") + draw.choice("qrst")
    base = [[word() for _ in range(draw.randrange(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.choice((0, 0, 1, 1, 2, 3, 6))):
            words[draw.randrange(len(words))] = word()
        rows.append((i, draw.choice((" ", "\n", "\t ")).join(words)))
    return rows


EDGE = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "É one two"), (1007, "é one two"), (1008, "w " * 30000), (1009, "w " * 40000), (None, "one two"), (1010, "a\x0bb c\x1fd e"), (1011, "a b\tc\x1fd e")]


def run(spark, data, **options):
    df = spark.createDataFrame([(*r, 1, b"") for r in data], "doc_id long, text string, n long, key binary")
    return sorted(map(tuple, minhash.near_duplicates(df, **options).collect()), key=str)


def test_components_are_those_of_all_pairs(spark):
    rows = corpus(150, 1) + EDGE
    assert run(spark, rows, words=3, percent=85) == brute(rows, 3, 85)


def test_large_buckets_need_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "MANY", 4)
    data = corpus(40, 2)
    assert run(spark, data, words=2, percent=80, rows=2, miss=1e-6) == brute(data, 2, 80)


def test_a_crowd_around_one_text(spark, monkeypatch):
    draw = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(45):
        words = list(base)
        for _ in range(draw.choice((1, 2, 3, 4, 5, 6, 8))):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice(([], ["x"], [f"u{draw.randrange(9)}"], [f"u{i}", "y"]))
        data.append((i, " ".join(words)))
    for few, many, words, percent in ((2, 12, 3, 85), (2, 4096, 5, 80)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "MANY", many)
        assert run(spark, data, words=words, percent=percent) == brute(data, words, percent)


def test_parts_of_one_text(spark, monkeypatch):
    """Members that have all their shingles in the hub, and are partners of each other but not of the hub."""
    monkeypatch.setattr(minhash, "FEW", 1)
    base = [f"w{i}" for i in range(100)]
    data = [(0, " ".join(base))]
    for i in range(1, 30):
        at = (i * 7) % 36
        data.append((i, " ".join(base[at : at + 64 + i % 5])))
    assert run(spark, data, words=3, percent=85) == brute(data, 3, 85)


def test_parity_maps_never_differ_in_more_bits_than_sets_in_elements():
    draw = np.random.default_rng(5)
    for size in (1, 30, 3000):
        pool = draw.integers(0, 1 << 63, size + 50, dtype=np.uint64)
        a, b = pool[:size], pool[draw.integers(0, 50) :]
        bits = int(np.unpackbits((minhash.parity_map(a) ^ minhash.parity_map(b)).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_min_max_estimate_is_unbiased_and_of_lower_variance():
    draw = np.random.default_rng(3)
    hasher = minhash.MinMaxHasher(bands=200, rows=2)  # 200 permutations, 400 entries
    both, low = [], []
    for _ in range(30):
        pool = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = hasher.signature(pool[:750]), hasher.signature(pool[250:])
        both.append((a == b).mean())
        low.append((a[:, 0] == b[:, 0]).mean())
    assert abs(np.mean(both) - 0.5) < 0.02
    assert np.var(both) < np.var(low)


def test_blocks_do_not_change_a_signature(monkeypatch):
    hasher = minhash.MinMaxHasher(4)
    values = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = hasher.keys(values)
    monkeypatch.setattr(minhash.MinMaxHasher, "BLOCK", 7)
    assert (hasher.keys(values) == whole).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_survivors(spark):
    rows = corpus(80, 4) + EDGE
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _gone_id string")
    kept = {r["doc_id"] for r in minhash.deduplicate(df, words=3, percent=85).collect()}
    assert kept == {i for i, _, _, k in brute(rows, 3, 85) if k}
