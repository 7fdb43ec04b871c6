import base64
import hashlib
import random
import time

import public_tokenizers as tokenizers
import pytest
import tiktoken

from timberline.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.codec()


@pytest.fixture(scope="module")
def other(own):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_minimal_perfect_hash_is_minimal_and_perfect(own):
    slots = {own.hash.slot(key) for key in own.ranks}
    assert slots == set(range(len(own.ranks)))
    for n in (0, 1, 2, 3, 17):
        keys = [bytes([65 + i]) for i in range(n)]
        if n:
            assert sorted(map(bpe.MinimalPerfectHash(keys).slot, keys)) == list(range(n))


def test_agrees_with_the_library_on_hard_texts(own, other):
    draw = random.Random(7)
    alphabet = " \n\t\r  ab'sT1½é漢😀.!\x1c\x85\xa0 ​_-<|"
    texts = ["", " ", "  ", " \n ", "x  ", "  x", "a" * 3000, "a b" * 40000, "it's I'LL", *["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(3000)]]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert own.count(text) == len(ids)


def test_blocks_do_not_change_the_ids(own, other, monkeypatch):
    monkeypatch.setattr(bpe.ByteBPE, "BLOCK", 3)
    for text in ("a b c d e f g h", "a  b c \n d e  f", " a b c d", "one two three four five six seven  eight nine"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_long_runs_take_linear_time(own, other):
    began = time.time()
    for run in (" ", "\n", " \n"):
        text = "a" + run * (1_500_000 // len(run)) + "b"
        ids = own.encode(text)
        assert own.decode(ids) == text.encode()
        assert bpe.library_codec().count(text) == len(ids)
    # A quadratic way takes several times this for each.
    assert time.time() - began < 60
    text = "b" + " " * 70_000 + "x\n" * 70_000
    assert bpe.library_codec().encode(text) == own.encode(text) == other.encode_ordinary(text)


def test_memo_forgets_but_stays_right(other, monkeypatch):
    monkeypatch.setattr(bpe.ByteBPE, "MEMO", 4)
    small = bpe.ByteBPE(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    text = " ".join(f"word{i % 13}" for i in range(200))
    assert small.encode(text) == other.encode_ordinary(text)
    assert len(small.piece) <= 4


def test_round_trip_of_a_table(spark, other):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "null id"), (5, "twice"), (5, "twice"), (6, "long " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=str)
    want = []
    for i, text in rows:
        ids = other.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = bpe.encode_documents(df)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode_documents(coded).collect()}
    assert back[1] == "Hello  world" and back[2] == "" and back[6] == "long " * 50000
    assert bpe.round_trip(df.limit(0)).count() == 0
