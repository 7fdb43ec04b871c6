import random

import numpy as np
import pytest

from timberline.llm import token_counts as tc
from timberline.llm.bpe import codec
from timberline.session import shared_path


def brute(tokens, separator):
    out, n = [], 0
    for t in tokens:
        if t == separator:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * bool(n)


def write(path, files):
    for shard, tokens in files.items():
        (path / "kind=tokens").mkdir(parents=True, exist_ok=True)
        (path / "kind=tokens" / f"part-{shard}").write_bytes(np.array(tokens, dtype="<u2").tobytes())


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_documents_across_blocks(spark, tmp_path, block):
    draw = random.Random(block)
    files = {s: [draw.choice((0, 5, 9, 9, 0x0900, 0x0009)) for _ in range(draw.randrange(1, 60))] for s in range(4)}
    files[4], files[5], files[6] = [9, 9, 9], [1, 2, 3], []
    write(tmp_path, files)
    got = {}
    for r in tc.count_tokens(spark, str(tmp_path), 9, block).collect():
        got.setdefault(int(r["shard"].removeprefix("part-")), {})[r["nth"]] = r["n_tokens"]
    for s, tokens in files.items():
        want = brute(tokens, 9)
        assert got.get(s, {}) == dict(enumerate(want))


def test_counts_by_document(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "null id"), (5, "twice"), (5, "twice"), (6, "long " * 50000), (7, "PÄ" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    for file_rows in (tc.FILE_ROWS, 3):
        out = tc.document_token_counts(df.repartition(2), shared_path(spark, "tokens"), file_rows=file_rows)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, codec().count(t or "")) for i, t in rows), key=str)
    assert tc.document_token_counts(df.limit(0), shared_path(spark, "tokens")).count() == 0


def test_odd_files_are_refused(spark, tmp_path):
    (tmp_path / "kind=tokens").mkdir()
    (tmp_path / "kind=tokens" / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="even number"):
        tc.count_tokens(spark, str(tmp_path)).collect()


def test_repeats_are_spread_over_files(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("CAST(NULL AS string) AS doc_id", "CAST(NULL AS string) AS text")
    places = tc.write_token_files(df, shared_path(spark, "tokens"), file_rows=100)
    assert max(r["count"] for r in places.groupBy("shard").count().collect()) <= 100
    assert places.filter("doc_id IS NULL").count() == 1000
