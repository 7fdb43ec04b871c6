"""Every registered query of the subpackage, called on one small folder of tables."""

import base64
import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_line_dedup import all_pairs
from tests.llm.test_minhash import brute as near_brute
from timberline.llm import queries

LONG = "Ein sehr langer Text " * 3000


def documents():
    draw = random.Random(12)
    words = {"de": "der und nicht ein Haus für über ging Strasse wenn".split(), "en": "the and not a house for over went street if".split()}
    rows = []
    for i in range(40):
        lang = draw.choice(("de", "en"))
        rows.append((i, "\n".join(" ".join(draw.choice(words[lang]) + str(draw.randrange(30)) for _ in range(draw.randrange(3, 12))) for _ in range(draw.randrange(1, 9))), lang))
    rows += [(50 + i, rows[i][1], rows[i][2]) for i in range(4)] + [(60 + i, rows[i][1].upper(), None) for i in range(4)] + [(70 + i, rows[i][1] + " tail", rows[i][2]) for i in range(8)]
    return rows + [(90, None, "de"), (91, "", "en"), (92, "12 !", None), (93, LONG, "de"), (94, LONG + "Ende", "de"), (95, "x\n" + "\n".join(r[1] for r in rows[:3]), None)]


DOCS = documents()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, draw = tmp_path_factory.mktemp("tables"), random.Random(3)
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k") for i, t, lang in DOCS], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{folder}/documents.parquet")
    turns = [(c, t, draw.choice(("user", "assistant", "system", None)), draw.choice(("hi", "", None, "<|turn|> \\ </s>", "é漢 [INST]"))) for c in range(12) for t in range(draw.randrange(1, 5))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200, None), (250, [1.0] * 5 + [float("nan")]), (300, [0.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def compared(tables, got, sql):
    with duckdb.connect() as db:
        for name in ("documents", "conversations", "embeddings"):
            db.sql(f"CREATE VIEW {name} AS FROM '{tables}/{name}.parquet/*.parquet'")
        want = db.sql(sql)
        assert sorted(want.columns) == sorted(got.columns)
        rows = db.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", ["op2_chat", "op8_topk", "op10_exact_dedup"])
def test_agrees_with_its_sql(spark, tables, name):
    compared(tables, queries.queries()[name](spark, tables), queries.oracle_sql()[name])


def test_near_duplicates(spark, tables):
    got = queries.op3_minhash(spark, tables)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == near_brute([(i, t) for i, t, _ in DOCS], 3, 85)


@pytest.fixture(scope="module")
def tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: own.encode_ordinary(t or "") for i, t, _ in DOCS}


def test_tokens(spark, tables, tokens):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op7_bpe(spark, tables).collect()}
    assert got == {i: (len(tokens[i]), hashlib.sha256(" ".join(map(str, tokens[i])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in DOCS}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, tables).collect()} == {i: len(x) for i, x in tokens.items()}
    packed = {}
    for r in queries.op5_packing(spark, tables).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: len(x) for i, x in tokens.items()}


def test_languages(spark, tables):
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, tables).collect()}
    assert set(got) == {i for i, _, _ in DOCS}
    for i, text, lang in DOCS:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if lang and r["held_out"] and r["lang_pred"] != "und":
            assert r["lang_pred"] == lang


def test_passages(spark, tables):
    texts = [(i, t) for i, t, _ in DOCS if t is not None]
    gone = all_pairs(texts)
    assert gone[95] and gone[50]
    got = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, tables).collect()}
    assert set(got) == {i for i, _, _ in DOCS} and got[90]["kept_sha256"] is None
    for i, text in texts:
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i])
        assert (got[i]["n_removed"], got[i]["kept_chars"], got[i]["kept_sha256"]) == (len(gone[i]), len(left), hashlib.sha256(left.encode()).hexdigest())
