import hashlib

from pyspark.sql import functions as F

from timberline.llm import exact_dedup


def brute(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), i == top, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = " ".join(f"word{i} and a bit of text" for i in range(3000))
ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, LONG), (7, LONG.upper()), (8, LONG + "!"), (9, "É"), (10, "é"), (11, "a" * 20000), (12, "a" * 20001), (13, "漢字" * 5000), (14, "漢字" * 5000), (15, "twice"), (15, "twice"), (None, "no id"), (None, "same text"), (16, "alone")]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, kept int, recipe string")
    got = sorted(map(tuple, exact_dedup.annotate(df, **options).collect()), key=str)
    assert got == brute(rows)


def test_groups(spark):
    check(spark, ROWS)


def test_colliding_hashes_change_nothing(spark):
    check(spark, ROWS, hasher=lambda c: F.pmod(F.xxhash64(c), F.lit(2)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.annotate(df).count() == 0
    assert exact_dedup.deduplicate(df).count() == 0


def test_chunks_cover_the_text_and_follow_its_content(spark):
    text = LONG.lower()
    df = spark.createDataFrame([(text,), ("inserted " + text,), ("x" * 9000,)], "t string").select("t", F.transform(exact_dedup.chunks_of(F.col("t")), lambda c: c.cast("string")).alias("c")).collect()
    for row in df:
        assert "".join(row["c"]) == row["t"] and max(map(len, row["c"])) <= exact_dedup.MAX_CHUNK
    shared = set(df[0]["c"]) & set(df[1]["c"])
    assert len(shared) > 0.8 * len(set(df[0]["c"]))


def test_survivors_have_different_texts(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, _row_key string, row int")
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    texts = [(r["text"] or "") for r in out.collect()]
    norm = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts]
    assert len(set(norm)) == len(norm) == len({x[4] for x in brute(ROWS)})


def test_cuts_follow_the_content_of_any_alphabet(spark):
    import random

    draw = random.Random(4)
    han = [chr(c) for c in range(0x4E00, 0x9FA0)]
    kinds = {
        "han": han, "cyrillic": [chr(c) for c in range(0x430, 0x450)] + [" "], "greek": [chr(c) for c in range(0x3B1, 0x3CA)], "astral": [chr(c) for c in range(0x20000, 0x22000)],
        "base64": [*"abcdefghijklmnopqrstuvwxyz0123456789+/"], "digits": [*"0123456789"], "nucleotides": [*"acgt"], "mixed": han[:500] + [*"abcdefghijklmnopqrstuvwxyz     "] * 10,
    }
    texts = {k: "".join(draw.choice(a) for _ in range(40_000)) for k, a in kinds.items()}
    rows = [(k, *[x for x in (t, t[:1] + t[:20_000] + t[5:6] * 3 + t[20_000:])]) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "kind string, a string, b string")
    for r in df.select("kind", exact_dedup.chunks_of(F.col("a")).alias("a"), exact_dedup.chunks_of(F.col("b")).alias("b")).collect():
        assert len(r["a"]) > 10 and len(set(map(bytes, r["a"])) & set(map(bytes, r["b"]))) > 0.8 * len(r["a"]), r["kind"]


def test_texts_in_one_encoding_are_not_those_of_another(spark):
    wide = "\u6162" * 30
    check(spark, [(1, "ab" * 30), (2, wide), (3, wide), (4, "一" * 30_000), (5, "一" * 30_000), (6, "一" * 29_999)])
