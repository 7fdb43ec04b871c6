import corpus_pipeline
from tests.llm.test_language_id import rows as language_rows
from tests.llm.test_minhash import brute as near_brute
from timberline.llm.bpe import codec


def lower(text):
    """A-Z only, as the operator has it."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_stages_against_brute_force(spark, tmp_path):
    docs = language_rows(60, 4)
    docs += [(200 + i, docs[i][1], docs[i][2]) for i in range(5)]  # exact copies
    docs += [(300 + i, docs[i][1].upper(), None) for i in range(5, 8)]  # equal but for case
    docs += [(400 + i, docs[i][1] + " tail", docs[i][2]) for i in range(20, 26)]  # near copies, if long enough
    docs += [(500, None, "xx"), (501, "", "xx"), (502, "12 34 !", "yy")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, row int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    letters = [(i, t) for i, t, _ in docs if any(c.isalpha() for c in t or "")]
    best = {}
    for i, t in letters:
        best[lower(t)] = max(i, best.get(lower(t), -1))
    exact = [(i, t) for i, t in letters if best[lower(t)] == i]
    near = {i for i, _, _, kept in near_brute(exact, 5, 80) if kept}
    want = [{i for i, _ in letters}, {i for i, _ in exact}, near]
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, out, str(tmp_path))
        assert out.columns == df.columns
        found = [r["doc_id"] for r in out.collect()]
        assert set(found) == ids and len(found) == len(ids)
    texts = {i: t for i, t, _ in docs}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i in near:
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == codec().count(texts[i])
    assert {r["doc_id"] for r in packed} == near


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
