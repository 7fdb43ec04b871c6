import random

import numpy as np
import pytest

from timberline.llm import language_id as li


def naive_phrases(text, sample):
    """Greedy cross parsing by substring search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(li, "SEGMENT", 1000)
    draw = random.Random(5)
    samples = {"a": "".join(draw.choice("abc ") for _ in range(300)), "b": "".join(draw.choice("bcd") for _ in range(200))}
    model = li.LanguageModel.train(samples)
    parser = li.Parser(model)
    coded = {k: "".join(chr(65 + x) for x in parser.symbols(v)) for k, v in samples.items()}
    texts = ["".join(draw.choice("abcde ") for _ in range(draw.randrange(1, 400))) for _ in range(40)]
    symbols = [parser.symbols(t) for t in texts]
    got = parser.phrases(symbols)
    for row, s in zip(got, symbols):
        plain = "".join(chr(65 + x) for x in s)
        assert list(row) == [naive_phrases(plain, coded["a"]), naive_phrases(plain, coded["b"])]


def test_automaton_knows_all_substrings():
    text = [1, 2, 1, 1, 3, 2, 1]
    table = li.suffix_automaton(text, 4)
    known = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for i in range(4**4):
        word = [(i >> 2 * k) & 3 for k in range(4)]
        for size in range(1, 5):
            state = 0
            for c in word[:size]:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(word[:size]) in known)


LANGS = {"xx": "ka ki ku ta ti tu", "yy": "bel bol gam gum lor mar", "zz": "ça été où père naïve"}


def rows(n, seed=1):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(LANGS[lang].split()) + draw.choice(LANGS[lang].split()) for _ in range(draw.randrange(6, 60))), lang) for i, lang in ((i, draw.choice(sorted(LANGS))) for i in range(n))]


def test_held_out_accuracy_and_edges(spark):
    data = rows(300)
    edge = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !?\n", "yy"), (None, "kaki tatu kuta", "xx"), (1003, "KAKI TATU kuta", None), (1004, "kaki " * 100000, None), (1005, "漢字", None)]
    df = spark.createDataFrame([(*r, "e") for r in data + edge], "doc_id long, text string, lang string, score string")
    model = li.LanguageModel.train(li.training_sample(df))
    assert model.names == sorted(LANGS)
    out = {r["doc_id"]: r for r in li.identify(df, model).collect()}
    import zlib

    unseen = [(i, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 40
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in unseen]) > 0.99
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, None, 1003, 1004)] == ["und", "und", "und", "xx", "xx", "xx"]
    assert out[1005]["lang_pred"] in LANGS
    assert all(0 <= r["score"] <= 1 for r in out.values())
    again = {r["doc_id"]: r for r in li.identify(df.repartition(7), model).collect()}
    assert again == out


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = li.LanguageModel.train(li.training_sample(df))
    assert [tuple(r)[:3] for r in li.identify(df, model).collect()] == [(1, "und", 0.0)]
    assert li.identify(df.limit(0), model).count() == 0


def test_held_out_rows_are_never_read(spark):
    import zlib

    data = rows(200)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = "\n".join(li.training_sample(df).values())
    assert not any(t in sample for i, t, _ in data if zlib.crc32(str(i).encode()) % 5 == 0)


@pytest.mark.parametrize("text", ["É", "ß", "ſ", "İ"])
def test_odd_letters_do_not_fail(text):
    assert li.Parser(li.LanguageModel.train({"a": "abc"})).predict([text])[0][0] == "a"


def spoken(lang, draw, words):
    """Words of two letters and more of an alphabet of 1,500 letters that no other language has."""
    base = (0x3400, 0x4E00, 0xAC00, 0x1200, 0xA000, 0x20000, 0x24000, 0xB600)[lang]
    letters = [c for c in map(chr, range(base, base + 3000)) if c.isalpha()][:1500]
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 6))) for _ in range(words))


def test_scripts_of_many_letters_stay_apart():
    draw = random.Random(9)
    model = li.LanguageModel.train({f"l{k}": spoken(k, draw, 3000) for k in range(8)})
    texts = [(f"l{k}", spoken(k, draw, 60)) for k in range(8) for _ in range(10)]
    found = li.Parser(model).predict([t for _, t in texts])
    assert [f[0] for f in found] == [lang for lang, _ in texts]


def test_acceptance_does_not_depend_on_the_number_of_languages(spark):
    draw = random.Random(10)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    own = {f"l{k:02d}": draw.sample(syllables, 12) for k in range(40)}
    say = lambda lang: " ".join(draw.choice(own[lang]) + draw.choice(own[lang]) for _ in range(40))
    data = [(i, say(lang), lang) for i, lang in enumerate(sorted(own) * 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = li.LanguageModel.train(li.training_sample(df))
    assert len(model.names) == 40 and int(model.sizes.sum()) <= li.TOTAL_CHARS
    assert li.accepted(df, model).count() == len(data)


def test_rows_that_are_accepted(spark):
    df = spark.createDataFrame([(1, "kaki tatu", "x", 1), (2, None, "x", 2), (3, "", "x", 3), (4, "12", "x", 4), (1, "kaki tatu", "x", 1), (None, "KAKI", None, 5)], "doc_id long, text string, lang string, score int")
    model = li.LanguageModel.train({"xx": "kaki tatu kuta", "yy": "bel bol gam"})
    assert sorted(map(tuple, li.accepted(df, model).collect()), key=str) == [(1, "kaki tatu", "x", 1), (1, "kaki tatu", "x", 1), (None, "KAKI", None, 5)]
    assert li.accepted(df, li.LanguageModel.train({})).count() == 0
