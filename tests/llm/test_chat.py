import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm.chat import ChatTemplate, digest_formatted, format_conversations, loss_mask

T = ChatTemplate()
PARTS = st.lists(st.sampled_from([*T.guarded, T.start, T.sep, T.end, "\\", "<", "|", "[", "ok", "\n", " ", "é", "\0"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), PARTS), PARTS), max_size=5))
def test_rendering_is_reversible(turns):
    formatted, _ = T.render(turns)
    assert T.parse(formatted) == turns


def test_no_control_string_is_left():
    for bad in (*T.guarded, T.start, T.sep, T.end):
        for text in (bad, bad + bad, "<" + bad, bad[:-1] + bad):
            assert not any(c in T.escape(text) for c in (*T.guarded, T.start, T.sep, T.end))


def test_mask_by_binary_search():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 9), (9, 10)])
    for spans in ([], [(2, 5)], [(0, 1), (9, 10)], [(4, 6)], [(0, 10)]):
        want = [any(a < e and b > s for s, e in spans) for a, b in offsets]
        got = loss_mask(offsets, spans)
        assert [bool(g) for g, (a, b) in zip(got, offsets) if a < b] == [w for w, (a, b) in zip(want, offsets) if a < b]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "\n Ünï  \\ "), (2, 0, "assistant", ""), (2, None, None, "x"), (3, 0, "user", "q"), (3, 1, "assistant", "a. " * 30000), (None, 5, "assistant", "no id"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    out = format_conversations(df)
    got = {r["conv_id"]: r for r in digest_formatted(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        under = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    for r in out.collect():
        assert len(r["ids"]) == len(r["mask"])
    assert format_conversations(df.limit(0)).count() == 0
