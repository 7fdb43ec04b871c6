import random

from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import line_dedup as ld


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=12))
def test_longest_increasing(values):
    found = ld.longest_increasing(values)
    picked = [values[n] for n in found]
    assert found == sorted(set(found)) and all(p < q for p, q in zip(picked, picked[1:]))
    best = max((bin(m).count("1") for m in range(1 << len(values)) if (x := [v for n, v in enumerate(values) if m >> n & 1]) == sorted(set(x))), default=0)
    assert len(found) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30))
def test_increasing_parts(values):
    parts = ld.increasing_parts(values)
    assert sorted(n for part in parts for n in part) == list(range(len(values)))
    for part in parts:
        assert part == sorted(part) and all(values[p] < values[q] for p, q in zip(part, part[1:]))
    # As few as the longest run that never increases is long.
    best = [1] * len(values)
    for n in range(len(values)):
        best[n] = 1 + max((best[m] for m in range(n) if values[m] >= values[n]), default=0)
    assert len(parts) == max(best, default=0)


def test_blocks_of_a_pair():
    # Lines 10-13 of the earlier document stand at 2-5, line 40 after them, line 5 was moved behind both, and all is said twice.
    runs = [(2, 4, 10), (3, 5, 11), (4, 6, 12), (8, 9, 40), (9, 10, 5), (20, 22, 10)]
    assert ld.align(*map(list, zip(*runs))) == [(2, 6, 10), (8, 9, 40), (9, 10, 5), (20, 22, 10)]


def plain(text):
    """Text without lines, by positions."""
    return lambda gone: None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def test_documents(spark):
    draw = random.Random(3)
    passage = [f"passage line {i} with quite a few words in it to be long enough" for i in range(6)]
    rows = []
    for i in range(60):
        own = [" ".join(draw.choice("abcdefgh") * 3 + str(draw.randrange(50)) for _ in range(draw.randrange(0, 9))) for _ in range(draw.randrange(1, 12))]
        if draw.random() < 0.5:
            at = draw.randrange(len(own) + 1)
            own[at:at] = passage[draw.randrange(4) :]
        if draw.random() < 0.6:
            own.append("a very common line of the whole corpus, as licences have")
        rows.append((i, "\n".join(own)))
    rows += [(101, ""), (102, "\n\n"), (103, "\n".join(["  " + x + " " for x in passage])), (104, "x " * 100000), (105, rows[0][1]), (106, "\n".join(passage) + "\n" + "\n".join(passage))]
    wanted = all_pairs(rows)
    odd = [(100, None), (None, "\n".join(passage))]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows + odd], "doc_id long, text string, mark int, blocks string")
    got = {r["doc_id"]: r for r in ld.delete_repeats(df).collect()}
    for i, t in rows:
        assert list(got[i]["removed"]) == wanted[i] and got[i]["text"] == plain(t)(wanted[i]) and got[i]["n_lines"] == len(t.split("\n"))
        texts = dict(rows)
        assert sorted({n for b in got[i]["blocks"] for n in range(b["start"], b["end"])}) == wanted[i]
        for b in got[i]["blocks"]:
            lines = lambda k, at, n: [x.strip(" ") for x in texts[k].split("\n")[at : at + n]]
            assert b["other"] < i and lines(i, b["start"], b["end"] - b["start"]) == lines(b["other"], b["other_start"], b["end"] - b["start"])
    assert (got[100]["text"], got[100]["n_lines"], got[None]["removed"]) == (None, 0, [])
    assert sum(map(bool, wanted.values())) > 10
    assert ld.delete_repeats(df.limit(0)).count() == 0


def all_pairs(rows):
    """Lines of common runs of 20 words, by comparing every pair of documents line by line."""
    docs = {i: [x.strip(" ") for x in t.split("\n")] for i, t in rows}
    out = {i: set() for i in docs}
    for later, b in docs.items():
        for earlier, a in docs.items():
            for i in range(len(a) if earlier < later else 0):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in b[j : j + n]) >= 20:
                        out[later] |= set(range(j, j + n))
    return {i: sorted(g) for i, g in out.items()}


def removed(spark, rows):
    return {r["doc_id"]: list(r["removed"]) for r in ld.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_every_pair_of_documents_is_compared(spark):
    draw = random.Random(5)
    frequent = [f"frequent line {i} of about seven words" for i in range(8)] + ["", "short"]
    rows = [(i, "\n".join(draw.choice(frequent) for _ in range(draw.randrange(1, 9)))) for i in range(60)]
    # The lines of 230's passage have other first holders, and are frequent.
    rows += [(-3, "p " * 10 + "\nx"), (-2, "q " * 10 + "\ny"), *[(k, f"{'p ' * 10}\n{k}\n{'q ' * 10}") for k in range(200, 220)], (100, "u\n" + "p " * 10 + "\n" + "q " * 10), (230, "p " * 10 + "\n" + "q " * 10 + "\nv")]
    wanted = all_pairs(rows)
    assert removed(spark, rows) == wanted
    assert wanted[230] == [0, 1] and sum(map(bool, wanted.values())) > 10


def test_short_lines_and_scripts_without_blanks(spark):
    verse = "\n".join(f"word{i}" for i in range(30))
    han = "\n".join(chr(0x4E00 + 10 * i) * 8 for i in range(3))
    thai = "\n".join("กิน" * 4 for _ in range(3))
    rows = [(1, verse), (2, "new\n" + verse), (3, han), (4, "a\n" + han + "\nb"), (5, thai), (6, thai), (7, "一" * 10), (8, "一" * 10), (9, "so\nfew\nlines"), (10, "so\nfew\nlines")]
    assert removed(spark, rows) == {1: [], 2: list(range(1, 31)), 3: [], 4: [1, 2, 3], 5: [], 6: [0, 1, 2], 7: [], 8: [], 9: [], 10: []}


def test_holders_of_single_lines_hide_no_overlap(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(12)) for c in "xy")
    rows = [(1, x), (2, y), (3, f"{x}\n{y}"), (4, f"a\n{x}"), (5, f"{y}\nb"), (6, f"{x}\n{y}")]
    assert removed(spark, rows) == {1: [], 2: [], 3: [], 4: [], 5: [], 6: [0, 1]} == all_pairs(rows)


def test_passages_said_twice(spark):
    p = " ".join(f"w{i}" for i in range(25))
    q = [" ".join(f"{c}{i}" for i in range(12)) for c in "klm"]
    rows = [(1, f"x\n{p}\ny"), (2, f"a\n{p}\nb\n{p}\nc"), (3, "\n".join(["x", *q, "y"])), (4, "\n".join(["a", *q, "b", *q, "c"]))]
    assert removed(spark, rows) == {1: [], 2: [1, 3], 3: [], 4: [1, 2, 3, 5, 6, 7]}
