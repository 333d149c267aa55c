import random

import numpy as np
import pytest

from kinweave.functions.scoring import BLOSUM62, residue_codes
from kinweave.operators import align
from kinweave.operators.align import align_lists, align_pairs

F1 = ("WTHECK", "BETTERWORK")
F2 = ("SLPSMRADSFTKELMEKISS", "MTNKICIYAISKNEEKFV")
F3 = (F2[0] * 8, F2[1] * 8)
GOLDEN = [
    (F1, "both", "nw", (-14, 2, 6)), (F1, "both", "sg", (8, 1, 4)), (F1, "both", "sw", (11, 1, 1)),
    (F2, "both", "nw", (-15, 2, 20)), (F2, "both", "sg", (7, 2, 7)), (F2, "both", "sw", (10, 2, 7)),
    (F3, "neighbor", "nw", (-24, 22, 160)), (F3, "carried", "nw", (-24, 29, 165)), (F3, "both", "sg", (7, 2, 7)), (F3, "both", "sw", (11, 4, 17)),
]


@pytest.mark.parametrize(("pair", "mode", "kind", "expected"), GOLDEN)
def test_golden(pair, mode, kind, expected):
    for m in ("carried", "neighbor"):
        if mode in ("both", m):
            got = align_lists([pair[0]], [pair[1]], kind, stats_mode=m)[0]
            if pair is F1 and kind == "nw":
                assert got[0] == expected[0]
            else:
                assert tuple(got) == expected


def plain(a, b, kind, carried, open_=10, gap=1):
    """Cell by cell."""
    codes = residue_codes()
    a, b = ([codes[ord(c)] for c in s] for s in (a, b))
    m, n = len(a), len(b)
    edge = lambda k: 0 if kind != "nw" or k == 0 else -open_ - (k - 1) * gap
    none = (-(10**6), 0, 0)
    h = {(i, j): (edge(i + j), 0, 0) for i in range(m + 1) for j in range(n + 1) if not i or not j}
    d, e = {}, {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            def gapped(state, at):
                cell, before = h[at], state.get(at, none)
                opens = cell[0] - open_ >= before[0] - gap
                score = cell[0] - open_ if opens else before[0] - gap
                source = cell if opens or not carried else before
                return score, source[1], source[2] + 1

            d[i, j], e[i, j] = gapped(d, (i - 1, j)), gapped(e, (i, j - 1))
            nw = h[i - 1, j - 1]
            diagonal = nw[0] + int(BLOSUM62[a[i - 1], b[j - 1]]), nw[1] + (a[i - 1] == b[j - 1]), nw[2] + 1
            best = diagonal
            for other in (d[i, j], e[i, j]):
                if other[0] > best[0]:
                    best = other
            h[i, j] = (0, 0, 0) if kind == "sw" and best[0] <= 0 else best
    if kind == "nw":
        return h[m, n]
    if kind == "sg":
        if not m or not n:
            return 0, 0, 0
        order = [(i, n) for i in range(1, m)] + [(m, j) for j in range(1, n + 1)]
    else:
        order = [(i, j) for i in range(1, m + 1) for j in range(1, n + 1)]
    best = (0, 0, 0) if kind == "sw" else none
    for at in order:
        if h[at][0] > best[0]:
            best = h[at]
    return best


@pytest.mark.parametrize("kind", ["nw", "sg", "sw"])
@pytest.mark.parametrize("mode", ["carried", "neighbor"])
def test_against_cell_by_cell(kind, mode):
    rng = random.Random(len(kind + mode))
    word = lambda: "".join(rng.choices("ACDEGKW" if rng.random() < 0.5 else "ARNDCQEGHILKMFPSTWYVXUJO", k=rng.randint(0, 25)))
    left, right = [word() for _ in range(250)], [word() for _ in range(250)]
    got = align_lists(left, right, kind, stats_mode=mode)
    assert [tuple(map(int, g)) for g in got] == [tuple(map(int, plain(a, b, kind, mode == "carried"))) for a, b in zip(left, right, strict=True)]


def test_scores_are_ordered_and_symmetric():
    rng = random.Random(8)
    left, right = (["".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=rng.randint(1, 60))) for _ in range(200)] for _ in range(2))
    nw, sg, sw = (align_lists(left, right, k)[:, 0] for k in ("nw", "sg", "sw"))
    assert (sw >= sg).all() and (sg >= nw).all() and (sw >= 0).all()
    assert np.array_equal(sw, align_lists(right, left, "sw")[:, 0])
    own = align_lists(left, left, "sw")
    assert all(g[0] == sum(BLOSUM62[residue_codes()[ord(c)], residue_codes()[ord(c)]] for c in s) and g[1] == g[2] == len(s) for g, s in zip(own, left, strict=True))


def test_align_pairs(spark):
    df = spark.createDataFrame([(1, 2, *F1, "x"), (3, 4, None, "AB", "y"), (5, 6, "", "", "z")], "id1 long, id2 long, seq1 string, seq2 string, score string")
    got = {r["id1"]: (r["score"], r["matches"], r["length"]) for r in align_pairs(df, "sw").collect()}
    assert got == {1: (11, 1, 1), 3: (0, 0, 0), 5: (0, 0, 0)}
    with pytest.raises(ValueError):
        align_pairs(df, "sw", "pam250")
    with pytest.raises(ValueError):
        align_pairs(df, "xx")


@pytest.mark.parametrize("costs", [(10, 1), (3, 1), (2, 2), (11, 3)])
def test_long_sides_are_trimmed(monkeypatch, costs):
    """The part that is aligned holds the same alignment, ties and all; a long text costs little more than its match."""
    rng = random.Random(costs[0])
    left, right = [], []
    for _ in range(150):
        letters = rng.choice(["AC", "ACDE", "ARNDCQEGHILKMFPSTWYV"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 25)))
        inner = "".join(c for c in a if rng.random() < 0.9) + a[: rng.randint(0, 5)]
        left.append(a)
        right.append("".join(rng.choices(letters, k=rng.randint(0, 60))) + rng.choice(["", inner]) + "".join(rng.choices(letters, k=rng.randint(0, 40))) + rng.choice(["", a]))
    monkeypatch.setattr(align, "LONG", 0)
    got = align_lists(left, right, "sw", "blosum62", *costs)
    monkeypatch.setattr(align, "LONG", 1 << 40)
    assert (got == align_lists(left, right, "sw", "blosum62", *costs)).all()
    scores, codes = align.scores_of("blosum62"), align.residue_codes()
    code = lambda s: codes[np.frombuffer(s.encode(), np.uint8)].astype(np.int8)
    word = "MKTAYIAKQRQISFVKSHFSRQ"
    part = align._trimmed(code(word), code("G" * 5000 + word + "W" * 5000), scores, 10, 1)
    assert len(part[0]) == len(word) and len(part[1]) < 50
