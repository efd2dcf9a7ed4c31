import random

import pytest

from gridledger.operators import scan as S


def cut(rows, at):
    """rows in blocks that end at the given places."""
    return [rows[i:j] for i, j in zip([0, *at], [*at, len(rows)]) if i < j]


def scanned(machine, blocks, file="f"):
    """What block_scan does, in one process: tellings, states and notes, then runs."""
    state, last, states, notes = None, None, [], [[] for _ in blocks]
    for k, rows in enumerate(blocks):
        states.append(state)
        state, note, seen = machine.after(state, machine.tell(iter(rows)))
        if note is not None and last is not None:
            notes[last].append(note)
        last = k if seen else last
    return [r for s, n, rows in zip(states, notes, blocks) for r in machine.run(file, s, n, iter(rows))]


def plain_titles(rows):
    section, last, out = rows[0][3], None, []
    for row_no, kind, value, _ in rows:
        title = kind == S.HARD or (kind == S.SOFT and (last is None or last[0] != section))
        if title:
            section = value
        if kind == S.DATA:
            last = (section,)
        out.append(("f", row_no, section, title))
    return out


def plain_values(rows):
    above, out = None, []
    for row_no, section, kind, texts, numbers in rows:
        cells = [None if s is None else (s, n) for s, n in zip(texts, numbers)]
        filled = [i for i, c in enumerate(cells) if c is not None]
        if kind == S.HARD:
            above = None
        elif kind == S.SOFT:
            i = filled[0]
            for target in ([out[-1][1]] if out else []) + ([above] if above is not None else []):
                target[i] = cells[i] if target[i] is None else (target[i][0] + "\n" + cells[i][0], None)
        else:
            lead = filled[0] if filled else len(cells)
            cells = [(above[i] if above is not None else None) if i < lead else cells[i] for i in range(len(cells))]
            out.append(((row_no, section), cells))
            above = list(cells)
    return [("f", *place, [c and c[0] for c in cells], [c and c[1] for c in cells]) for place, cells in out]


@pytest.mark.parametrize("names", [2, 3, 8])
def test_titles_on_random_cuts(names):
    rnd = random.Random(names)
    for _ in range(3000):
        n = rnd.randint(1, 24)
        rows = [(i, rnd.choice([S.DATA, S.DATA, S.SOFT, S.SOFT, S.HARD]), f"t{rnd.randrange(names)}", "t0") for i in range(n)]
        at = sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 6)))) if n > 1 else []
        assert scanned(S.Titles, cut(rows, at)) == plain_titles(rows), (rows, at)


def test_values_on_random_cuts():
    rnd = random.Random(5)
    for _ in range(4000):
        n, rows, data = rnd.randint(1, 20), [], False
        for i in range(n):
            kind = rnd.choice([S.DATA] * 3 + [S.SOFT] * 2 + [S.HARD])
            kind = S.HARD if kind == S.SOFT and not data else kind  # without a row before, a lone cell is a title
            data = data or kind == S.DATA
            cells = [None if rnd.random() < 0.5 else (f"{i}{c}", float(i) if rnd.random() < 0.3 else None) for c in "abc"]
            if kind != S.DATA:
                k = rnd.randrange(3)
                cells = [(f"m{i}", None) if j == k else None for j in range(3)]
            rows.append((i, "s", kind, [c and c[0] for c in cells], [c and c[1] for c in cells]))
        at = sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 7)))) if n > 1 else []
        assert scanned(S.Values, cut(rows, at)) == plain_values(rows), (rows, at)


def test_a_telling_is_short():
    rows = [(i, (S.HARD, S.DATA, S.SOFT)[i % 3], f"t{i}", "General") for i in range(3000)]
    opening, hard, head, seen, apart, rest, tail = S.Titles.tell(rows)
    assert len(head) <= 1 and len(apart) <= 1 and len(tail or []) <= 2


def test_over_many_tasks(spark):
    """One file over blocks of three rows, beside small ones: the rows of the plain machines."""
    rnd = random.Random(9)
    told = [("f" if i < 400 else f"g{i % 7}", i, rnd.choice([S.DATA, S.DATA, S.SOFT, S.HARD]), f"t{rnd.randrange(4)}", "General") for i in range(460)]
    rows = spark.createDataFrame(told, "file string, row_no int, kind int, value string, opening string").repartition(5)
    got = S.block_scan(rows, S.Titles, "file string, row_no int, section string, is_title boolean", block=3)
    want = [(f, *r[1:]) for f in sorted({t[0] for t in told}) for r in plain_titles([t[1:] for t in told if t[0] == f])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    cells = [("f", i, "s", kind, *(lambda c: ([x and x[0] for x in c], [x and x[1] for x in c]))([("v%d" % i, 1.5) if (kind == S.DATA and rnd.random() < 0.4) or k == i % 3 else None for k in range(3)])) for i, kind in enumerate([S.DATA, *(rnd.choice([S.DATA, S.SOFT, S.DATA, S.HARD]) for _ in range(300))])]
    for i, r in enumerate(cells):
        if r[3] != S.DATA:
            cells[i] = (*r[:4], [f"m{i}" if k == i % 3 else None for k in range(3)], [None] * 3)
    rows = spark.createDataFrame(cells, "file string, row_no int, section string, kind int, s array<string>, n array<double>").repartition(4)
    got = S.block_scan(rows, S.Values, "file string, row_no int, section string, s array<string>, n array<double>", block=4)
    assert sorted(map(tuple, got.collect())) == plain_values([r[1:] for r in cells])
