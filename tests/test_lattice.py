from __future__ import annotations

import random
import time

import pytest

from folioflow.config import Limits
from folioflow.sources import lattice, pdf
from folioflow.sources import samples as s


def ruled(boxes: dict[tuple[int, int, int, int], str], x: float = 50, y: float = 700, w: float = 60, h: float = 20):
    """Rules and letters of cells (top, bottom, left, right, ends excluded) with texts; every cell draws its own borders."""
    across, down, letters = [], [], []
    for (top, bottom, left, right), text in boxes.items():
        x0, x1, y0, y1 = x + left * w, x + right * w, y - bottom * h, y - top * h
        across += [(y0, x0, x1), (y1, x0, x1)]
        down += [(x0, y0, y1), (x1, y0, y1)]
        letters += [(x0 + 0.06 * w + 3 * i, y1 - 0.7 * h, 3.0, 10.0, c) for i, c in enumerate(text)]
    return across, down, letters


def lines(letters: list) -> list[str]:
    return ["".join(g[4] for g in sorted(letters))] if letters else []


def partition(rng: random.Random, top: int, bottom: int, left: int, right: int) -> list[tuple[int, int, int, int]]:
    """Random rectangles that fill one."""
    if (bottom - top == 1 and right - left == 1) or rng.random() < 0.15:
        return [(top, bottom, left, right)]
    if right - left == 1 or bottom - top > 1 and rng.random() < 0.5:
        at = rng.randrange(top + 1, bottom)
        return partition(rng, top, at, left, right) + partition(rng, at, bottom, left, right)
    at = rng.randrange(left + 1, right)
    return partition(rng, top, bottom, left, at) + partition(rng, top, bottom, at, right)


def test_merged_cells_of_all_shapes():
    rng = random.Random(1)
    for _ in range(300):
        boxes = {b: f"c{i}" if rng.random() < 0.9 else "" for i, b in enumerate(partition(rng, 0, rng.randint(1, 6), 0, rng.randint(1, 6)))}
        if len(boxes) < 2:
            continue
        rows, columns = sorted({b[0] for b in boxes}), sorted({b[2] for b in boxes})
        want = [[None] * len(columns) for _ in rows]
        for (top, _, left, _), text in boxes.items():
            want[rows.index(top)][columns.index(left)] = text or None
        across, down, letters = ruled(boxes)
        shake = lambda rules: rng.sample([tuple(v + rng.uniform(-0.4, 0.4) for v in r) for r in rules], len(rules))  # noqa: B023, E731
        assert lattice.tables(shake(across), shake(down), letters, lines) == [want]


def test_rules_in_pieces_and_as_one():
    boxes = {(r, r + 1, c, c + 1): f"{r}{c}" for r in range(3) for c in range(4)}
    whole = ([(700 - 20 * r, 50, 290) for r in range(4)], [(50 + 60 * c, 640, 700) for c in range(5)])
    _, _, letters = ruled(boxes)
    want = [[[f"{r}{c}" for c in range(4)] for r in range(3)]]
    assert lattice.tables(*whole, letters, lines) == want
    pieces = ([(y, x, x + 30) for y, x0, x1 in whole[0] for x in range(x0, x1, 30)], [(x, y, y + 11) for x, y0, y1 in whole[1] for y in range(y0, y1, 10)])
    assert lattice.tables(*pieces, letters, lines) == want


def test_what_is_open_or_alone_is_no_table():
    across, down, letters = ruled({(0, 1, 0, 1): "only"})
    assert lattice.tables(across, down, letters, lines) == []
    comb = [(700.0, 50.0, 290.0)], [(50.0 + 60 * c, 600.0, 700.0) for c in range(5)]
    assert lattice.tables(*comb, letters, lines) == []
    across, down, letters = ruled({(0, 1, 0, 1): "a", (0, 1, 1, 2): "b", (1, 2, 0, 1): "c", (1, 2, 1, 2): "d"})
    assert lattice.tables(across, [d for d in down if d[0] < 160], letters, lines) == [[["a"], ["c"]]]  # the right border is missing


def test_tables_beside_and_below_each_other():
    parts = [ruled({(0, 1, 0, 1): f"a{k}", (0, 1, 1, 2): f"b{k}", (1, 2, 0, 2): f"c{k}"}, x, y) for k, (x, y) in enumerate([(50, 700), (300, 695), (50, 500)])]
    across, down, letters = ([x for p in parts for x in p[i]] for i in range(3))
    assert lattice.tables(across, down, letters, lines) == [[[f"a{k}", f"b{k}"], [f"c{k}", None]] for k in range(3)]


def test_ten_thousand_rules_take_little_time():
    boxes = {(r, r + 1, c, c + 1): "x" for r in range(50) for c in range(50)}
    across, down, letters = ruled(boxes, w=10, h=10)
    assert len(across) + len(down) == 10_000
    begun = time.perf_counter()
    found = lattice.tables(across, down, letters, lines)
    assert time.perf_counter() - begun < 3  # a second on an idle machine
    assert len(found) == 1 and len(found[0]) == 50 and all(row == ["x"] * 50 for row in found[0])
    with pytest.raises(lattice.TooMany):
        lattice.tables([(3.0 * i, 0, 9000) for i in range(1000)], [(3.0 * i, 0, 9000) for i in range(1000)], [], lines)


def test_a_page_with_merged_cells():
    page = s.merged_grid({(0, 1, 0, 2): "Head", (1, 3, 0, 1): "left", (1, 2, 1, 2): "one", (2, 3, 1, 2): "two"})
    rows = next(i.rows for i in pdf.extract(s.pdf([page]), Limits()).items if i.kind == "ptable")
    assert rows == [["Head", None], ["left", "one"], [None, "two"]]
