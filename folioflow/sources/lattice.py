"""Tables of ruled lines: cells are the smallest closed rectangles, merged ones included.

Rules that lie on each other are joined first. All their places make a lattice of elementary
cells, each with the pieces of rules along its sides. Elementary cells without a rule between
them belong together; what is closed on all sides is a cell of the page, what is open is none. Cells that share a
side make a table. Rules are swept over once, letters find their cell by bisection.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

#: How far apart the places of one line may be, and gaps and overhangs that still count as joined.
NEAR = 2.0
#: Elementary cells beyond which a page's rules are a drawing.
MOST = 400_000


class TooMany(Exception):
    """Rules that make no table that anyone reads."""


def levels(values: list[float]) -> list[float]:
    """The places of lines, ascending: values that follow another closely are the same place."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > NEAR:
            out.append(v)
    return out


def level(places: list[float], v: float) -> int:
    return max(0, bisect_right(places, v) - 1)


def edges(rules: list[tuple[float, float, float]], own: list[float], across: list[float]) -> list[list[bool]]:
    """[line, piece]: whether a rule covers the piece between two places that follow each other. rules: place, begin, end."""
    out = [[False] * max(0, len(across) - 1) for _ in own]
    by_line: dict[int, list[tuple[float, float]]] = {}
    for place, begin, end in rules:
        by_line.setdefault(level(own, place), []).append((begin, end))
    for line, spans in by_line.items():
        spans.sort()
        begin, end = spans[0]
        for b, e in [*spans[1:], (float("inf"), float("inf"))]:
            if b <= end + NEAR:
                end = max(end, e)
                continue
            first, last = bisect_left(across, begin - NEAR), bisect_right(across, end + NEAR) - 1
            out[line][first : max(first, last)] = [True] * (max(first, last) - first)
            begin, end = b, e
    return out


class Cells:
    """The cells of a page. at: elementary cell -> number of its cell, -1 where it is open; boxes: first and last row and column of each."""

    def __init__(self, across: list[tuple[float, float, float]], down: list[tuple[float, float, float]]):
        self.xs, self.ys = levels([d[0] for d in down]), levels([-a[0] for a in across])  # rows from the top down
        rows, columns = max(0, len(self.ys) - 1), max(0, len(self.xs) - 1)
        if rows * columns > MOST:
            raise TooMany
        self.at = [[-1] * columns for _ in range(rows)]
        self.boxes: list[tuple[int, int, int, int]] = []
        if not rows or not columns:
            return
        flat = edges([(-y, x0, x1) for y, x0, x1 in across], self.ys, self.xs)  # [row line][column]
        upright = edges([(x, -y1, -y0) for x, y0, y1 in down], self.xs, self.ys)  # [column line][row]
        seen = [[False] * columns for _ in range(rows)]
        for r in range(rows):
            for c in range(columns):
                if not seen[r][c]:
                    self.fill(r, c, flat, upright, seen)

    def fill(self, r: int, c: int, flat: list[list[bool]], upright: list[list[bool]], seen: list[list[bool]]) -> None:
        """The elementary cells that belong together with one; a cell if they are closed."""
        rows, columns = len(seen), len(seen[0])
        seen[r][c] = True
        members, closed = [(r, c)], True
        for i, j in members:
            for ruled, y, x in ((flat[i][j], i - 1, j), (flat[i + 1][j], i + 1, j), (upright[j][i], i, j - 1), (upright[j + 1][i], i, j + 1)):
                if ruled:
                    continue
                if not (0 <= y < rows and 0 <= x < columns):
                    closed = False
                elif not seen[y][x]:
                    seen[y][x] = True
                    members.append((y, x))
        if closed:
            for i, j in members:
                self.at[i][j] = len(self.boxes)
            i, j = zip(*members, strict=True)
            self.boxes.append((min(i), max(i), min(j), max(j)))

    def tables(self) -> list[list[int]]:
        """The cells of each table of at least two, tables from the top down, then from the left."""
        parent = list(range(len(self.boxes)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        pairs = {p for above, row in zip(self.at, self.at[1:], strict=False) for p in zip(row, above, strict=True)}
        pairs |= {p for row in self.at for p in zip(row[1:], row, strict=False)}
        for a, b in pairs:
            if a >= 0 and b >= 0 and a != b:
                parent[root(a)] = root(b)
        groups: dict[int, list[int]] = {}
        for k in range(len(self.boxes)):
            groups.setdefault(root(k), []).append(k)
        return sorted((g for g in groups.values() if len(g) > 1), key=lambda g: min((self.boxes[k][0], self.boxes[k][2]) for k in g))

    def cell_of(self, x: float, y: float) -> int:
        """The cell of a letter whose middle is at x and whose line is at y (or a little below the line above it); -1 for none."""
        if not self.boxes:
            return -1
        c = bisect_right(self.xs, x) - 1
        r = bisect_left(self.ys, -(y + 1)) - 1
        if r < 0 and -(y + 1) >= self.ys[0] - 1:
            r = 0
        return self.at[r][c] if 0 <= r < len(self.at) and 0 <= c < len(self.at[r]) else -1


def tables(across: list[tuple[float, float, float]], down: list[tuple[float, float, float]], letters: list[tuple], lines) -> list[list[list[str | None]]]:
    """The tables of a page as rows of texts. A cell's text stands where the cell begins; the rest of a merged cell is None.

    across: y, x0, x1; down: x, y0, y1; letters: x, y, width, ...; lines(letters): their lines of text.
    """
    if len(across) < 2 or len(down) < 2:
        return []
    cells = Cells(across, down)
    inside: dict[int, list] = {}
    for g in letters:
        k = cells.cell_of(g[0] + g[2] / 2, g[1])
        if k >= 0:
            inside.setdefault(k, []).append(g)
    out = []
    for group in cells.tables():
        boxes = [cells.boxes[k] for k in group]
        row = {r: i for i, r in enumerate(sorted({b[0] for b in boxes}))}
        column = {c: i for i, c in enumerate(sorted({b[2] for b in boxes}))}
        table: list[list[str | None]] = [[None] * len(column) for _ in row]
        for k, (top, _, left, _) in zip(group, boxes, strict=True):
            table[row[top]][column[left]] = "\n".join(lines(inside.get(k, []))) or None
        out.append(table)
    return out
