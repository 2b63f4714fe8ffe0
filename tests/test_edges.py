"""Edges of pictures: against loops and a flood fill, and by shape."""

import random

import numpy as np
import pytest

from talkweave.operators import screens


def by_hand(grey, low=100, high=200):
    h, w = grey.shape
    g = lambda y, x: int(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx = {(y, x): sum(k * (g(y + i, x + 1) - g(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1))) for y in range(h) for x in range(w)}
    dy = {(y, x): sum(k * (g(y + 1, x + i) - g(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1))) for y in range(h) for x in range(w)}
    size = {p: abs(dx[p]) + abs(dy[p]) for p in dx}
    at = lambda y, x: size.get((y, x), 0)
    ridge = set()
    for (y, x), m in size.items():
        angle = np.degrees(np.arctan2(abs(dy[y, x]), abs(dx[y, x])))
        if angle < 22.5:
            ok = m > at(y, x - 1) and m >= at(y, x + 1)
        elif angle > 67.5:
            ok = m > at(y - 1, x) and m >= at(y + 1, x)
        else:
            s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
            ok = m > at(y - 1, x - s) and m > at(y + 1, x + s)
        if ok and m > low:
            ridge.add((y, x))
    todo = [p for p in ridge if size[p] > high]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if q in ridge and q not in found:
                found.add(q)
                todo.append(q)
    return found


@pytest.mark.parametrize("kind", ["noise", "smooth", "blocks", "thin"])
def test_against_loops(kind):
    rng, r = np.random.default_rng(len(kind)), random.Random(kind)
    for _ in range(12):
        h, w = r.randint(1, 30), r.randint(1, 30)
        grey = rng.integers(0, 256, (h, w))
        if kind == "smooth":
            y, x = np.mgrid[:h, :w]
            grey = (127 + 120 * np.sin(y / 3 + r.random()) * np.cos(x / 4)).astype(int)
        elif kind == "blocks":
            grey = np.kron(rng.integers(0, 3, (h, w)) * 60, np.ones((4, 4), int))[:h, :w]
        elif kind == "thin":
            grey = (rng.random((h, w)) < 0.05) * 90
        assert {tuple(map(int, p)) for p in np.argwhere(screens.edges(grey.astype(np.uint8)))} == by_hand(grey)


def test_shapes():
    y, x = np.mgrid[:40, :40]
    diagonal = np.where(x > y, 255, 0).astype(np.uint8)
    found = screens.edges(diagonal)
    assert found.any() and (found.sum(axis=1) <= 2).all() and (np.abs(np.argwhere(found) @ [1, -1]) <= 1).all()
    line = np.zeros((20, 20), np.uint8)
    line[:, 10] = 255
    assert sorted(set(np.argwhere(screens.edges(line))[:, 1].tolist())) == [9, 11]
    # a long weak edge counts as far as it is connected with a strong end, and not without one
    weak = np.zeros((30, 60), np.uint8)
    weak[15:, :] = 40
    assert not screens.edges(weak).any()
    weak[15:, :3] = 200
    assert screens.edges(weak)[14:16, 10:].any(axis=0).all()
    assert screens.edge_density(np.zeros((5, 5, 3), np.uint8)) == 0.0


def test_components():
    rng = np.random.default_rng(7)
    for _ in range(40):
        mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.choice([0.2, 0.4, 0.6])
        label = screens.components(mask)
        assert ((label > 0) == mask).all()
        seen = {}
        for p in map(tuple, np.argwhere(mask)):
            if p not in seen:
                todo = [p]
                seen[p] = p
                while todo:
                    y, x = todo.pop()
                    for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if q not in seen and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]:
                            seen[q] = p
                            todo.append(q)
        pairs = {(seen[p], int(label[p])) for p in seen}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
