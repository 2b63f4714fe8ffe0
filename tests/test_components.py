"""Components of masks against a flood fill."""

import sys

import numpy as np

from talkweave.operators import screens


def flooded(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n, rest = n + 1, [(y, x)]
            out[y, x] = n
            while rest:
                b, a = rest.pop()
                for q in range(max(b - 1, 0), min(b + 2, mask.shape[0])):
                    for p in range(max(a - 1, 0), min(a + 2, mask.shape[1])):
                        if mask[q, p] and not out[q, p]:
                            out[q, p] = n
                            rest.append((q, p))
    return out


def test_components_without_a_call_for_each_run():
    rng = np.random.default_rng(5)
    spiral = np.array([[c == "#" for c in row] for row in ("#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######")])
    for mask in [spiral, np.zeros((3, 4), bool), np.ones((1, 1), bool), *(rng.random(rng.integers(1, 40, 2)) < rng.random() for _ in range(60))]:
        got, want = screens.components(mask), flooded(mask)
        assert ((got > 0) == mask).all()
        assert len(set(zip(got[mask], want[mask], strict=True))) == len(set(got[mask])) == len(set(want[mask]))
    mask, calls = rng.random((400, 64)) < 0.4, []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    screens.components(mask)
    sys.setprofile(None)
    assert len(calls) < 1000
