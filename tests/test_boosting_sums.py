"""Sums of gradients of a whole task: added over batches, once per cell."""

import numpy as np
import pytest

from ratingloom.operators import boosting as B

WIDTHS = [64, 2, 5, 64, 2]


def grown(fits, chance):
    trees = [B.Trees.none(2, 3, 3) for _ in fits]
    for t, fit in zip(trees, fits):
        t.feature[:], t.cut[:] = chance.choice(fit.features, t.feature.shape), chance.integers(0, 3, t.cut.shape)
        t.value[:] = chance.normal(size=t.value.shape)
    trees[0].feature[1, 0, 1] = -1
    return trees


def node_of(tree, row, r, k, levels):
    at = 0
    for _ in range(levels):
        f = tree.feature[r, k, at]
        at = 2 * at + 1 + int(f >= 0 and row[f] > tree.cut[r, k, at])
    return at


@pytest.mark.parametrize("most", [1, 256, 4096])
@pytest.mark.parametrize("level", [0, 1, 2])
def test_batches_of_a_task_make_one_row_per_cell(level, most):
    chance = np.random.default_rng(level)
    n, fits = 90, [B.Fit((0, 1, 2, 3, 4), 1), B.Fit((3, 1)), B.Fit((0, 2, 4), 0)]
    bins = np.stack([chance.integers(0, w, n) for w in WIDTHS], axis=1).astype(np.uint8)
    labels, folds, margins = chance.integers(0, 3, n), chance.integers(0, 3, n), chance.normal(size=(len(fits), 3, n))
    trees = grown(fits, chance)
    total = B.GradientSums(fits, trees, level, B.RESIDUALS, WIDTHS, most)
    for part in (slice(0, 1), slice(1, 50), slice(50, n)):
        total.add(np.ascontiguousarray(bins[part].T), labels[part], folds[part], np.ascontiguousarray(margins[:, :, part]))
    cells, sums = total.cells()
    assert len(set(cells.tolist())) == len(cells)

    want, offset, half = {}, 0, max(1, 2 ** (level - 1))
    for j, (fit, tree) in enumerate(zip(fits, trees)):
        for i in np.flatnonzero(folds != fit.held_out) if fit.held_out is not None else range(n):
            first = [tree.value[0, k, node_of(tree, bins[i], 0, k, 3)] for k in range(3)]
            p = B.softmax((margins[j, :, i] + first)[None, :])[0]
            for k in range(3):
                node = node_of(tree, bins[i], 1, k, level)
                if level and (node % 2 == 0 or tree.feature[1, k, (node - 1) // 2] < 0):
                    continue
                g = p[k] - (labels[i] == k)
                side = (node - (2**level - 1)) >> 1 if level else 0
                for place, f in enumerate(fit.features):
                    cell = offset + ((k * half + side) * len(fit.features) + place) * B.BINS + int(bins[i, f])
                    want[cell] = want.get(cell, 0) + np.array([np.rint(g * B.UNIT), np.rint(abs(g) * (1 - abs(g)) * B.UNIT), 1])
        offset += 3 * half * len(fit.features) * B.BINS
    got = {int(c): s for c, s in zip(cells, sums)}
    assert got.keys() == want.keys() and all(np.abs(got[c] - want[c]).max() <= 90 for c in want)
    assert all(got[c][2] == want[c][2] for c in want)


def test_features_with_few_bins_share_a_sum():
    assert B.bundles((0, 1, 2, 3, 4), WIDTHS, 4096) == [[0, 3], [2, 1, 4]]
    assert B.bundles((0, 1), WIDTHS, 1) == [[0], [1]]
