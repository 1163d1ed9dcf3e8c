"""Attributions by tables of outcomes."""

import numpy as np

from ratingloom.operators import attribution as AT


def leaves_of_trees(rng, trees=40, features=6):
    out = [(0.3, [])]
    for _ in range(trees):
        cuts = rng.normal(size=7).round(1)
        names = rng.integers(0, features, 7)
        for leaf in range(8):
            limits, node = {}, 0
            for level in range(3):
                f, at, right = int(names[node]), float(cuts[node]), leaf >> level & 1
                lo, hi, share = limits.get(f, (-np.inf, np.inf, 1.0))
                limits[f] = (max(lo, at), hi, share * 0.4) if right else (lo, min(hi, at), share * 0.6)
                node = 2 * node + 1 + right
            out.append((float(rng.normal()), [(f, lo, hi, s) for f, (lo, hi, s) in limits.items()]))
    return out


def test_tables_give_the_same_attributions_with_a_lookup_per_tree():
    rng = np.random.default_rng(2)
    leaves, x = leaves_of_trees(rng), rng.normal(size=(500, 6)).round(1)  # many values on a cut
    tables = AT.tabled(leaves)
    assert len(tables) <= 41 and all(len(t.values) <= 2**AT.TESTS for t in tables)
    assert np.allclose(AT.pattern_values(x, tables), AT.shapley_values(x, leaves), rtol=0, atol=1e-12)
