"""Reconciliation along the tree against dense matrices, and its size."""

import resource

import numpy as np
import pytest
from ramify.operators import reconcile


def pairs_of(shape):
    """(node, leaf) of a tree given as nested counts of children; 0 is a leaf."""
    out = []

    def walk(name, own):
        if not own:
            return [name]
        leaves = [x for k, child in enumerate(own) for x in walk(f"{name}/{k}", child)]
        out.extend((name, x) for x in leaves)
        return leaves

    out += [(x, x) for x in walk("r", shape)]
    return out


SHAPES = {
    "one_level": [[]] * 4, "three_levels": [[[]] * 3, [[]] * 2, [[]]], "uneven": [[[[], []], []], [], [[[], []]]], "chain": [[[[]]]],
}


@pytest.mark.parametrize("shape", SHAPES.values(), ids=SHAPES)
def test_paths_equal_the_dense_projection(shape):
    rng = np.random.default_rng(0)
    tree = reconcile.Tree(pairs_of(shape))
    m = len(tree.names)
    s = tree.sums(np.eye(tree.leaves))
    assert s.tolist() == [[float(leaf == node or leaf.startswith(f"{node}/")) for leaf in tree.names[tree.inner :]] for node in tree.names]
    errors, base = rng.normal(size=(52, m)) @ rng.normal(size=(m, m)), rng.normal(100, 10, m)
    w, share = reconcile.shrunk_covariance(errors)
    p = reconcile.projection(s, w)
    median, paths, intensity, missed = reconcile.coherent_paths(tree, base, errors)
    assert intensity == pytest.approx(float(share), abs=1e-12) and missed < 1e-8
    assert np.allclose(median, p @ base, atol=1e-8) and np.allclose(paths, p @ (base[:, None] + errors.T), atol=1e-8)
    assert np.abs(tree.gaps(paths)).max() < 1e-9


def test_conditions_and_their_transpose():
    tree, rng = reconcile.Tree(pairs_of(SHAPES["uneven"])), np.random.default_rng(1)
    m = len(tree.names)
    c = tree.gaps(np.eye(m))
    assert np.allclose(tree.spread(np.eye(tree.inner)), c.T)
    d, y = rng.random(m) + 0.1, rng.normal(size=(tree.inner, 3))
    assert np.allclose(tree.solve(d, y), np.linalg.solve(c @ np.diag(d) @ c.T, y))
    leaves = rng.normal(size=(tree.leaves, 2))
    assert np.abs(tree.gaps(tree.sums(leaves))).max() < 1e-12


def test_ten_thousand_leaves_fit_one_executor():
    tree = reconcile.Tree([(n, f"r/{i}/{j}") for i in range(200) for j in range(50) for n in ("r", f"r/{i}", f"r/{i}/{j}")])
    rng = np.random.default_rng(2)
    errors, base = rng.normal(size=(52, 10_201)), rng.normal(100, 10, 10_201)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    median, paths, intensity, missed = reconcile.coherent_paths(tree, base, errors)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024  # a dense matrix alone takes 830 MB
    assert paths.shape == (10_201, 52) and missed < 1e-8 and 0 <= intensity <= 1


def test_errors_that_tell_nothing_are_refused():
    with pytest.raises(ValueError, match="same error"):
        reconcile.shrinkage(np.ones((5, 3)))
    with pytest.raises(ValueError, match="one origin"):
        reconcile.shrinkage(np.ones((1, 3)))
