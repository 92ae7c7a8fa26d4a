import numpy as np

from latchgraph.llm import _boost


def test_first_tree_against_all_splits():
    """The root's split is the best of all thresholds that lie on an edge of the bins; leaves hold Newton steps."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = ((x[:, 1] > 0.4) ^ (r.random(400) < 0.1)).astype(float)
    model = _boost.boost(x, y, trees=1, depth=1, rate=0.3, bins=16)
    [(feature, threshold, value)] = model.trees
    prior = np.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + np.exp(-prior))
    g, h = p - y, np.full(400, p * (1 - p))

    def gain(left):
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1)

    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
    best = max(((gain(x[:, f] <= e), f, e) for f in range(3) for e in edges[f]), key=lambda t: t[0])
    assert (feature[0], threshold[0]) == (best[1], best[2])
    for node, rows in ((1, x[:, best[1]] <= best[2]), (2, x[:, best[1]] > best[2])):
        assert np.isclose(value[node], -0.3 * g[rows].sum() / (h[rows].sum() + 1))
    assert np.allclose(model.scores(x), prior + np.where(x[:, best[1]] > best[2], value[2], value[1]))


def test_scores_follow_the_trees():
    """Scores of all rows at once agree with walking down each tree for each row."""
    r = np.random.default_rng(6)
    x, y = r.normal(size=(300, 4)), r.integers(0, 2, 300).astype(float)
    model = _boost.boost(x, y, trees=5, depth=3)
    for row, score in zip(x, model.scores(x)):
        total = model.prior
        for feature, threshold, value in model.trees:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + (1 if row[feature[at]] <= threshold[at] else 2)
            total += value[at]
        assert np.isclose(score, total)
