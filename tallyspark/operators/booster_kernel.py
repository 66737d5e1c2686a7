"""NumPy gradient boosting for squared loss (Friedman 2001), for one short series.

`predict_each` carries stored models forward inside Spark tasks. Tasks fit with SeriesFitter.java, which adds up in the same
order and gives the same trees; tests hold the two against each other. A feature's values are dealt to at most
MOST_BINS bins of about equal size, and cuts lie between neighbouring bins; with
fewer distinct values every midpoint is a candidate and splits are exact.
"""

import copy
import sys

import numpy as np
from pyspark import cloudpickle

# Ship the kernels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BINS = 128


class Booster:
    def __init__(self, start, rate, feature, threshold, value):
        self.start, self.rate = start, rate
        self.feature, self.threshold, self.value = feature, threshold, value

    def predict(self, x):
        """Prediction for every row of `x`; trees are complete, children at 2i+1 and 2i+2."""
        x = np.ascontiguousarray(np.atleast_2d(x))
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature)) * inner
        row = (np.arange(len(x)) * x.shape[1])[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        while node.size and node[0, 0] < inner:
            at = tree + node
            goes_left = x.take(row + feature.take(at)) <= threshold.take(at)
            node = 2 * node + 2 - goes_left
        trees = np.arange(len(self.feature))
        return self.start + self.rate * self.value[trees, node - inner].sum(axis=1)


def predict_each(start, rate, feature, threshold, value, x):
    """Row k of `x` by model k: the arrays of Booster for several models of one size, stacked."""
    models, trees = np.arange(len(x))[:, None], np.arange(feature.shape[1])
    node = np.zeros(feature.shape[:2], dtype=np.int64)
    inner = feature.shape[2]
    while node.size and node[0, 0] < inner:
        goes_left = x[models, feature[models, trees, node]] <= threshold[models, trees, node]
        node = 2 * node + 2 - goes_left
    return start + rate * value[models, trees, node - inner].sum(axis=1)


def fit(x, y, n_trees, depth, rate, most_bins=MOST_BINS):
    """Boosted trees of a fixed depth on rows `x` and targets `y`."""
    return fit_binned(Bins(x, most_bins), y, n_trees, depth, rate)


def fit_binned(bins, y, n_trees, depth, rate):
    """The same on rows that are binned already, so several fits can share the bins."""
    return fit_all([bins], [y], n_trees, depth, rate)[0]


def fit_all(binned, targets, n_trees, depth, rate):
    """One booster for each of several series, which share nothing but the calls of NumPy.

    All series search a level at once: their bins lie side by side, a feature's padded to the most that a series has.
    Running counts and sums over the bins are gathered for the smaller child of each node only; the larger one's are the
    parent's minus those.
    """
    joint = _SideBySide(binned)
    inner, leaves, many = 2**depth - 1, 2**depth, len(binned)
    feature = np.zeros((many, n_trees, inner), dtype=np.int64)
    threshold = np.full((many, n_trees, inner), np.inf)
    value = np.zeros((many, n_trees, leaves))
    targets = [np.asarray(y, dtype=float) for y in targets]
    y, start = np.concatenate(targets), np.array([y.mean() for y in targets])
    fitted = np.repeat(start, joint.lengths)
    first_leaf = np.repeat(leaves * np.arange(many), joint.lengths)
    root_places = joint.places(np.arange(len(y)), np.repeat(np.arange(many), joint.lengths))
    root_counts = joint.running(root_places, many)
    for t in range(n_trees):
        residual = y - fitted
        counts, sums = root_counts, joint.running(root_places, many, residual)
        members, leaf = joint.valid, np.zeros(joint.valid.shape, dtype=np.uint8 if depth <= 8 else np.int64)
        for d in range(depth):
            width = 2**d
            f, code, cut, sides = joint.best_splits(counts, sums)
            feature[:, t, width - 1 : 2 * width - 1] = f.reshape(many, width)
            threshold[:, t, width - 1 : 2 * width - 1] = cut.reshape(many, width)
            right = joint.goes_right(f, code, members)
            leaf += leaf
            leaf += np.bitwise_or.reduce(right.reshape(many, width, -1), axis=1)
            if d < depth - 1:
                small_side = np.argmin(sides, axis=1)
                rows = joint.rows_of((right ^ (small_side == 0)[:, None]) & members, many)
                n_rows = np.min(sides, axis=1).astype(np.int64)
                places = joint.places(rows, np.repeat(np.arange(many * width), n_rows))
                counts = _children(counts, joint.running(places, many * width), small_side)
                sums = _children(sums, joint.running(places, many * width, residual[rows]), small_side)
                members = np.stack([members ^ right, right], axis=1).reshape(2 * many * width, -1)
        leaf = leaf[joint.valid] + first_leaf
        mean = np.bincount(leaf, weights=residual, minlength=many * leaves) / np.maximum(sides.ravel(), 1)
        value[:, t] = mean.reshape(many, leaves)
        fitted += (rate * mean)[leaf]
    return [Booster(float(start[k]), rate, feature[k], threshold[k], value[k]) for k in range(many)]


def _children(parent, small, small_side):
    """Statistics of both children of every node, left before right."""
    both = np.empty((2 * len(parent), parent.shape[1]), dtype=parent.dtype)
    nodes = 2 * np.arange(len(parent))
    both[nodes + small_side] = small
    both[nodes + 1 - small_side] = parent - small
    return both


class Bins:
    """The bins of every feature, end to end, and each row's place among them."""

    def __init__(self, x, most=MOST_BINS):
        x = np.ascontiguousarray(x, dtype=float)
        found = [self._of_feature(x[:, f], most) for f in range(x.shape[1])]
        self.lows, self.highs = (np.concatenate([part[i] for part in found]) for i in (0, 1))
        self.spans = np.array([len(part[0]) for part in found])
        self.starts = np.concatenate([[0], np.cumsum(self.spans)])
        self.size = int(self.starts[-1])
        self.code = np.column_stack([part[2] for part in found])
        self.flat = self.code + self.starts[:-1]

    @staticmethod
    def _of_feature(column, most):
        """(smallest value, largest value) of every bin, and each row's bin; equal values share a bin."""
        values, inverse, often = np.unique(column, return_inverse=True, return_counts=True)
        if len(values) <= most:
            return values, values, inverse
        share = (np.cumsum(often) - often) * most // len(column)
        _, first, bin_ = np.unique(share, return_index=True, return_inverse=True)
        return values[first], values[np.append(first[1:], len(values)) - 1], bin_[inverse]

    def rows(self, chosen):
        """The same bins for some of the rows."""
        part = copy.copy(self)
        part.code, part.flat = self.code[chosen], self.flat[chosen]
        return part


class _SideBySide:
    """The bins of several series in the same places, one row of places a node."""

    def __init__(self, binned):
        self.lengths = np.array([len(bins.code) for bins in binned])
        longest = int(self.lengths.max())
        # Rows before a series, less those before it if all were of one length.
        self.shift = np.cumsum(self.lengths) - self.lengths - longest * np.arange(len(binned))
        self.valid = np.arange(longest) < self.lengths[:, None]
        self.spans = np.max([bins.spans for bins in binned], axis=0)
        self.starts = np.concatenate([[0], np.cumsum(self.spans)])
        self.size = int(self.starts[-1])
        self.of_feature = np.repeat(np.arange(len(self.spans)), self.spans)
        self.flat = np.concatenate([bins.code for bins in binned]) + self.starts[:-1]
        self.columns = np.zeros((len(binned), len(self.spans), longest), np.min_scalar_type(int(self.spans.max())))
        self.lows, self.highs = np.zeros((len(binned), self.size)), np.zeros((len(binned), self.size))
        for k, bins in enumerate(binned):
            self.columns[k, :, : len(bins.code)] = bins.code.T
            at = self.starts[:-1].repeat(bins.spans) + np.arange(bins.size) - bins.starts[:-1].repeat(bins.spans)
            self.lows[k, at], self.highs[k, at] = bins.lows, bins.highs
        self._offsets = {}

    def places(self, rows, nodes):
        """The bins of some rows, each offset by its row's node."""
        found = self.flat.take(rows, axis=0).ravel()
        found += np.repeat(nodes * self.size, len(self.spans))
        return found

    def running(self, places, n_nodes, residual=None):
        """Per node and bin, the count (or sum of residuals) of rows up to the bin's value."""
        weights = None if residual is None else np.repeat(residual, len(self.spans))
        total = np.bincount(places, weights=weights, minlength=n_nodes * self.size)
        total = np.cumsum(total.reshape(n_nodes, self.size), axis=1, dtype=float)
        total[:, self.starts[1] :] -= np.repeat(total[:, self.starts[1:-1] - 1], self.spans[1:], axis=1)
        return total

    def best_splits(self, left_n, left_sum):
        """(feature, last code on the left, threshold, rows on either side) for every node.

        A node without a useful split gets an infinite threshold and the first
        feature's last code, which sends all its rows left.
        """
        last, nodes = self.starts[1] - 1, len(left_n)
        n, total = left_n[:, last, None], left_sum[:, last, None]
        sizes = n - left_n
        sizes *= left_n
        # Squared distance of the two means, weighted by both sizes.
        gain = left_sum * n
        gain -= total * left_n
        gain *= gain
        one_sided = sizes == 0
        np.maximum(sizes, 1, out=sizes)
        gain /= sizes
        np.copyto(gain, -1.0, where=one_sided)
        place = np.argmax(gain, axis=1)
        node = np.arange(nodes)
        useful = ~(gain[node, place] <= 1e-12)
        f, n_left = self.of_feature[place], left_n[node, place]
        # Counts rise within a feature; offset by node and feature they rise throughout, so one search serves all nodes.
        if nodes not in self._offsets:
            places = node[:, None] * len(self.spans) + self.of_feature
            self._offsets[nodes] = places * float(self.lengths.max() + 1)
        rising = (left_n + self._offsets[nodes]).ravel()
        wanted = rising[node * self.size + place]
        # Bins the node really has rows in on both sides of the cut.
        below = rising.searchsorted(wanted, side="left") - node * self.size
        above = np.minimum(rising.searchsorted(wanted, side="right") - node * self.size, self.size - 1)
        series = node // (nodes // len(self.lows))
        cut = np.where(useful, 0.5 * (self.highs[series, below] + self.lows[series, above]), np.inf)
        n_left = np.where(useful, n_left, n[:, 0])
        sides = np.stack([n_left, n[:, 0] - n_left], axis=1)
        return np.where(useful, f, 0), np.where(useful, place - self.starts[f], last), cut, sides

    def goes_right(self, f, code, members):
        """Which of a node's rows, by their position in the series, go to its right child."""
        series = np.arange(len(f)) // (len(f) // len(self.columns))
        right = self.columns[series, f] > code.astype(self.columns.dtype)[:, None]
        right &= members
        return right

    def rows_of(self, chosen, many):
        """Row numbers of the positions marked, node by node."""
        at, longest = np.flatnonzero(chosen), chosen.shape[1]
        node = at // longest
        series = node // (len(chosen) // many)
        return at - node * longest + (series * longest + self.shift[series])
