"""NumPy kernels of the isolation forest (Liu, Ting and Zhou 2008).

They run inside Spark tasks: one call builds one tree from its sample, one call
gives the path lengths of an Arrow batch.
"""

import sys

import numpy as np
from pyspark import cloudpickle

# Ship the kernels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329


def mean_path_length(n):
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    harmonic = np.log(np.maximum(safe - 1.0, 1.0)) + EULER_GAMMA
    longer = 2.0 * harmonic - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, longer, np.where(n == 2, 1.0, 0.0))


def unit_numbers(base, step):
    """Numbers in (0, 1) that follow from 64-bit hashes and a step."""
    x = base + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def lowest_numbers(base, first, trees, below):
    """(row, tree, number) for every number below `below` that a row has for a tree.

    A row has one uniform number for each tree. They are drawn from the smallest up, each for a tree that has none yet,
    so a row without a number below the limit costs one step. `first` is the row's first draw, in (0, 1); the others
    follow from `base`.
    """
    n = len(base)
    rows, chosen, numbers = [], [], []
    alive, rest = np.arange(n), np.zeros(n)
    left = np.empty((n, 0), np.int16)
    for step in range(trees):
        draw = first[alive] if step == 0 else unit_numbers(base[alive], 2 * step)
        rest = rest + np.log1p(-draw) / (trees - step)
        number = -np.expm1(rest)
        stays = number < below
        alive, rest, number = alive[stays], rest[stays], number[stays]
        if not len(alive):
            break
        left = np.tile(np.arange(trees, dtype=np.int16), (len(alive), 1)) if step == 0 else left[stays]
        pick = step + (unit_numbers(base[alive], 2 * step + 1) * (trees - step)).astype(np.int64)
        at = np.arange(len(alive))
        tree = left[at, pick]
        left[at, pick] = left[:, step]
        rows.append(alive), chosen.append(tree.astype(np.int64)), numbers.append(number)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(chosen), np.concatenate(numbers)


def smallest_of_trees(tree, number, take):
    """Places of the `take` smallest numbers of each tree."""
    order = np.lexsort((number, tree))
    begins = np.searchsorted(tree[order], tree[order])
    return order[np.arange(len(order)) - begins < take]


def grow_tree(sample, seed):
    """One random tree over `sample` (rows by features), as flat node arrays.

    Returns (feature, threshold, left, depth). The right child follows the
    left one. At a leaf `left` is -1, and depth holds the path length with the
    leaf's own size accounted for.
    """
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    feature, threshold, left, depth = [0], [0.0], [-1], [0.0]
    pending = [(0, sample, 0)]
    while pending:
        node, rows, level = pending.pop()
        depth[node] = level + float(mean_path_length(len(rows)))
        if level >= limit or len(rows) <= 1:
            continue
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if usable.size == 0:
            continue
        chosen = int(rng.choice(usable))
        cut = float(rng.uniform(low[chosen], high[chosen]))
        goes_left = rows[:, chosen] <= cut
        if goes_left.all():
            continue
        first = len(feature)
        feature[node], threshold[node], left[node] = chosen, cut, first
        for column, value in ((feature, 0), (threshold, 0.0), (left, -1), (depth, 0.0)):
            column.extend([value, value])
        pending.append((first + 1, rows[~goes_left], level + 1))
        pending.append((first, rows[goes_left], level + 1))
    return feature, threshold, left, depth


def pack(trees):
    """All trees end to end: (feature, threshold, left, depth, roots).

    A leaf points at itself and sends everything left, so every row can take
    the same number of steps.
    """
    sizes = [len(t[0]) for t in trees]
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    shift = np.repeat(roots, sizes)
    feature = np.concatenate([t[0] for t in trees]).astype(np.int64)
    threshold = np.concatenate([t[1] for t in trees]).astype(float)
    local = np.concatenate([t[2] for t in trees]).astype(np.int64)
    depth = np.concatenate([t[3] for t in trees]).astype(float)
    leaf = local < 0
    left = np.where(leaf, np.arange(len(local)), local + shift)
    return feature, np.where(leaf, np.inf, threshold), left, depth, roots


def path_lengths(packed, points, steps, chunk=128):
    """Mean path length of every point over all trees, some points at a time to stay in cache."""
    feature, threshold, left, depth, roots = packed
    width = points.shape[1]
    means = np.empty(len(points))
    for begin in range(0, len(points), chunk):
        part = np.ascontiguousarray(points[begin : begin + chunk], dtype=float)
        values = part.ravel()
        base = (np.arange(len(part)) * width)[:, None]
        node = np.broadcast_to(roots, (len(part), len(roots)))
        for _ in range(steps):
            goes_right = values.take(base + feature.take(node)) > threshold.take(node)
            node = left.take(node) + goes_right
        means[begin : begin + chunk] = depth.take(node).mean(axis=1)
    return means
