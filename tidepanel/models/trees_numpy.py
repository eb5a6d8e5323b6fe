"""Small array helpers that run inside Spark tasks on one Arrow batch at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Binary tree over bin numbers; ``left[i] < 0`` marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        children = []
        for _ in range(2):
            children.append(len(self.left))
            for column, start in (
                (self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)
            ):
                column.append(start)
            self.depth.append(self.depth[node] + 1)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        return children[0], children[1]

    def leaves(self) -> list[int]:
        return [i for i, child in enumerate(self.left) if child < 0]


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Leaf number of every row; quickest where the columns of ``bins`` are contiguous."""
    at = np.zeros(len(bins), dtype=np.int16 if len(tree.left) < 2**15 else np.int64)
    if tree.left[0] < 0 or not len(bins):
        return at
    levels: dict[int, list[int]] = {}
    for node, child in enumerate(tree.left):
        if child >= 0:
            levels.setdefault(tree.depth[node], []).append(node)
    for _, nodes in sorted(levels.items()):
        if len({(tree.feature[i], tree.cut[i]) for i in nodes}) == 1 < len(nodes):  # one test for the whole level
            low, high = np.arange(len(tree.left), dtype=at.dtype), np.arange(len(tree.left), dtype=at.dtype)
            low[nodes], high[nodes] = [tree.left[i] for i in nodes], [tree.right[i] for i in nodes]
            above = bins[:, tree.feature[nodes[0]]] > tree.cut[nodes[0]]
            at = low[at] + (high - low)[at] * above
            continue
        for node in nodes:
            left, right = at.dtype.type(tree.left[node]), at.dtype.type(tree.right[node])
            below = bins[:, tree.feature[node]] <= tree.cut[node]
            np.copyto(at, np.where(below, left, right), where=at == node)
    return at


def margin_of(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += np.asarray(tree.value)[leaf_of(tree, bins)]
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def gradients(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sums per row that a split needs.

    logistic and squared: first and second derivative of the loss.
    exponential: boosting weight of the rows of class 1, and of all rows.
    """
    if loss == "logistic":
        p = sigmoid(margin)
        return p - y, p * (1.0 - p)
    if loss == "squared":
        return margin - y, np.ones(len(y))
    weight = np.exp(-(2.0 * y - 1.0) * margin / 2.0)
    return weight * y, weight


def bin_values(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (rows x features); bin b holds edges[b-1] < x <= edges[b]."""
    bins = np.empty(values.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        bins[:, j] = np.searchsorted(cuts, values[:, j], side="left")
    return bins


def sampled(row_ids: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """Repeatable row sample: a hash of (row, seed, turn), the same on every retry of a task."""
    with np.errstate(over="ignore"):
        x = row_ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) < np.uint64(int(share * 2**53))
