"""A linear-chain conditional random field over hashed features: training by stochastic gradients, Viterbi decoding."""

from __future__ import annotations

import random

import numpy as np


class LinearChain:
    """weights[feature, state] and moves[from, to]; features are integers below ``size``."""

    def __init__(self, states: int, size: int = 1 << 15):
        self.states, self.size = states, size
        self.weights = np.zeros((size, states), np.float32)
        self.moves = np.zeros((states, states), np.float64)
        self.first = np.zeros(states, np.float64)
        self.last = np.zeros(states, np.float64)

    def _scores(self, page: list[list[int]]) -> np.ndarray:
        """Per line and state the sum of its features' weights."""
        flat = np.fromiter((f for line in page for f in line), np.int64)
        starts = np.cumsum([0, *[len(line) for line in page[:-1]]])
        return np.add.reduceat(self.weights[flat], starts, axis=0).astype(np.float64)

    def fit(self, pages: list[list[list[int]]], labels: list[list[int]], epochs: int = 6, rate: float = 0.4, decay: float = 1e-5, seed: int = 0) -> LinearChain:
        """Adagrad on the log-likelihood of whole pages."""
        rng, order = random.Random(seed), list(range(len(pages)))
        seen = np.full((self.size, self.states), 1e-2, np.float32)
        seen_moves = np.full((self.states, self.states), 1e-2)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                page, gold = pages[k], np.asarray(labels[k])
                if not page:
                    continue
                node = self._scores(page)
                n = len(page)
                alpha, beta = np.zeros_like(node), np.zeros_like(node)
                alpha[0] = node[0] + self.first
                for i in range(1, n):
                    x = alpha[i - 1][:, None] + self.moves
                    top = x.max(0)
                    alpha[i] = node[i] + top + np.log(np.exp(x - top).sum(0))
                beta[-1] = self.last
                for i in range(n - 2, -1, -1):
                    x = self.moves + node[i + 1] + beta[i + 1]
                    top = x.max(1, keepdims=True)
                    beta[i] = top[:, 0] + np.log(np.exp(x - top).sum(1))
                z = np.logaddexp.reduce(alpha[-1] + self.last)
                grad = -np.exp(alpha + beta - z)
                grad[np.arange(n), gold] += 1
                pair = np.zeros_like(self.moves)
                if n > 1:
                    joint = np.exp(alpha[:-1, :, None] + self.moves + (node[1:] + beta[1:])[:, None, :] - z)
                    pair -= joint.sum(0)
                    np.add.at(pair, (gold[:-1], gold[1:]), 1)
                flat = np.fromiter((f for line in page for f in line), np.int64)
                rows = np.repeat(grad, [len(line) for line in page], axis=0).astype(np.float32)
                ids, where = np.unique(flat, return_inverse=True)
                step = np.zeros((len(ids), self.states), np.float32)
                np.add.at(step, where, rows)
                step -= decay * len(pages) * self.weights[ids]
                seen[ids] += step * step
                self.weights[ids] += rate * step / np.sqrt(seen[ids])
                seen_moves += pair * pair
                self.moves += rate * pair / np.sqrt(seen_moves)
                self.first += 0.05 * grad[0]
                self.last += 0.05 * grad[-1]
        return self

    def decode(self, page: list[list[int]]) -> list[int]:
        """The most probable sequence of states (Viterbi)."""
        if not page:
            return []
        node = self._scores(page).tolist()
        moves, span = self.moves.T.tolist(), range(self.states)
        best = [a + b for a, b in zip(node[0], self.first.tolist())]
        back = []
        for row in node[1:]:
            came, new = [], []
            for to in span:
                into = moves[to]
                k = max(span, key=lambda s: best[s] + into[s])
                came.append(k)
                new.append(best[k] + into[k] + row[to])
            back.append(came)
            best = new
        end = self.last.tolist()
        at = max(span, key=lambda s: best[s] + end[s])
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        return path[::-1]
