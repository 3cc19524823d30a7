"""A skip-chain conditional random field over the candidate mentions of each document.

Every candidate is a binary variable: meant or not. Its clues give its own potential. Neighbours in the text share a potential by
their labels, overlapping candidates exclude each other, and however distant candidates with a common key (the same value, the same
surname, an address made of it) share one that rewards equal decisions. Marginals come from loopy belief propagation with damping;
the weights from gradient ascent on the likelihood with these marginals, over a bounded set of made-up documents.

The graphs of a whole batch of documents are one graph in arrays, so a round of messages is a few array operations.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from brinewell.llm.mentions import Mention

NEAR = 80
ROUNDS = 8
DAMPING = 0.3
EXCLUDE = -12.0


class Graph:
    """Nodes, clues and edges of the candidates of several documents."""

    def __init__(self, documents: list[list[Mention]], names: dict[str, int], grow: bool = False):
        clue_at, clue_of, left, right, kind, fixed = [], [], [], [], [], []
        n = 0

        def code(name: str) -> int:
            if grow:
                return names.setdefault(name, len(names))
            return names.get(name, -1)

        for doc in documents:
            for k, m in enumerate(doc):
                for c in m.clues:
                    if (at := code(c)) >= 0:
                        clue_at.append(n + k)
                        clue_of.append(at)
            for k, (a, b) in enumerate(pairwise(doc)):
                if b.start - a.end < NEAR and b.start >= a.end and (at := code(f"near:{a.label}>{b.label}")) >= 0:
                    left.append(n + k)
                    right.append(n + k + 1)
                    kind.append(at)
                    fixed.append(0.0)
            open_until: list[int] = []
            for k, m in enumerate(doc):
                open_until = [j for j in open_until if doc[j].end > m.start]
                for j in open_until:
                    left.append(n + j)
                    right.append(n + k)
                    kind.append(-1)
                    fixed.append(EXCLUDE)
                open_until.append(k)
            last: dict[str, int] = {}
            for k, m in enumerate(doc):
                for key in m.keys:
                    j = last.get(key)
                    if j is not None and doc[j].end <= m.start:
                        pair = ">".join(sorted((doc[j].label, m.label)))
                        if (at := code(f"skip:{pair}")) >= 0:
                            left.append(n + j)
                            right.append(n + k)
                            kind.append(at)
                            fixed.append(0.0)
                    last[key] = k
            n += len(doc)
        self.n = n
        self.clue_at, self.clue_of = np.array(clue_at, np.int64), np.array(clue_of, np.int64)
        self.left, self.right, self.kind = np.array(left, np.int64), np.array(right, np.int64), np.array(kind, np.int64)
        self.fixed = np.array(fixed)
        self.same = np.array([x >= 0 for x in kind], bool)

    def own(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.clue_at, w[self.clue_of], self.n) if self.n else np.zeros(0)

    def marginals(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each node, and of each edge that both its nodes are decided alike.

        An edge's potential is s for equal decisions and 0 else, or EXCLUDE for two that overlap and are both meant.
        """
        own = self.own(w)
        if not len(self.left):
            return 1 / (1 + np.exp(-own)), np.zeros(0)
        s = np.where(self.same, w[np.maximum(self.kind, 0)], 0.0)
        both = np.where(self.same, s, EXCLUDE)
        none = s
        to_right, to_left = np.zeros(len(self.left)), np.zeros(len(self.left))
        for _ in range(ROUNDS):
            belief = own + np.bincount(self.right, to_right, self.n) + np.bincount(self.left, to_left, self.n)
            a, b = belief[self.left] - to_left, belief[self.right] - to_right
            to_right = DAMPING * to_right + (1 - DAMPING) * (np.logaddexp(0.0, a + both) - np.logaddexp(none, a))
            to_left = DAMPING * to_left + (1 - DAMPING) * (np.logaddexp(0.0, b + both) - np.logaddexp(none, b))
        belief = own + np.bincount(self.right, to_right, self.n) + np.bincount(self.left, to_left, self.n)
        a, b = belief[self.left] - to_left, belief[self.right] - to_right
        top = np.maximum.reduce([a + b + both, none, a, b])
        parts = [np.exp(x - top) for x in (a + b + both, none, a, b)]
        return 1 / (1 + np.exp(-np.clip(belief, -500, 500))), (parts[0] + parts[1]) / sum(parts)


class SkipChain:
    """The trained field."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    @classmethod
    def train(cls, documents: list[list[Mention]], meant: list[list[bool]], steps: int = 80, rate: float = 1.0, decay: float = 0.002) -> SkipChain:
        names: dict[str, int] = {}
        g = Graph(documents, names, grow=True)
        y = np.array([t for d in meant for t in d], float)
        w = np.zeros(len(names))
        seen = np.bincount(g.clue_of, minlength=len(names)).astype(float)
        edges = np.flatnonzero(g.same)
        seen += np.bincount(g.kind[edges], minlength=len(names))
        alike = (y[g.left[edges]] == y[g.right[edges]]).astype(float)
        total = np.full(len(names), 1e-8)
        for _ in range(steps):
            p, agree = g.marginals(w)
            grad = np.bincount(g.clue_of, (y - p)[g.clue_at], len(names))
            grad += np.bincount(g.kind[edges], alike - agree[edges], len(names))
            grad = grad - decay * len(y) * w * (seen > 0) / 10
            total += grad**2
            w = w + rate * grad / np.sqrt(total)
        return cls(names, w)

    def decide(self, documents: list[list[Mention]]) -> list[list[bool]]:
        g = Graph(documents, self.names)
        p, _ = g.marginals(self.weights) if g.n else (np.zeros(0), None)
        out, at = [], 0
        for d in documents:
            out.append((p[at : at + len(d)] > 0.5).tolist())
            at += len(d)
        return out
