"""Best segmentations as a max-plus scan over chunks.

A lattice over a text has an edge for each piece; the best path has the largest
sum of scores. Cut into chunks, the text has a small state at each boundary: by
how many characters the piece across it reaches into the next chunk. A chunk is
then a matrix of the best scores from each entry state to each exit state, and
matrices combine by the max-plus product, which is associative. From the best
states at the boundaries each chunk is traced back on its own.
"""

from __future__ import annotations

import numpy as np

NONE = -np.inf


class Lattice:
    """Pieces with scores. A character that no piece covers alone costs ``unknown`` and has the id ``unknown_id``."""

    def __init__(self, scores: dict[str, tuple[int, float]], unknown: float, unknown_id: int):
        self.scores, self.unknown, self.unknown_id = scores, unknown, unknown_id
        self.longest = max(map(len, scores), default=1)
        self.heads: dict[str, list[int]] = {}  # by first character, the lengths that occur
        for piece in scores:
            self.heads.setdefault(piece[0], []).append(len(piece))
        self.heads = {k: sorted(set(v)) for k, v in self.heads.items()}

    def edges(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(length, id, score) of the pieces that start at ``at``, shortest first."""
        found = []
        for n in self.heads.get(text[at], ()):
            if at + n <= len(text) and (hit := self.scores.get(text[at : at + n])):
                found.append((n, *hit))
        if not found or found[0][0] != 1:
            found.insert(0, (1, self.unknown_id, self.unknown))
        return found

    def transfer(self, text: str, size: int, last: bool) -> np.ndarray:
        """The matrix of a chunk: the first ``size`` characters of ``text``, with what follows as far as a piece can reach. The last chunk ends in state 0."""
        states = self.longest
        best = np.full((size + states, states), NONE)
        for k in range(min(states, size)):
            best[k, k] = 0.0
        for at in range(size):
            here = best[at]
            if here.max() == NONE:
                continue
            for n, _, score in self.edges(text, at):
                np.maximum(best[at + n], here + score, out=best[at + n])
        out = best[size : size + states].T.copy()
        for k in range(size, states):  # a piece may reach across a short chunk
            out[k, k - size] = 0.0
        if last:
            out[:, 1:] = NONE
        return out

    def trace(self, text: str, size: int, entry: int, leave: int) -> list[int]:
        """The ids of the pieces that start in a chunk, on the best path between two states; of equal paths the one whose last piece is longest."""
        end = size + leave
        best, back = [NONE] * (size + self.longest + 1), [(0, 0)] * (size + self.longest + 1)
        if entry >= size:
            return []
        best[entry] = 0.0
        for at in range(entry, size):
            if best[at] == NONE:
                continue
            for n, piece, score in self.edges(text, at):
                if best[at] + score > best[at + n]:
                    best[at + n], back[at + n] = best[at] + score, (at, piece)
        found = []
        while end > entry:
            end, piece = back[end]
            found.append(piece)
        return found[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; it is associative."""
    return (a[:, :, None] + b[None]).max(1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The products of the first 1, 2, ... matrices, by halving (a parallel scan)."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = prefixes([product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    return [matrices[0] if i == 0 else pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]) for i in range(len(matrices))]


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state before each chunk and after the last, on a best path; it starts and ends in state 0."""
    total, states = prefixes(matrices), [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(total[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]] if matrices else [0]
