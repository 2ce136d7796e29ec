"""Deep-shallow sorting of strings of one width.

Shallow: multikey quicksort, whose characters are words of 8 bytes, splits the
strings three ways around a pivot word by word, to ``SHALLOW`` words. Deep:
strings that are equal so far are ordered by a blind trie, which compares whole
strings once for each insertion however long their common prefix is.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3
#: Sets that multikey quicksort hands to a plain sort by their next words.
FEW = 64


def _words(rows: np.ndarray) -> np.ndarray:
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """An order of the rows of ``words``, from their first column to their last."""
    out, at = np.empty(len(words), np.int64), 0
    stack = [(np.arange(len(words)), 0)]
    while stack:
        own, depth = stack.pop()
        if not len(own):
            continue
        if depth == words.shape[1] or len(own) == 1:
            out[at : at + len(own)] = own
            at += len(own)
        elif len(own) <= FEW:
            done = own[np.lexsort(words[own, depth:].T[::-1])]
            out[at : at + len(own)] = done
            at += len(own)
        else:
            w = words[own, depth]
            pivot = np.partition(w[:: max(1, len(w) // 1024)], -1 - len(w[:: max(1, len(w) // 1024)]) // 2)[len(w[:: max(1, len(w) // 1024)]) // 2]
            stack += [(own[w > pivot], depth), (own[w == pivot], depth + 1), (own[w < pivot], depth)]
    return out


class BlindTrie:
    """Inner nodes know only at which byte their strings part, so a search may end at a wrong leaf; one comparison with it finds the true place."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: tuple | int = 0  # a leaf is an index, or a list of equal strings' indices; a node (depth, {byte: child})
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node, path = self.strings[i], self.root, []
        while isinstance(node, tuple):
            depth, below = node
            path.append(node)
            node = below.get(s[depth])
            if node is None:
                node = next(iter(below.values()))
        other = self.strings[node[0] if isinstance(node, list) else node]
        if s == other:
            same = node if isinstance(node, list) else [node]
            same.append(i)
            self._replace(path, s, same)
            return
        at = next(k for k, (x, y) in enumerate(zip(s, other)) if x != y)
        while path and path[-1][0] > at:
            path.pop()
        if path and path[-1][0] == at:
            path[-1][1][s[at]] = i
            return
        under = path[-1][1][s[path[-1][0]]] if path else self.root
        node = (at, {other[at]: under, s[at]: i})
        if path:
            path[-1][1][s[path[-1][0]]] = node
        else:
            self.root = node

    def _replace(self, path: list, s: bytes, node) -> None:
        if path:
            path[-1][1][s[path[-1][0]]] = node
        else:
            self.root = node

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif isinstance(node, list):
                out += node
            else:
                out.append(node)
        return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally wide byte rows, and each one's common prefix with the one before (0 for the first)."""
    n = len(rows)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = _words(rows)
    order = multikey_quicksort(words[:, :SHALLOW])
    head = words[order, :SHALLOW]
    new = np.ones(n, bool)
    new[1:] = (head[1:] != head[:-1]).any(1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    two = starts[sizes == 2]
    if len(two):  # one comparison settles a pair
        a, b = order[two], order[two + 1]
        differs = words[a] != words[b]
        at = differs.argmax(1)
        k = np.arange(len(a))
        swap = differs.any(1) & (words[a, at] > words[b, at]) if len(k) else differs.any(1)
        order[two[swap]], order[two[swap] + 1] = b[swap], a[swap]
    for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = order[s : s + size]
        order[s : s + size] = own[BlindTrie([r.tobytes() for r in rows[own, 8 * SHALLOW :]]).order()] if rows.shape[1] > 8 * SHALLOW else own
    lcp = np.zeros(n, np.int64)
    for lo in range(1, n, 1 << 18):
        hi = min(n, lo + (1 << 18))
        other = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        lcp[lo:hi] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return order, lcp
