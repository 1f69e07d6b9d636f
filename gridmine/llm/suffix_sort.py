"""Deep-shallow sorting of byte strings: multikey quicksort, then blind tries (inside tasks)."""

from __future__ import annotations

import numpy as np

#: Bytes compared by multikey quicksort; strings equal so far go to a blind trie.
SHALLOW = 32
_WORD = 8
_SMALL = 24
_END = -1


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie over strings: inner nodes keep only the depth they branch at.

    A string is looked up by its branching bytes alone, compared once with the leaf it ends in, and
    inserted where the two part.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # inner node: [depth, {byte: node}], leaf: [None, [numbers]]

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else _END

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = [None, [number]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(number)
            return
        parent, byte, node = None, 0, self.root
        while node[0] is not None and node[0] < depth:
            parent, byte = node, self._byte(s, node[0])
            node = node[1][byte]
        leaf = [None, [number]]
        if node[0] == depth:
            node[1][self._byte(s, depth)] = leaf
            return
        branch = [depth, {self._byte(other, depth): node, self._byte(s, depth): leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][byte] = branch

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            depth, held = stack.pop()
            if depth is None:
                out.extend(held)
            else:
                stack.extend(held[b] for b in sorted(held, reverse=True))
        return out


def _words(strings: list[bytes]) -> np.ndarray:
    """The first ``SHALLOW`` bytes as big-endian numbers, short strings filled with zeros."""
    return np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(len(strings), SHALLOW // _WORD).astype(np.uint64)


def sort(strings: list[bytes]) -> np.ndarray:
    """The order of the strings: shallow by multikey quicksort on words, deep by blind tries."""
    words = _words(strings)
    out: list[int] = []
    todo: list[tuple[np.ndarray, int]] = [(np.arange(len(strings)), 0)] if strings else []
    while todo:
        part, depth = todo.pop()
        if len(part) == 1:
            out.append(int(part[0]))
        elif depth == words.shape[1]:
            trie = BlindTrie(strings)
            for number in part.tolist():
                trie.insert(number)
            out.extend(trie.order())
        elif len(part) <= _SMALL:
            keys = sorted((words[i].tolist(), i) for i in part.tolist())
            first = 0
            groups = []
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k][0] != keys[first][0]:
                    groups.append(np.array([i for _, i in keys[first:k]]))
                    first = k
            todo.extend((g, words.shape[1]) for g in reversed(groups))
        else:
            column = words[part, depth]
            pivot = np.sort(column[:: max(1, len(column) // 9)][:9])[4 if len(column) >= 9 else 0]
            less, equal, more = part[column < pivot], part[column == pivot], part[column > pivot]
            # the stack is walked from its end: small ones first
            todo.extend((p, d) for p, d in ((more, depth), (equal, depth + 1), (less, depth)) if len(p))
    return np.array(out, dtype=np.int64)


def neighbours(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Common prefix of each string, in order, with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    seq = order.tolist()
    for k in range(1, len(seq)):
        out[k] = common_prefix(strings[seq[k - 1]], strings[seq[k]])
    return out
