"""Deep-shallow sorting of byte strings of one length.

Shallow: multikey quicksort on characters of 8 bytes, in numpy, over all groups at
once and only while a group has more than one string. Deep: what is still equal after
SHALLOW bytes goes, group by group, into a blind trie, whose nodes hold only the place
at which strings part; it is read off in order.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def _byte(s: bytes, d: int) -> int:
    return s[d] if d < len(s) else -1


class BlindTrie:
    """Strings of one length by the bytes at which they part; equal strings share a leaf.

    A node is [depth, {byte: child}], a leaf is a list of numbers of strings.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = ("leaf", [i])
            return
        node = self.root
        while node[0] != "leaf":  # blindly: bytes between the nodes are not looked at
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if other == s:
            node[1].append(i)
            return
        d = next(j for j, (a, b) in enumerate(zip(s, other, strict=False)) if a != b) if s[: min(len(s), len(other))] != other[: min(len(s), len(other))] else min(len(s), len(other))
        up, edge, node = None, None, self.root
        while node[0] != "leaf" and node[0] < d:
            up, edge = node, _byte(s, node[0])
            node = node[1][edge] if edge in node[1] else None
            if node is None:
                up[1][edge] = ("leaf", [i])
                return
        if node[0] == d:
            node[1][_byte(s, d)] = ("leaf", [i])
            return
        split = (d, {_byte(other, d): node, _byte(s, d): ("leaf", [i])})
        if up is None:
            self.root = split
        else:
            up[1][edge] = split

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(group: np.ndarray, strings: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings of each group in order, and what each shares with the one before.

    strings has a row of bytes for each; groups come in order of their number, and the
    first string of a group shares -1 with what stands before it.
    """
    m, n = strings.shape
    order = np.argsort(group, kind="stable")
    fresh = np.ones(m, bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    wide = np.zeros((m, -(-n // 8) * 8), np.uint8)
    wide[:, :n] = strings
    chars = wide.view(">u8")
    for c in range(min(shallow // 8, chars.shape[1])):
        part = np.cumsum(fresh) - 1
        many = np.flatnonzero(np.bincount(part, minlength=1)[part] > 1)
        if not len(many):
            break
        own, word = part[many], chars[order[many], c].astype(np.uint64)
        turn = np.lexsort((word, own))
        order[many] = order[many][turn]
        word = word[turn]
        differs = np.ones(len(many), bool)
        differs[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
        fresh[many] |= differs
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, m))
    if n > shallow:
        for a, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = order[a : a + k]
            tails = strings[own, shallow:]
            if (tails == tails[0]).all():
                continue
            order[a : a + k] = own[BlindTrie([x.tobytes() for x in tails]).order()]
    common = np.full(m, -1, np.int64)
    if m > 1:
        for a in range(1, m, 1 << 18):
            b = min(m, a + (1 << 18))
            differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
            common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        g = group[order]
        common[1:][g[1:] != g[:-1]] = -1
    return order, common
