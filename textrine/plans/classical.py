"""The classical constructions, one text at a time, to compare the kernel with.

McCreight's and Ukkonen's, each simple (every insertion starts at the root) and
with suffix links, and partition and write-only top down. A loop per character
in Python: for short texts, nothing else is made with it.
"""

from __future__ import annotations

END = chr(0x10FFFF)


class Tree:
    """Nodes by number, 0 the root: children by letter, label, depth and parent."""

    def __init__(self, text: str):
        self.s = text + END
        self.n = len(self.s)
        self.children: list[dict[str, int]] = [{}]
        self.start, self.stop, self.depth, self.parent = [0], [0], [0], [0]
        self.link = {0: 0}

    def add(self, parent: int, start: int, stop: int) -> int:
        """A node below ``parent`` with the label s[start:stop]."""
        k = len(self.children)
        self.children.append({})
        self.start.append(start), self.stop.append(stop), self.parent.append(parent)
        self.depth.append(self.depth[parent] + stop - start)
        self.children[parent][self.s[start]] = k
        return k

    def split(self, child: int, k: int) -> int:
        """A node after k letters of the label of ``child``."""
        a = self.start[child]
        middle = self.add(self.parent[child], a, a + k)
        self.start[child], self.parent[child] = a + k, middle
        self.children[middle][self.s[a + k]] = child
        return middle

    def down(self, node: int, a: int, b: int) -> tuple[int, int, int]:
        """The place of s[a:b] below ``node`` by label lengths: last node, letters passed, child under way (0 on a node)."""
        while a < b:
            child = self.children[node][self.s[a]]
            size = self.stop[child] - self.start[child]
            if size > b - a:
                return node, b - a, child
            node, a = child, a + size
        return node, 0, 0

    def edges(self) -> list[str]:
        """Labels in traversal order, "$" for the terminator."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if node:
                label = self.s[self.start[node] : self.stop[node]]
                out.append(label[:-1] + "$" if self.stop[node] == self.n else label)
            todo += [c for _, c in sorted(self.children[node].items(), reverse=True)]
        return out


def mccreight(text: str, linked: bool) -> Tree:
    t = Tree(text)
    head = 0
    for i in range(t.n):
        node = 0
        if linked and head in t.link:
            node = t.link[head]
        elif linked:
            above = t.parent[head]
            node, k, child = t.down(t.link[above], t.start[head] + (above == 0), t.stop[head])
            node = t.link[head] = t.split(child, k) if child else node
        at = i + t.depth[node]
        while child := t.children[node].get(t.s[at]):
            k, a = 0, t.start[child]
            while a + k < t.stop[child] and t.s[a + k] == t.s[at + k]:
                k += 1
            at += k
            if a + k < t.stop[child]:
                node = t.split(child, k)
                break
            node = child
        t.add(node, at, t.n)
        head = node
    return t


def ukkonen(text: str, linked: bool) -> Tree:
    t = Tree(text)
    j = node = 0
    for i in range(t.n):
        last = None
        while j <= i:
            node, k, child = t.down(node, j + t.depth[node], i)
            if last is not None and not child:
                t.link[last], last = node, None
            if (t.s[t.start[child] + k] == t.s[i]) if child else t.s[i] in t.children[node]:
                break
            at = t.split(child, k) if child else node
            if last is not None:
                t.link[last] = at
            last = at if child else None
            t.add(at, i, t.n)
            j += 1
            node = t.link.get(node, 0) if linked else 0
        if not linked:
            node = 0
    return t


def top_down(text: str) -> Tree:
    t = Tree(text)
    todo = [(0, list(range(t.n)))]
    while todo:
        node, starts = todo.pop()
        groups: dict[str, list[int]] = {}
        for i in starts:
            groups.setdefault(t.s[i + t.depth[node]], []).append(i)
        for some in groups.values():
            a = b = some[0] + t.depth[node]
            if len(some) == 1:
                t.add(node, a, t.n)
                continue
            while len({t.s[i + t.depth[node] + b - a] for i in some}) == 1:
                b += 1
            todo.append((t.add(node, a, b), some))
    return t


#: The constructions by the names of ``options``.
BUILD = {
    "A": lambda text: mccreight(text, False), "M": lambda text: mccreight(text, True),
    "B": lambda text: ukkonen(text, False), "U": lambda text: ukkonen(text, True), "P": top_down,
}
