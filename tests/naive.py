"""Independent models: suffix trees by enumerating substrings."""

END = chr(0x10FFFF)


def tree(t: str):
    """(edges in traversal order, nodes) of the suffix tree of t.

    Edges: (parent, parent depth, child, child depth, label, suffix link);
    nodes: id -> (depth, head position).
    """
    n = len(t)
    occurrences: dict[str, list] = {}
    for i in range(n + 1):
        for j in range(n - i + 1):
            occurrences.setdefault(t[i : i + j], []).append((i + 1, t[i + j] if i + j < n else END))
    found = []
    for w, o in occurrences.items():
        if w == "" or len({c for _, c in o}) > 1:
            lead = min(o)[1]
            found.append((0 if w == "" else min(i for i, c in o if c != lead), w))
    found.sort()
    ids = {w: k + 1 for k, (_, w) in enumerate(found)}

    def above(path):
        return next(path[:k] for k in range(len(path) - 1, -1, -1) if path[:k] in ids)

    rows = []
    for w in ids:
        if w:
            p = above(w)
            rows.append((w, ids[p], len(p), ids[w], len(w), w[len(p) :], ids[w[1:]]))
    for i in range(n + 1):
        path = t[i:] + END
        p = above(path)
        rows.append((path, ids[p], len(p), -(i + 1), len(path), path[len(p) : -1] + "$", 0))
    return [r[1:] for r in sorted(rows)], {ids[w]: (len(w), h) for h, w in found}


def implicit(x: str):
    """Paths of branching nodes and leaf starts of the tree of x without terminator."""
    where: dict[str, list[int]] = {}
    for i in range(len(x)):
        for j in range(i, len(x) + 1):
            where.setdefault(x[i:j], []).append(i)
    nodes = {""} | {w for w, at in where.items() if len({x[i + len(w)] for i in at if i + len(w) < len(x)}) >= 2}
    leaves = [i + 1 for i in range(len(x)) if len(where[x[i:]]) == 1]
    return nodes, leaves
