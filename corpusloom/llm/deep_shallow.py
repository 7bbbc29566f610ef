"""Deep-shallow suffix sorting of the strings of one group, for tasks.

Multikey quicksort orders the strings by their bytes to a shallow depth.  The
groups that still share a prefix there are ordered by blind tries: a trie of
branching depths in which a new string is compared with one leaf only, whose
common prefix shows where the string belongs.
"""

from __future__ import annotations

SHALLOW = 16


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first ``start`` bytes are known to be equal."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    step = 8
    while a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    while step > 1:
        step //= 2
        if a[start : start + step] == b[start : start + step]:
            start += step
    return start


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _blind_trie(strings: list[bytes], order: list[int], depth: int) -> list[int]:
    """``order`` sorted; all its strings are equal up to ``depth``."""
    # a node is [branching depth, {byte: node or leaf}]; a leaf is the list of equal strings
    root: list | None = None
    for i in order:
        s = strings[i]
        if root is None:
            root = [i]
            continue
        node, path = root, []
        while isinstance(node[-1], dict):  # blind descent: branching bytes only
            path.append(node)
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        same = common_prefix(s, other, depth)
        if same == len(s) == len(other):
            node.append(i)
            continue
        at = next((k for k, x in enumerate(path) if x[0] >= same), len(path))
        if at < len(path) and path[at][0] == same:
            path[at][1][_byte(s, same)] = [i]
            continue
        below = path[at] if at < len(path) else node
        new = [same, {_byte(other, same): below, _byte(s, same): [i]}]
        if at == 0:
            root = new
        else:
            path[at - 1][1][_byte(s, path[at - 1][0])] = new
    out: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Positions of ``strings`` in the order of their bytes; equal strings in the given order."""
    out: list[int] = []
    work = [(list(range(len(strings))), 0)]
    while work:
        order, depth = work.pop()
        if len(order) < 2:
            out += order
        elif depth >= shallow:
            out += _blind_trie(strings, order, depth)
        else:
            pivot = _byte(strings[order[len(order) // 2]], depth)
            low, same, high = [], [], []
            for i in order:
                c = _byte(strings[i], depth)
                (low if c < pivot else same if c == pivot else high).append(i)
            work.append((high, depth))
            if pivot < 0:  # these strings end here and are equal
                work.append((same, shallow) if len(same) < 2 else (same, shallow))
            else:
                work.append((same, depth + 1))
            work.append((low, depth))
    return out


def neighbours(strings: list[bytes], order: list[int]) -> list[int]:
    """Common prefix of each sorted string with the one before it; 0 for the first."""
    return [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))]
