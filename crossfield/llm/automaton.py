"""Regular expressions over bytes, compiled to one minimal deterministic automaton.

A pattern is a nested tuple, built by the small functions below. All patterns are compiled
together: positions of the patterns (one per byte class) form a non-deterministic automaton,
subset construction makes it deterministic over byte classes, and partition refinement makes
it minimal. The result is a transition array with one row per state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def chars(spec: str | bytes, fold: bool = False) -> tuple:
    """One byte out of a set; ``a-z`` ranges as in a bracket expression, ``fold`` for both cases."""
    data = spec.encode() if isinstance(spec, str) else spec
    found, i = set(), 0
    while i < len(data):
        if i + 2 < len(data) and data[i + 1] == ord("-"):
            found |= set(range(data[i], data[i + 2] + 1))
            i += 3
        else:
            found.add(data[i])
            i += 1
    if fold:
        found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
    return ("set", frozenset(found))


def text(literal: str, fold: bool = False) -> tuple:
    return seq(*[chars(c.encode() if c != "-" else b"-", fold) for c in literal])


def seq(*parts: tuple) -> tuple:
    return ("seq", *parts)


def either(*parts: tuple) -> tuple:
    return ("or", *parts)


def maybe(part: tuple) -> tuple:
    return ("or", ("seq",), part)


def many(part: tuple, least: int = 0) -> tuple:
    """A run of ``part`` (a set of bytes) of at least that length."""
    return ("many", part, least)


def times(part: tuple, n: int) -> tuple:
    """A run of ``part`` (a set of bytes) of exactly that length; in a search it ends the pattern."""
    return ("times", part, n)


@dataclass
class Automaton:
    """``next[state, byte]``; state 0 is the start, ``dead`` never accepts again; ``accepts[state]`` is a bit per pattern."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int

    def __post_init__(self):
        self.rows = [row.tolist() for row in self.next]
        self.marks = self.accepts.tolist()


def _positions(patterns: list[tuple]) -> tuple[list[frozenset], list[set], list[int], list[tuple[set, bool, set]]]:
    """Byte sets, followers and runs of all positions, and (first, empty, last) of each pattern."""
    sets: list[frozenset] = []
    follow: list[set] = []
    runs: list[int] = []

    def walk(node: tuple) -> tuple[set, bool, set]:
        kind, *parts = node
        if kind == "set":
            sets.append(parts[0])
            follow.append(set())
            runs.append(-1)
            return {len(sets) - 1}, False, {len(sets) - 1}
        if kind in ("many", "times"):
            (_, allowed), least = parts
            first, n = len(sets), max(least, 1)
            for p in range(first, first + n):
                sets.append(allowed)
                follow.append({p + 1} if p < first + n - 1 else {p} if kind == "many" else set())
                runs.append(first)
            return {first}, least == 0, {first + n - 1}
        if kind == "or":
            found = [walk(p) for p in parts]
            return set().union(*[f for f, _, _ in found]), any(e for _, e, _ in found), set().union(*[z for _, _, z in found])
        first, empty, last = set(), True, set()
        for part in parts:
            f, e, z = walk(part)
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            last = last | z if e else z
            empty = empty and e
        return first, empty, last

    ends = [walk(p) for p in patterns]
    return sets, follow, runs, ends


def compile_patterns(patterns: list[tuple], anywhere: bool) -> Automaton:
    """``anywhere``: a match may start at any byte (search); otherwise only at the first one."""
    sets, follow, runs, ends = _positions(patterns)
    begin = frozenset().union(*[f for f, _, _ in ends])
    mark = [0] * len(sets)
    for k, (_, _, last) in enumerate(ends):
        for p in last:
            mark[p] |= 1 << k
    # Bytes that no pattern tells apart share a class.
    kinds: dict[frozenset, int] = {}
    of_byte = np.array([kinds.setdefault(frozenset(p for p, s in enumerate(sets) if b in s), len(kinds)) for b in range(256)])
    holds = list(kinds)

    def furthest(reached: set) -> frozenset:
        """Of the positions of one run only the last: it accepts all that the earlier ones accept."""
        last: dict[int, int] = {}
        for p in reached:
            if runs[p] >= 0:
                last[runs[p]] = max(p, last.get(runs[p], p))
        return frozenset(p for p in reached if runs[p] < 0 or last[runs[p]] == p)

    # Subset construction: a state is the set of positions just read; the start has read none.
    start = frozenset([-1])
    states, queue, table = {start: 0}, [start], []
    while queue:
        state = queue.pop(0)
        able = set(begin) if anywhere or -1 in state else set()
        for p in state:
            if p >= 0:
                able |= follow[p]
        row = []
        for held in holds:
            then = furthest(able & held)
            if then not in states:
                states[then] = len(states)
                queue.append(then)
            row.append(states[then])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([sum({1 << k for p in s if p >= 0 for k in range(len(patterns)) if mark[p] >> k & 1}) for s in states], dtype=np.int64)
    # Minimisation: split blocks by the blocks their transitions lead to, until none splits.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[moves]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # Number the blocks by first appearance, so that the start is state 0.
    _, first = np.unique(block, return_index=True)
    order = np.argsort(np.argsort(first))
    block, rows = order[block], np.sort(first)
    small = block[moves[rows]]
    dead = [i for i in range(len(rows)) if not accepts[rows[i]] and (small[i] == i).all()]
    return Automaton(small[:, of_byte].astype(np.int32), accepts[rows], dead[0] if dead else -1)


def search(automaton: Automaton, data: bytes) -> int:
    """Bits of all patterns that match somewhere: one pass over the bytes."""
    rows, marks = automaton.rows, automaton.marks
    state = found = 0
    for byte in data:
        state = rows[state][byte]
        if marks[state]:
            found |= marks[state]
    return found


def spans(automaton: Automaton, data: bytes) -> list[tuple[int, int]]:
    """Leftmost-longest matches of an anchored automaton that do not overlap."""
    rows, marks, dead = automaton.rows, automaton.marks, automaton.dead
    begins = [s != dead for s in rows[0]]
    out, at, size = [], 0, len(data)
    while at < size:
        if not begins[data[at]]:
            at += 1
            continue
        state, end = 0, -1
        for i in range(at, size):
            state = rows[state][data[i]]
            if state == dead:
                break
            if marks[state]:
                end = i + 1
        if end < 0:
            at += 1
        else:
            out.append((at, end))
            at = end
    return out
