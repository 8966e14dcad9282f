"""Regexes over bytes, compiled to transition arrays.

`anchored` gives one rule's automaton from its start; `combined` gives the minimal automaton that reads a text once and
says after each byte which of all rules have a match ending there. Both come from one Thompson construction by subsets.
Supported: literals, \\xHH and escaped characters, classes, groups, |, ?, *, +, {m}, {m,} and {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A byte that no UTF-8 text has; between texts it takes every automaton back to its start.
BREAK = 0xFF


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1


class _Parser:
    """Recursive descent to a tree of ('set', bytes), ('cat', [..]), ('alt', [..]) and ('rep', node, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alt(self):
        options = [self.cat()]
        while self.peek() == "|":
            self.take()
            options.append(self.cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            c = self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.alt()
            self.take()
            return node
        if self.peek() != "[":
            return self.bytes_({self.char()})
        self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                found |= set(range(low, self.char() + 1))
            else:
                found.add(low)
        self.take()
        return self.bytes_(found)

    def bytes_(self, found: set[int]):
        if self.fold:
            found = found | {x ^ 32 for x in found if chr(x).isascii() and chr(x).isalpha()}
        return ("set", frozenset(found))


def _build(nfa: _Nfa, node, start: int) -> int:
    """Adds the node's states after start; returns its end."""
    if node[0] == "set":
        end = nfa.state()
        nfa.on[start].append((node[1], end))
        return end
    if node[0] == "cat":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if node[0] == "alt":
        end = nfa.state()
        for option in node[1]:
            begin = nfa.state()
            nfa.eps[start].append(begin)
            nfa.eps[_build(nfa, option, begin)].append(end)
        return end
    _, inner, low, high = node
    for _ in range(low):
        start = _build(nfa, inner, start)
    if high is None:
        loop = nfa.state()
        nfa.eps[start].append(loop)
        nfa.eps[_build(nfa, inner, loop)].append(loop)
        return loop
    ends = [start]
    for _ in range(high - low):
        start = _build(nfa, inner, start)
        ends.append(start)
    end = nfa.state()
    for x in ends:
        nfa.eps[x].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """next_state[state, class_of[byte]]; accepts[state] is a bit mask of rules. State 0 is the start."""

    class_of: np.ndarray
    next_state: np.ndarray
    accepts: np.ndarray
    dead: int


def _closure(nfa: _Nfa, states) -> frozenset:
    seen, todo = set(states), list(states)
    while todo:
        for x in nfa.eps[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return frozenset(seen)


def _subsets(nfa: _Nfa, start: int, ends: dict[int, int], loop: bool) -> Automaton:
    """loop: the start stays alive at every byte, so that matches may begin anywhere."""
    sets = {s for edges in nfa.on for s, _ in edges}
    sign = [tuple(b in s for s in sets) + (b == BREAK,) for b in range(256)]
    names = {x: i for i, x in enumerate(dict.fromkeys(sign))}
    class_of = np.array([names[x] for x in sign], dtype=np.uint8)
    sample = {int(c): b for b, c in enumerate(class_of)}
    first = _closure(nfa, [start])
    ids, todo, table = {first: 0}, [first], []
    while todo:
        now, row = todo.pop(0), []
        for c in range(len(names)):
            b = sample[c]
            found = {to for s in now for on, to in nfa.on[s] if b in on} if b != BREAK else set()
            new = _closure(nfa, found | ({start} if loop else set()))
            if new not in ids:
                ids[new] = len(ids)
                todo.append(new)
            row.append(ids[new])
        table.append(row)
    accepts = np.array([sum({ends[s] for s in x if s in ends}) for x in ids], dtype=np.int64)
    return _minimised(class_of, np.array(table, dtype=np.int32), accepts, ids.get(frozenset(), -1))


def _minimised(class_of, table, accepts, dead) -> Automaton:
    """Partition refinement: states stay apart if they accept differently or step to states that are apart."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        rows = np.column_stack([part, part[table]])
        new = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == part.max():
            break
        part = new
    order = {}
    for x in part:
        order.setdefault(int(x), len(order))
    part = np.array([order[int(x)] for x in part])
    first = np.array([int(np.argmax(part == k)) for k in range(len(order))])
    return Automaton(class_of, part[table[first]].astype(np.int32), accepts[first], int(part[dead]) if dead >= 0 else -1)


def anchored(pattern: str, ignore_case: bool = False) -> Automaton:
    nfa = _Nfa()
    start = nfa.state()
    end = _build(nfa, _Parser(pattern, ignore_case).alt(), start)
    return _subsets(nfa, start, {end: 1}, loop=False)


def combined(patterns: list[tuple[str, bool]]) -> Automaton:
    """(pattern, ignore_case) pairs; bit k of accepts is pattern k."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, (pattern, fold) in enumerate(patterns):
        begin = nfa.state()
        nfa.eps[start].append(begin)
        ends[_build(nfa, _Parser(pattern, fold).alt(), begin)] = 1 << k
    return _subsets(nfa, start, ends, loop=True)


def scan(a: Automaton, data: bytes, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(positions, masks) of the bytes after which a state accepts, in one pass.

    The bytes are cut into lanes that step together. A lane starts as if at the start state; where the lane before it
    ended in another state, the two paths are followed until they meet. Found positions may then include some that only
    the guessed path has, never fewer than the true ones.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = a.next_state.shape[1]
    classes = a.class_of[np.frombuffer(data, np.uint8)]
    length = max(-(-n // lanes), 64)
    count = -(-n // length)
    grid = np.full(count * length, a.class_of[BREAK], np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(count, length).T).astype(np.int32)
    flat = (a.next_state * k).astype(np.int32).reshape(-1)
    accepting = a.accepts != 0
    hit = np.zeros(len(a.accepts) * k, bool)
    hit[np.flatnonzero(accepting) * k] = True
    state = np.zeros(count, np.int32)
    where, which = [], []
    for i in range(length):
        state = flat[state + grid[i]]
        h = hit[state]
        if h.any():
            found = np.flatnonzero(h)
            where.append(found.astype(np.int64) * length + i)
            which.append(a.accepts[state[found] // k])
    ends = (state // k).tolist()
    next_state, accepts = a.next_state.tolist(), a.accepts.tolist()
    for lane in range(1, count):
        true, guess = ends[lane - 1], 0
        at = lane * length
        stop = min(at + length, n)
        while true != guess and at < stop:
            c = int(classes[at])
            true, guess = next_state[true][c], next_state[guess][c]
            if accepts[true]:
                where.append(np.array([at]))
                which.append(np.array([accepts[true]]))
            at += 1
        if true != guess:
            ends[lane] = true
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(where), np.concatenate(which)


def matches(a: Automaton, data: bytes) -> list[tuple[int, int]]:
    """Leftmost longest matches that do not overlap, as (start, end) in bytes."""
    table, class_of, accepts, dead = a.next_state.tolist(), a.class_of.tolist(), a.accepts.tolist(), a.dead
    alive = bytes(b for b in range(256) if table[0][class_of[b]] != dead)
    can_start = bytearray(256)
    for b in alive:
        can_start[b] = 1
    found, at, n = [], 0, len(data)
    while at < n:
        if not can_start[data[at]]:
            at += 1
            continue
        s, end = 0, -1
        for i in range(at, n):
            s = table[s][class_of[data[i]]]
            if s == dead:
                break
            if accepts[s]:
                end = i + 1
        if end > at:
            found.append((at, end))
            at = end
        else:
            at += 1
    return found
