"""Cheapest repair of a sequence of turns by tables of whole blocks.

A turn is one of nine symbols: to be deleted, or the initial of its role (s, u,
a, other) with an open or a finished end. Repaired roles read ``(s?(ua)+)?``, so
a repair is in one of four states: nothing yet, after s, after u, after a. The
cost vector of a place has the least cost of the rest from each state. Vectors
differ by their least entry and one of few normalised forms, so that a table
gives, for every block of four symbols and every form behind it, the form
before it and the difference. Blocks are walked backward by look-up; for
the edits each block is expanded again, backward from the form behind it, and
then walked forward with the least letter of those that keep the least cost."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

DELETE, INSERT, REROLE, OPEN_END = 4, 3, 3, 3   # costs
BLOCK = 4                                       # symbols of a block
MUST_DELETE = 0
ROLES = "sua"                                   # initials that a repaired turn may keep
SYMBOLS = 1 + 2 * (len(ROLES) + 1)
FAR = 1 << 40                                   # no way
_NEXT = (2, 2, 3, 2)                            # state after the user or assistant turn that fits
_KEEP = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))   # by state and initial
ACCEPT = (0, 6, 3, 0)                           # cost of the end itself


def symbol(initial: str, open_end: bool) -> int:
    place = ROLES.find(initial) if initial else -1
    return 1 + 2 * (place if place >= 0 else len(ROLES)) + open_end


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a turn."""
    found = [("D", DELETE, state)]
    if sym != MUST_DELETE:
        role, open_end = divmod(sym - 1, 2)
        kept = _KEEP[state][role] if role < len(ROLES) else None
        if kept is not None:
            found.append(("K", open_end * OPEN_END, kept))
        found.append(("R", REROLE + open_end * OPEN_END, _NEXT[state]))
    return found


def step(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, insertions included."""
    v = [min(cost + after[to] for _, cost, to in edits(sym, q)) for q in range(4)]
    for _ in range(3):
        v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
    return tuple(min(x, FAR) for x in v)


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(FAR if x >= FAR // 2 else x - low for x in v), low


class Tables:
    """All normalised vectors that follow from the accepting end or from the
    demand to end in one given state, and the block transitions between them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        starts = [ACCEPT] + [tuple(0 if q == to else FAR for q in range(4)) for to in range(4)]
        self.vectors, self.number = [], {}
        for v in starts:
            self._add(v)
        ways = []
        for v in self.vectors:   # grows while it is read
            ways.append([])
            for sym in range(SYMBOLS):
                form, low = _normal(step(sym, v))
                ways[-1].append((self._add(form), low))
        self.one = [[(n, low) for n, low in row] for row in ways]
        form = np.array([[n for n, _ in row] for row in ways]).T    # symbol, form behind -> form before
        low = np.array([[c for _, c in row] for row in ways]).T
        self.form, self.low = form, low
        for _ in range(block - 1):   # one symbol more in front
            behind, cost = self.form, self.low
            self.form = np.concatenate([form[s][behind] for s in range(SYMBOLS)])
            self.low = np.concatenate([cost + low[s][behind] for s in range(SYMBOLS)])

    def _add(self, v: tuple[int, ...]) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def find(self, vector) -> tuple[int, int]:
        """Number and difference of a vector; any that follows from the given ends is known."""
        form, low = _normal(tuple(int(x) for x in vector))
        if form not in self.number:   # an end vector of a longer repair
            raise KeyError(form)
        return self.number[form], low


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def backward(marks: str, vector) -> tuple[tuple[int, ...], list[int], list[int]]:
    """The cost vector before ``marks`` (one digit per turn) given the one
    behind them, the cuts between blocks, and the form behind each block."""
    t = tables()
    form, total = t.find(vector)
    cuts = [*range(len(marks) % t.block, len(marks) + 1, t.block)]
    behind = [0] * (len(cuts) - 1)
    for b in range(len(cuts) - 2, -1, -1):
        behind[b] = form
        code = int(marks[cuts[b]:cuts[b + 1]], SYMBOLS)
        total += int(t.low[code, form])
        form = int(t.form[code, form])
    if cuts[0]:   # the rest in front is shorter than a block
        cuts, behind = [0, *cuts], [form, *behind]
        for s in reversed(marks[:cuts[1]]):
            form, low = t.one[form][int(s)]
            total += low
    return tuple(x + total if x < FAR else FAR for x in t.vectors[form]), cuts, behind


def matrix(marks: str) -> list[int]:
    """Least cost from each state before ``marks`` to each state behind them, row by row."""
    ends = [backward(marks, tuple(0 if q == to else FAR for q in range(4)))[0] for to in range(4)]
    return [ends[to][q] for q in range(4) for to in range(4)]


def before(ways: list[int], vector) -> list[int]:
    """The vector before a stretch from its matrix and the vector behind it."""
    return [min(min(ways[4 * q + to] + int(vector[to]) for to in range(4)), FAR) for q in range(4)]


@lru_cache(1 << 14)
def trace(marks: str, vector: tuple[int, ...], start: int, last: bool = True) -> tuple[str, list[int], int]:
    """Letters of the cheapest edits from state ``start``, the least in ASCII
    of all cheapest ones; what is taken: 3 * place for a turn kept, 1 more for
    one made user, 2 more for one made assistant, -1 and -2 for an inserted user
    and assistant; and the state behind. With ``last`` the end's insertions too."""
    t = tables()
    _, cuts, behind = backward(marks, vector)
    state, letters, taken = start, [], []

    def put_in():
        nonlocal state
        state = _NEXT[state]
        letters.append("I")
        taken.append(-1 if state == 2 else -2)

    for b, form in enumerate(behind):
        lo, hi = cuts[b], cuts[b + 1]
        inside = [t.vectors[form]]
        for s in reversed(marks[lo:hi]):   # the block's vectors, each up to one difference
            inside.append(step(int(s), inside[-1]))
        inside.reverse()
        for i in range(lo, hi):
            here, after, sym = inside[i - lo], inside[i - lo + 1], int(marks[i])
            while True:
                ways = [(letter, to) for letter, cost, to in edits(sym, state) if cost + after[to] == here[state]]
                inserted = INSERT + here[_NEXT[state]] == here[state]
                if inserted and not (ways and ways[0][0] == "D"):   # D < I < K < R
                    put_in()
                    continue
                letter, to = ways[0]
                break
            if letter != "D":
                taken.append(3 * i + (0 if letter == "K" else 1 if to == 2 else 2))
            letters.append(letter)
            state = to
    while last and state in (1, 2):
        put_in()
    return "".join(letters), taken, state
