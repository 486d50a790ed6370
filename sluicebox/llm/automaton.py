"""One minimal deterministic automaton for many regular expressions, as transition arrays.

Expressions are parsed to position automata, joined, made deterministic by subset construction (any
match may begin anywhere) and minimised by refining partitions. The syntax: literals, escapes,
classes, groups, `|`, `?`, `*`, `+`, `{n}`, `{n,}`, `{n,m}`; over bytes.

A state tells of each rule whether a match of it ends here, and whether one is under way. All bytes of a
match lie in one stretch in which its rule is under way, so a rule's matches are sought only in its
stretches, by the rule's own automaton that begins at a given place (`Anchored`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bytes that a lane scans; lanes run side by side.
LANE = 256
#: States before minimisation at which expressions are refused.
MOST_STATES = 200_000


@dataclass
class _Nfa:
    step: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1


class _Parser:
    """Recursive descent; each part becomes a piece of the automaton between two states."""

    def __init__(self, nfa: _Nfa, source: str, either_case: bool):
        self.nfa, self.s, self.i, self.either = nfa, source, 0, either_case

    def parse(self) -> tuple[int, int]:
        piece = self.choice()
        if self.i < len(self.s):
            raise ValueError(f"stray {self.s[self.i]!r} in {self.s!r}")
        return piece

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def choice(self) -> tuple[int, int]:
        pieces = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            pieces.append(self.sequence())
        if len(pieces) == 1:
            return pieces[0]
        a, b = self.nfa.new(), self.nfa.new()
        for x, y in pieces:
            self.nfa.free[a].append(x)
            self.nfa.free[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.nfa.new()
        while self.peek() and self.peek() not in "|)":
            x, y = self.repeated()
            self.nfa.free[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        at = self.i
        piece = self.atom()
        end = self.i
        c = self.peek()
        if c and c in "?*+":
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{":
            close = self.s.index("}", self.i)
            a, comma, b = self.s[self.i + 1 : close].partition(",")
            low, high = int(a), (int(b) if b else None) if comma else int(a)
            self.i = close + 1
        else:
            return piece
        after = self.i

        def again() -> tuple[int, int]:
            self.i = at
            out = self.atom()
            assert self.i == end
            return out

        first = last = self.nfa.new()
        for k in range(max(low, 1) if high is None else high):
            x, y = piece if k == 0 else again()
            self.nfa.free[last].append(x)
            stop = self.nfa.new()
            self.nfa.free[y].append(stop)
            if k >= low:
                self.nfa.free[last].append(stop)
            if high is None and k == max(low, 1) - 1:
                self.nfa.free[y].append(x)
            last = stop
        self.i = after
        return first, last

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.i += 3 if self.s[self.i + 1 : self.i + 3] == "?:" else 1
            piece = self.choice()
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.s!r}")
            self.i += 1
            return piece
        chars = self.klass() if c == "[" else self.char()
        if self.either:
            chars = {ord(x) for v in chars for x in ({chr(v).lower(), chr(v).upper()} if v < 128 else {chr(v)})}
        a, b = self.nfa.new(), self.nfa.new()
        self.nfa.step[a].append((frozenset(chars), b))
        return a, b

    def char(self, inside: bool = False) -> set[int]:
        """One character or escape; a point is any byte but a line end, in a class itself."""
        c = self.peek()
        self.i += 1
        if c == "\\":
            c = self.peek()
            self.i += 1
            if c == "x":
                self.i += 2
                return {int(self.s[self.i - 2 : self.i], 16)}
            return {ord({"t": "\t", "n": "\n", "r": "\r"}.get(c, c))}
        return {ord(c)} if c != "." or inside else set(range(256)) - {10}

    def klass(self) -> set[int]:
        self.i += 1
        outside = self.peek() == "^"
        self.i += outside
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char(True)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(min(low), min(self.char(True)) + 1))
            else:
                found |= low
        self.i += 1
        return set(range(256)) - found if outside else found


class Automaton:
    """table[state, class] is the next state; accepts[state] and alive[state] are the bits of rules of which
    a match ends there, or is under way.

    State 0 is the start; class 0 is a separator of texts that leads back to it.
    """

    def __init__(self, expressions: list[tuple[str, bool]], anchored: bool = False):
        nfa = _Nfa()
        start = nfa.new()
        ends, owner = {}, [0]
        for k, (source, either_case) in enumerate(expressions):
            a, b = _Parser(nfa, source, either_case).parse()
            nfa.free[start].append(a)
            ends[b] = 1 << k
            owner += [1 << k] * (len(nfa.step) - len(owner))
        self.rules = len(expressions)
        self.classes, members = self._byte_classes(nfa)
        table, accepts, alive = self._subsets(nfa, start, ends, owner, members, anchored)
        self.table, self.accepts, self.alive = self._minimal(table, accepts, alive)

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no expression tells apart share a class; a member of each."""
        sets = sorted({chars for steps in nfa.step for chars, _ in steps}, key=sorted)
        seen: dict[tuple, int] = {}
        of = np.zeros(256, np.uint8)
        members = []
        for byte in range(256):
            mark = tuple(byte in s for s in sets)
            if mark not in seen:
                seen[mark] = len(seen) + 1
                members.append(byte)
            of[byte] = seen[mark]
        return of, members

    @staticmethod
    def _subsets(nfa: _Nfa, start: int, ends: dict[int, int], owner: list[int], members: list[int], anchored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets of (position, whether a byte was read on the way): so a match under way differs from none."""
        n = len(nfa.step)

        def closed(state: int) -> frozenset:
            out, todo = set(), [state]
            while todo:
                s = todo.pop()
                if s not in out:
                    out.add(s)
                    todo += nfa.free[s]
            return frozenset(s for s in out if nfa.step[s] or s in ends)

        begun = [frozenset(s + n for s in closed(k)) for k in range(n)]
        leads = [[frozenset().union(*(begun[to] for chars, to in steps if byte in chars)) for byte in members] for steps in nfa.step]
        first = closed(start)
        again = frozenset() if anchored else first
        number, rows, todo = {first: 0}, [], [first]
        while todo:
            state = todo.pop()
            row = [0]
            moving = [leads[s % n] for s in state if nfa.step[s % n]]
            for k in range(len(members)):
                target = again.union(*(x[k] for x in moving if x[k]))
                if target not in number:
                    if len(number) >= MOST_STATES:
                        raise ValueError("these expressions need too many states together")
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append((number[state], row))
        rows = [row for _, row in sorted(rows)]
        accepts, alive = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for state, k in number.items():
            for s in state:
                if s >= n:
                    accepts[k] |= ends.get(s - n, 0)
                    alive[k] |= owner[s - n]
        return np.array(rows, np.int64), accepts, alive

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split groups of states by where their steps lead, until nothing splits."""
        group = np.unique(np.column_stack([accepts, alive]), axis=0, return_inverse=True)[1].ravel()
        while True:
            mark = np.column_stack([group, group[table]])
            finer = np.unique(mark, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        # number the groups in the order of their first states, so the start stays 0
        first = np.unique(group, return_index=True)[1]
        order = np.argsort(np.argsort(first))
        group = order[group]
        keep = np.sort(first)
        return group[table[keep]].astype(np.int32), accepts[keep], alive[keep]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Accept and alive bits after each byte of the texts, with a zero after each text: one pass over the bytes.

        The bytes are cut into lanes that step side by side, each from the start state. A lane whose
        predecessor ended in another state is stepped again from there until it meets its first run.
        """
        rows = len(offs) - 1
        symbols = np.zeros(len(data) + rows, np.uint8)
        symbols[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offs))] = self.classes[data]
        lanes = max(1, -(-len(symbols) // LANE))
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[: len(symbols)] = symbols
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        width = self.table.shape[1]
        flat = (self.table * width).ravel().astype(np.int32)  # states as row offsets
        path = np.empty((LANE, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(LANE):
            state = flat[state + columns[t]]
            path[t] = state
        begun = np.zeros(lanes, np.int32)
        while True:
            should = np.concatenate([[0], path[-1, :-1]]).astype(np.int32)
            open_ = np.flatnonzero(should != begun)
            if not len(open_):
                break
            begun[open_] = should[open_]
            state = should[open_]
            for t in range(LANE):
                state = flat[state + columns[t, open_]]
                apart = state != path[t, open_]
                if not apart.all():
                    open_, state = open_[apart], state[apart]
                    if not len(open_):
                        break
                path[t, open_] = state
        bits = np.zeros(len(self.table) * width, np.uint32)
        bits[::width] = (self.accepts << 16) | self.alive
        marks = bits[path].T.ravel()[: len(symbols)]
        return (marks >> np.uint32(16)).astype(np.uint16), marks.astype(np.uint16)

    def stretches(self, accepts: np.ndarray, alive: np.ndarray, least: list[int]) -> list[tuple[int, int, int]]:
        """(rule, first, end) of the stretches of at least so many bytes in which a rule is under way and a match of it ends."""
        if not len(alive):
            return []
        bounds = np.concatenate([[0], np.flatnonzero(alive[1:] != alive[:-1]) + 1, [len(alive)]])
        value = alive[bounds[:-1]]
        out = []
        for rule in range(self.rules):
            inside = ((value >> np.uint16(rule)) & np.uint16(1)).astype(np.int8)
            steps = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
            first, end = bounds[steps[::2]], bounds[steps[1::2]]
            long = np.flatnonzero(end - first >= least[rule])
            out += [(rule, int(a), int(b)) for a, b in zip(first[long], end[long], strict=True) if ((accepts[a:b] >> np.uint16(rule)) & np.uint16(1)).any()]
        return out


class Anchored:
    """One expression whose matches begin at a given place; the longest one counts."""

    def __init__(self, source: str, either_case: bool = False):
        made = Automaton([(source, either_case)], anchored=True)
        self.classes = made.classes.tolist()
        self.table, self.accepts, self.dead = made.table.tolist(), (made.accepts != 0).tolist(), (made.alive == 0).tolist()

    def end(self, data: bytes, at: int) -> int:
        """The end of the longest match from a place on, -1 if there is none."""
        state, found = 0, -1
        for k in range(at, len(data)):
            state = self.table[state][self.classes[data[k]]]
            if self.accepts[state]:
                found = k + 1
            elif self.dead[state]:
                break
        return found

    def shortest(self) -> int:
        """Bytes of the shortest match; 0 for an expression that takes nothing."""
        seen, todo, n = {0}, [0], 0
        while todo:
            if any(self.accepts[s] for s in todo):
                return n
            todo = sorted({t for s in todo for t in self.table[s][1:]} - seen)
            seen.update(todo)
            n += 1
        return 0
