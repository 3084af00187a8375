"""Rule regexes compiled together into one minimal deterministic automaton over bytes.

The standard library parses a rule; this module turns the parsed form into a nondeterministic automaton, runs
the subset construction over byte classes, merges equivalent states and lays the result out as one row of 256
successor numbers per state. Patterns must consume ASCII only, so that bytes and characters agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from re import _constants as op
from re import _parser

BYTES = 256


class _Nfa:
    """Thompson automaton: ``eps[s]`` are free moves, ``on[s]`` is (set of bytes, successor) or None."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append(None)
        return len(self.eps) - 1

    def add(self, items, start: int) -> int:
        """Append a parsed pattern after ``start``; returns the state behind it."""
        at = start
        for code, arg in items:
            if code in (op.LITERAL, op.NOT_LITERAL, op.IN):
                following = self.state()
                self.on[at] = (_byte_set(code, arg), following)
                at, joint = self.state(), following
                self.eps[joint].append(at)
            elif code is op.SUBPATTERN:
                at = self.add(arg[3], at)
            elif code is op.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    head = self.state()
                    self.eps[at].append(head)
                    self.eps[self.add(branch, head)].append(end)
                at = end
            elif code is op.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at)
                if high is op.MAXREPEAT:
                    head, end = self.state(), self.state()
                    self.eps[at] += [head, end]
                    self.eps[self.add(inner, head)] += [head, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        head = self.state()
                        self.eps[at].append(head)
                        at = self.add(inner, head)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"a rule may not use {code}")
        return at


def _byte_set(code, arg) -> frozenset[int]:
    if code is op.LITERAL:
        found = {arg}
    elif code is op.NOT_LITERAL:
        found = set(range(128)) - {arg}
    else:
        found, negate = set(), False
        for kind, value in arg:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                found.add(value)
            elif kind is op.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"a rule may not use {kind}")
        if negate:
            found = set(range(128)) - found
    if max(found, default=0) > 127:
        raise ValueError("rules consume ASCII characters only")
    return frozenset(found)


def _reverse(items):
    """The parsed pattern of the mirrored language."""
    out = []
    for code, arg in reversed(list(items)):
        if code is op.SUBPATTERN:
            arg = (*arg[:3], _reverse(arg[3]))
        elif code is op.BRANCH:
            arg = (arg[0], [_reverse(b) for b in arg[1]])
        elif code is op.MAX_REPEAT:
            arg = (arg[0], arg[1], _reverse(arg[2]))
        out.append((code, arg))
    return out


class Dfa:
    """``table[s][b]`` is the successor, ``mask[s]`` the bit set of rules accepted in state ``s``.

    States are numbered so that ``s >= quiet`` holds exactly for accepting ones; 0 is the start. In an anchored
    automaton state ``dead`` has no way to acceptance; a floating one may start a match at every byte.
    """

    def __init__(self, patterns: Sequence[str], floating: bool, mirrored: bool = False):
        nfa = _Nfa()
        root, accepts = nfa.state(), {}
        for rule, pattern in enumerate(patterns):
            head = nfa.state()
            nfa.eps[root].append(head)
            items = list(_parser.parse(pattern))
            accepts[nfa.add(_reverse(items) if mirrored else items, head)] = 1 << rule
        self._build(nfa, root, accepts, floating)

    def _build(self, nfa: _Nfa, root: int, accepts: dict[int, int], floating: bool) -> None:
        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for following in nfa.eps[todo.pop()]:
                    if following not in seen:
                        seen.add(following)
                        todo.append(following)
            return frozenset(seen)

        groups: dict[tuple, list[int]] = {}
        used = [x[0] for x in nfa.on if x]
        for byte in range(BYTES):
            groups.setdefault(tuple(byte in s for s in used), []).append(byte)
        classes = list(groups.values())
        start = closure([root])
        number, order, rows = {start: 0}, [start], []
        while len(rows) < len(order):
            row = []
            for members in classes:
                moved = {x[1] for s in order[len(rows)] if (x := nfa.on[s]) and members[0] in x[0]}
                target = closure(moved | ({root} if floating else set()))
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        masks = [sum({accepts[s] for s in states if s in accepts}) for states in order]
        block = self._minimise(rows, masks)
        self._lay_out(rows, masks, block, classes)

    @staticmethod
    def _minimise(rows: list[list[int]], masks: list[int]) -> list[int]:
        """Equivalence class of every state, by refinement until no class splits."""
        block, n = list(masks), -1
        while True:
            seen: dict[tuple, int] = {}
            block = [
                seen.setdefault((block[s], *(block[t] for t in row)), len(seen)) for s, row in enumerate(rows)
            ]
            if len(seen) == n:
                return block
            n = len(seen)

    def _lay_out(self, rows, masks, block, classes) -> None:
        member = {}
        for state, of in enumerate(block):
            member.setdefault(of, state)
        order = sorted(member, key=lambda b: (masks[member[b]] != 0, b != block[0], b))
        place = {b: i for i, b in enumerate(order)}
        self.quiet = sum(masks[member[b]] == 0 for b in order)
        self.mask = [masks[member[b]] for b in order]
        self.table, self.dead = [], -1
        for i, b in enumerate(order):
            line = [0] * BYTES
            for members, target in zip(classes, rows[member[b]], strict=True):
                for byte in members:
                    line[byte] = place[block[target]]
            if not self.mask[i] and set(line) == {i}:
                self.dead = i
            self.table.append(tuple(line))
        if self.quiet == 0 or place[block[0]] != 0:
            raise ValueError("a rule may not match the empty text")


class Scanner:
    """All rules in one pass; exact extents only for the rules that fired."""

    def __init__(self, patterns: Sequence[str]):
        self.combined = Dfa(patterns, floating=True)
        self.forward = [Dfa([p], floating=False) for p in patterns]
        self.backward = [Dfa([p], floating=True, mirrored=True) for p in patterns]

    def fired(self, data: bytes) -> int:
        """Bit set of the rules that match anywhere in ``data``."""
        table, quiet, mask = self.combined.table, self.combined.quiet, self.combined.mask
        state, found, last = 0, 0, -1
        for byte in data:
            state = table[state][byte]
            if state >= quiet and state != last:
                found |= mask[state]
                last = state
        return found

    def extents(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """Leftmost-longest, non-overlapping matches of one rule, as byte offsets.

        A mirrored pass marks every byte where some match begins; from the first mark on, the anchored automaton
        finds the longest end, and the search goes on behind it. Work is linear in ``data``.
        """
        back, ahead = self.backward[rule], self.forward[rule]
        table, quiet, state = back.table, back.quiet, 0
        begins = []
        for i in range(len(data) - 1, -1, -1):
            state = table[state][data[i]]
            if state >= quiet:
                begins.append(i)
        out, free = [], 0
        table, quiet, dead = ahead.table, ahead.quiet, ahead.dead
        for start in reversed(begins):
            if start < free:
                continue
            state, end = 0, start
            for i in range(start, len(data)):
                state = table[state][data[i]]
                if state == dead:
                    break
                if state >= quiet:
                    end = i + 1
            out.append((start, end))
            free = end
        return out

    def matches(self, data: bytes) -> dict[int, list[tuple[int, int]]]:
        bits = self.fired(data)
        return {r: self.extents(r, data) for r in range(len(self.forward)) if bits >> r & 1}
