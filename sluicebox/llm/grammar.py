"""Re-Pair grammars of id sequences, built and read in numpy.

Symbols below `first` are ids; symbol first + k stands for the two symbols of rule k, which are older
than it. Rules are made in rounds: in a round the pairs that occur at least a 64th as often as the most
frequent one are replaced side by side, more frequent pairs first where they overlap, until the pairs
that occur `least` times save next to nothing. One pair at a time, as in a loop over a priority queue,
would give about the same rules in as many passes as there are rules.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Slots that pairs are counted in, as a power of two.
_SLOT_BITS = 18
#: A round replaces pairs that occur at least this part as often as the most frequent one.
_SHARE = 64
#: Rounds end with one that saves less than this part of the symbols.
_LEAST_SAVED = 1 / 200
_NONE = np.int32(2**31 - 1)


class Grammar(NamedTuple):
    """symbols: the compressed sequence; rules: (rules, 2) symbols; lengths: ids that a rule expands to; rounds: rules after each round."""

    first: int
    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    rounds: np.ndarray


def compress(ids: np.ndarray, first: int, least: int = 8) -> Grammar:
    """The grammar of an id sequence; ids are below `first`. A pair that is replaced goes from `least` places or more."""
    s = np.ascontiguousarray(ids, np.uint32)
    rules, rounds, made = [], [], 0
    while len(s) > 1:
        slot = s[:-1] * np.uint32(0x9E3779B1) + s[1:] * np.uint32(0x85EBCA77)
        slot ^= slot >> np.uint32(15)
        slot = (slot * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)
        counts = np.bincount(slot, minlength=1 << _SLOT_BITS)
        most = max(least, int(counts.max()) // _SHARE)
        at = np.flatnonzero((counts >= most)[slot])
        own = slot[at]
        # one pair owns a slot in a round; others that fall into it wait
        owner = np.zeros(1 << _SLOT_BITS, np.int64)
        owner[own[::-1]] = at[::-1]
        chief = owner[own]
        same = (s[at] == s[chief]) & (s[at + 1] == s[chief + 1])
        at, chief, own = at[same], chief[same], own[same]
        counts = np.bincount(own, minlength=1 << _SLOT_BITS)
        slots = np.flatnonzero(counts >= most)
        slots = slots[np.argsort(-counts[slots], kind="stable")]
        rank = np.full(1 << _SLOT_BITS, _NONE, np.int32)
        rank[slots] = np.arange(len(slots), dtype=np.int32)
        order = np.full(len(s) + 1, _NONE, np.int32)
        order[at + 1] = rank[own]
        taken = _apart(order)
        used = np.bincount(order[taken + 1], minlength=len(slots))
        good = used >= least
        taken = taken[good[order[taken + 1]]]
        if not len(taken):
            break
        name = np.cumsum(good) - 1 + first + made
        heads = owner[slots[good]]
        rules.append(np.stack([s[heads], s[heads + 1]], 1))
        made += int(good.sum())
        rounds.append(made)
        s = s.copy()
        s[taken] = name[order[taken + 1]]
        keep = np.ones(len(s), bool)
        keep[taken + 1] = False
        s = s[keep]
        if most == least and len(taken) < _LEAST_SAVED * len(keep):
            break
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return Grammar(first, s, pairs, _lengths(first, pairs, rounds), np.array(rounds, np.int64))


def _apart(order: np.ndarray) -> np.ndarray:
    """Places whose pair comes before the pairs that it overlaps; every other one in stretches of one pair.

    order[k + 1] is the rank of the pair at place k, and the first and last entries are none.
    """
    own, before, after = order[1:-1], order[:-2], order[2:]
    some = own < _NONE
    if not (some & (own == after)).any():
        return np.flatnonzero(some & (own < before) & (own < after))
    # stretches of equal ranks are judged by their neighbours and taken at even steps
    starts = np.flatnonzero(own != before)
    ends = np.append(starts[1:], len(own))
    wins = (own[starts] < before[starts]) & (own[starts] < order[ends + 1]) & some[starts]
    starts, ends = starts[wins], ends[wins]
    steps = (ends - starts + 1) // 2
    return np.repeat(starts, steps) + 2 * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))


def _lengths(first: int, rules: np.ndarray, rounds) -> np.ndarray:
    out, low = np.zeros(len(rules), np.int64), 0
    for high in rounds:
        for side in rules[low:high].T.astype(np.int64):
            inner = side >= first
            out[low:high] += np.where(inner, out[np.where(inner, side - first, 0)], 1)
        low = high
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, .. of ranges one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Expander:
    """Expansions of a grammar's rules, each written out once.

    Rules of one round stand in different places of the text at least `least` times, so what is
    written out for a round is at most the text's length by `least`.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.start = np.cumsum(grammar.lengths) - grammar.lengths
        self.flat = np.empty(int(grammar.lengths.sum()), np.uint32)
        low = done = 0
        for high in grammar.rounds:
            part = self.expand(grammar.rules[low:high].ravel())
            self.flat[done : done + len(part)] = part
            done += len(part)
            low = high

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        inner = symbols >= self.grammar.first
        out = np.ones(len(symbols), np.int64)
        out[inner] = self.grammar.lengths[symbols[inner] - self.grammar.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths(symbols)
        inner = symbols >= self.grammar.first
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        out[(ends - 1)[~inner]] = symbols[~inner]
        longer = lengths[inner]
        out[_spread((ends - lengths)[inner], longer)] = self.flat[_spread(self.start[symbols[inner] - self.grammar.first], longer)]
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop of the sequence; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.lengths(self.grammar.symbols))
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = start - (ends[low - 1] if low else 0)
        return self.expand(self.grammar.symbols[low:high])[skipped : skipped + stop - start]
