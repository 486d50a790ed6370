"""Secret scans: all rules' expressions in one automaton, one pass over the bytes of a text.

The automaton runs the whole expressions of all rules together and tells, byte by byte, of which rules a
match is under way or ends. A rule's matches lie in the stretches in which it is under way; there its own
automaton, from place to place, gives the leftmost longest ones. A rule's least length is one of the
match, not of the expression, as a match that is too short still covers its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Anchored, Automaton
from .text import buffers, pieces


@dataclass(frozen=True)
class Rule:
    """The expression of a span in two parts, head and tail, and the bytes that the tail must have at least.

    The head is taken as long as it goes.
    """

    kind: str
    tail: str
    least: int = 0
    head: str = ""
    either_case: bool = False


#: The base kinds, in their order.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 12, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]+", 16),
)
#: Kinds added to them: public formats of tokens and key files.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "[A-Za-z0-9]+", 36, "gh[pousr]_"),
    Rule("chat", "[A-Za-z0-9-]+", 10, "xox[abprs]-"),
    Rule("web_token", "[A-Za-z0-9_-]+", 8, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."),
)


class Scanner:
    """The automaton of some rules, and each rule's own."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([(r.head + r.tail, r.either_case) for r in rules])
        self.whole = [Anchored(r.head + r.tail, r.either_case) for r in rules]
        self.heads = [Anchored(r.head, r.either_case) if r.head else None for r in rules]
        self.least = [max(w.shortest(), (h.shortest() if h else 0) + r.least) for r, w, h in zip(rules, self.whole, self.heads, strict=True)]

    def _of_stretch(self, k: int, part: bytes) -> Iterator[tuple[int, int]]:
        """The leftmost longest matches that don't overlap and are long enough."""
        at = 0
        while at + self.least[k] <= len(part):
            end = self.whole[k].end(part, at)
            if end < 0:
                at += 1
                continue
            body = max(at, self.heads[k].end(part, at)) if self.heads[k] else at
            if end - body >= self.rules[k].least:
                yield at, end
            at = end

    def spans(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of each text of a buffer, ordered."""
        rows = len(offs) - 1
        accepts, alive = self.all.scan(data, offs)
        found: list[list] = [[] for _ in range(rows)]
        starts = offs + np.arange(rows + 1)  # with a separator after each text
        for k, a, b in self.all.stretches(accepts, alive, self.least):
            row = int(np.searchsorted(starts, a, "right")) - 1
            part, first = data[a - row : b - row].tobytes(), int(a - starts[row])
            found[row] += [(first + x, k, first + y) for x, y in self._of_stretch(k, part)]
        for row, spans in enumerate(found):
            if spans:
                points = np.concatenate([[0], np.cumsum((data[offs[row] : offs[row + 1]] & 0xC0) != 0x80)])
                found[row] = sorted((int(points[x]), k, int(points[y])) for x, k, y in spans)
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The automata of some rules; made once in a driver."""
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans (kind; start and end in code points, end exclusive; added: no base rule's).

    Of each kind the leftmost matches that don't overlap; those whose least length fails are dropped.
    Spans are ordered by start, then by the order of the rules. Null and empty texts have none; no rules
    give no spans. Rows that repeat count each; other columns don't matter. Up to 16 rules make one automaton;
    more are an error.
    """
    if len(rules) > 16:
        raise ValueError("at most 16 rules in one automaton")
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    made = scanner(tuple(rules)) if rules else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for i, j in pieces(offs):
                found = made.spans(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) if made else [[]] * (j - i)
                spans = [[{"kind": rules[k].kind, "start": a, "end": b, "added": rules[k] not in BASE} for a, k, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(spans, _TYPE)], names=["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
