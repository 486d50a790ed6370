"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns give sure spans. Other strings of a document that look alike (digit groups, words
with an at sign) are nodes of a field beside them: each has a potential from its shape, neighbours in
the text share a transition potential, and nodes with the same or a similar key (digits, or local
part), however far apart, share a potential that favours equal labels. Loopy message passing gives
the nodes' marginals; base spans are observed. So a number that is written once with its country code
is found where it comes back without. What the field is sure of is added; base spans stay.

Potentials are fitted to the base spans of all documents: only counts by shape, by transition and by
agreement of linked nodes leave the tasks, a table of fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Rounds of messages, and the marginal from which a label is added.
ROUNDS, SURE = 10, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, as it fails at a run's later digits alike.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[ .()-]{0,2}[0-9]){6,}")
_HANDLE = re.compile(r"@[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from an at sign back over the whole local part, forth over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


@dataclass
class _Node:
    start: int
    end: int
    label: int  # 0: none known, else 1 + kind
    shape: int
    key: str


def _shape(s: str) -> tuple[int, str]:
    """A mask of what a string looks like, and its key: the digits, or the lower-cased part before an at sign."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    marks = ("@" in s, "." in s, s.count(".") == 3, s.startswith("+"), "-" in s, " " in s, "(" in s, n < 7, 7 <= n < 10, 10 <= n < 14, 14 <= n < 20, n >= 20)
    return sum(1 << k for k, m in enumerate(marks) if m), s.partition("@")[0].lower() if "@" in s else digits


SHAPES = 1 << 12


def _nodes(text: str, spans: list[tuple[int, int, int]]) -> list[_Node]:
    """Base spans and other candidates, in text order; candidates that touch a base span are part of it."""
    out = [_Node(a, b, 1 + k, *_shape(text[a:b])) for a, k, b in spans]
    more = [m.span() for m in _NUMBER.finditer(text)]
    for m in _HANDLE.finditer(text):
        a = m.start()
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            more.append((a, m.end()))
    starts = np.array([s[0] for s in spans], np.int64)
    reach = np.maximum.accumulate(np.array([s[2] for s in spans], np.int64)) if spans else starts
    for a, b in more:
        k = int(np.searchsorted(starts, b)) - 1  # the spans that begin before b
        if k < 0 or reach[k] <= a:
            out.append(_Node(a, b, 0, *_shape(text[a:b])))
    return sorted(out, key=lambda x: (x.start, x.end))


def _links(nodes: list[_Node]) -> list[tuple[int, int]]:
    """Skip links: nodes of one key in a chain, and chains whose keys end in the same seven or more digits."""
    chains: dict[str, list[int]] = {}
    for k, node in enumerate(nodes):
        if node.key:
            chains.setdefault(node.key, []).append(k)
    out = [(a, b) for chain in chains.values() for a, b in zip(chain, chain[1:], strict=False)]
    ends: dict[str, int] = {}
    for key, chain in sorted(chains.items(), key=lambda x: (-len(x[0]), x[0])):
        if key.isdigit() and len(key) >= 7:
            tail = key[-7:]
            if tail in ends:
                out.append((ends[tail], chain[0]))
            else:
                ends[tail] = chain[0]
    return out


@dataclass(frozen=True)
class Field:
    """Log potentials: shape by label, label by next label, and the gain of equal labels over a skip link."""

    shape: np.ndarray
    step: np.ndarray
    skip: float


def marginals(nodes: list[_Node], field: Field) -> np.ndarray:
    """Label marginals (nodes x labels) by loopy sum-product; base nodes are observed."""
    labels = len(KINDS) + 1
    own = field.shape[[x.shape for x in nodes]].copy()
    for k, x in enumerate(nodes):
        if x.label:
            own[k] = -30.0
            own[k, x.label] = 0.0
    skip = np.eye(labels) * field.skip
    edges = [(k, k + 1, field.step) for k in range(len(nodes) - 1)] + [(a, b, skip) for a, b in _links(nodes)]
    source = np.array([a for a, _, _ in edges] + [b for _, b, _ in edges], np.int64)
    target = np.array([b for _, b, _ in edges] + [a for a, _, _ in edges], np.int64)
    pair = np.stack([p for _, _, p in edges] + [p.T for _, _, p in edges]) if edges else np.zeros((0, labels, labels))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))]).astype(np.int64)
    message = np.zeros((len(source), labels))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, target, message)
        into = belief[source] - message[back]
        new = np.logaddexp.reduce(into[:, :, None] + pair, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        if len(new) and np.abs(new - message).max() < 1e-4:
            message = new
            break
        message = 0.5 * message + 0.5 * new
    belief = own.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _plausible(node: _Node, kind: int) -> bool:
    """What an added span must have: an at sign for e-mail, else the digits of its kind without the base form."""
    if kind == 0:
        return bool(node.shape & 1)
    n = len(node.key)
    return not node.shape & 1 and (kind == 3 and 7 <= n <= 15 or kind == 2 and 14 <= n <= 19 or kind == 1 and bool(node.shape & 4))


def _text_nodes(text: str, base: list[tuple[int, int, int]]) -> list[_Node]:
    """The nodes of a text; most have no at sign or digit, and so none."""
    return _nodes(text, base) if "@" in text or _DIGIT.search(text) else []


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, added) of a text, ordered."""
    base = base_spans(text)
    out = [(a, k, b, False) for a, k, b in base]
    if field is not None:  # a shape that is nearly always of one kind is sure without an observed node
        nodes = _text_nodes(text, base)
        if len(nodes) > len(base):
            for node, p in zip(nodes, marginals(nodes, field), strict=True):
                kind = int(p.argmax()) - 1
                if not node.label and kind >= 0 and p[kind + 1] >= SURE and _plausible(node, kind):
                    out.append((node.start, kind, node.end, True))
    return sorted(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            text = text or ""
            nodes = _text_nodes(text, base_spans(text))
            found.update(("shape", x.shape, x.label) for x in nodes)
            found.update(("step", a.label, b.label) for a, b in zip(nodes, nodes[1:], strict=False))
            found.update(("skip", int(nodes[a].label == nodes[b].label), 0) for a, b in _links(nodes))
    rows = list(found.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["what", "x", "y", "n"])


def fit(texts: DataFrame) -> Field | None:
    """Potentials from all texts (one column `text`); None without base spans."""
    rows = texts.mapInArrow(_counts, "what string, x int, y int, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n")).collect()
    labels = len(KINDS) + 1
    shape, step, same = np.zeros((SHAPES, labels)), np.ones((labels, labels)), [1.0, 1.0]
    for r in rows:  # at most as many as there are shapes and labels
        if r["what"] == "shape":
            shape[r["x"], r["y"]] += r["n"]
        elif r["what"] == "step":
            step[r["x"], r["y"]] += r["n"]
        else:
            same[r["x"]] += r["n"]
    if not shape[:, 1:].any():
        return None
    # a shape's label frequencies, drawn to those of single marks: the base patterns decide on more than shape
    prior = (shape.sum(axis=0) + 1) / (shape.sum() + labels)
    unary = np.log((shape + 2 * prior) / (shape.sum(axis=1, keepdims=True) + 2))
    unary = np.maximum(unary, unary.max(axis=1, keepdims=True) - 4.0)
    flow = step / step.sum(axis=1, keepdims=True) / prior
    return Field(unary, np.clip(np.log(flow), -1.0, 1.0), float(np.clip(np.log(same[1] / same[0]) + 4.0, 5.0, 8.0)))


SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def find_private_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id and spans (kind; start and end in code points, end exclusive; added by the field or not).

    Spans are ordered by start, then kind. Without a field one is fitted to df's own texts. Null and
    empty texts have no spans; rows that repeat count each; other columns don't matter.
    """
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    field = fit(docs.select("text")) if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "added": more} for a, k, b, more in all_spans(text or "", field)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _TYPE)], names=["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
