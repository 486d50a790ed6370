"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon gives each word a class: insult (with a weight), threat, target, negation, report, or nothing.
Five transducers read the classes of a clause side by side: insults, also several in a row; threats, which
a target soon after completes; targets in reach; negations in reach; reported speech. Their composition is
one table: for a state and a class it has the next state and the pattern that is matched there, such as an
insult aimed at a target or a negated threat. Every pattern has a weight; a clause weighs what its matches
weigh, a document's evidence are its four heaviest clauses, and its score the logistic of that.

The insult lexicon (words and word beginnings) and the patterns' weights are fitted to labelled rows.
The classes of target, negation, threat and report words are fixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import Words, buffers, byte_hashes, pieces

#: Labelled texts of either class that a model is fitted to, those of the lowest hashes; the bound of the sample.
SAMPLE = 10_000
#: Beginnings of words that may become entries, and the evidence asked of an entry: its lower bound of the
#: log odds must reach a value, and a share of the strongest entry's.
BEGINNINGS, LEAST_ODDS, LEAST_SHARE = (4, 5), 1.0, 0.2

# Word lists of the grammar.
THREATS = "kill hurt destroy burn beat stab shoot töte umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they him her them du dich ihr sie euch tu te toi vous ils elle tú usted ustedes ellos".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says wrote called quote quoted according sagte schrieb dit écrit dijo escribió".split()
SEED = "idiot stupid moron scum trash loser pathetic worthless disgusting clown".split()

PLAIN, TARGET, NEGATION, REPORT, THREAT, INSULT = 0, 1, 2, 3, 4, 5
#: What is matched, and the weights before any fit: an insult is scaled by its own weight, a threat is not.
KINDS = ("insult", "further insult", "violence", "threat")
PRIOR = (1.0, 1.0, 1.5, 3.0)
#: Factors of the weights before any fit: aimed at a target, negated, reported.
AIMED, NEGATED, REPORTED = 1.2, 0.6, 0.6
#: Text bytes that are read at a time.
PIECE_BYTES = 256 << 10
#: How strongly fitted weights are drawn to those before.
PULL = 2.0
#: All clauses of a document count, the heaviest whole, each lighter one by this part of the one before, so that long texts saturate.
FADING = 0.75


@dataclass(frozen=True)
class Transducer:
    """moves[state][class] is the next state, out[state][class] a mark of what is matched there (0: nothing)."""

    moves: np.ndarray
    out: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """Both side by side: pairs of states, and the marks of both."""
        n = len(other.moves)
        moves = self.moves[:, None, :] * n + other.moves[None, :, :]
        out = self.out[:, None, :] | other.out[None, :, :]
        return Transducer(moves.reshape(-1, INSULT + 1), out.reshape(-1, INSULT + 1))


#: Marks: a bit for each kind, and for each context.
KIND = {kind: 1 << k for k, kind in enumerate(KINDS)}
IN_AIM, IN_NEGATION, IN_REPORT = 16, 32, 64


def _table(states: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((states, INSULT + 1), np.int64), np.zeros((states, INSULT + 1), np.int64)


def insults() -> Transducer:
    """An insult; one directly after another is a further one."""
    moves, out = _table(2)
    moves[:, INSULT] = 1
    out[0, INSULT], out[1, INSULT] = KIND["insult"], KIND["further insult"]
    return Transducer(moves, out)


def threats(words: int = 3) -> Transducer:
    """A word of violence, and a threat where a target follows within so many words."""
    moves, out = _table(words + 1)
    for state in range(words + 1):  # state s: s words are left for a target
        moves[state] = max(0, state - 1)
        moves[state, THREAT] = words
        out[state, THREAT] = KIND["violence"]
        if state:
            moves[state, TARGET], out[state, TARGET] = 0, KIND["threat"]
    return Transducer(moves, out)


def within(trigger: int, words: int, mark: int) -> Transducer:
    """Marks all within so many words after a trigger class; a new trigger begins anew."""
    moves, out = _table(words + 1)
    for state in range(words + 1):
        moves[state] = max(0, state - 1)
        moves[state, trigger] = words
        out[state] = mark if state else 0
    return Transducer(moves, out)


def throughout(trigger: int, mark: int) -> Transducer:
    """Marks all after a trigger class, to the end of the clause."""
    moves, out = _table(2)
    moves[0, trigger], moves[1], out[1] = 1, 1, mark
    return Transducer(moves, out)


GRAMMAR = insults().compose(threats()).compose(within(TARGET, 3, IN_AIM)).compose(within(NEGATION, 3, IN_NEGATION)).compose(throughout(REPORT, IN_REPORT))
#: Patterns: a kind in one of eight contexts.
PATTERNS = len(KINDS) * 8


def _pattern_table() -> np.ndarray:
    """The pattern matched at each state and class of the grammar, -1 for none."""
    kind = np.full(GRAMMAR.out.shape, -1)
    for k in range(len(KINDS)):
        kind[(GRAMMAR.out >> k) & 1 == 1] = k
    return np.where(kind < 0, -1, kind * 8 + (GRAMMAR.out >> len(KINDS)))


MATCHED = _pattern_table()


def prior_weights() -> np.ndarray:
    context = np.array([(AIMED if c & 1 else 1) * (NEGATED if c & 2 else 1) * (REPORTED if c & 4 else 1) for c in range(8)])
    return np.concatenate([w * context for w in PRIOR])


@dataclass(frozen=True)
class Model:
    """Insult weights by word, or by beginning of a word (marked by `*`), the patterns' weights, and the offset."""

    weights: dict[str, float]
    patterns: np.ndarray = field(default_factory=lambda: 1.5 * prior_weights())
    offset: float = -4.0


# Bytes of words: letters, all bytes of other characters, and the apostrophe.
_LETTERS = np.zeros(256, bool)
_LETTERS[[0x27, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:\n")] = True


def tokens(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The lower-cased words of some texts in pieces: first row, end row, words.

    An apostrophe counts as a letter between letters; typographic signs of other alphabets part words.
    """
    data, offs = buffers(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    for i, j in pieces(offs, PIECE_BYTES):
        part, at = data[offs[i] : offs[j]].copy(), offs[i : j + 1] - offs[i]
        after = np.append(part[1:], np.zeros(1, np.uint8))
        for sign in np.flatnonzero(((part == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((part == 0xE3) & (after == 0x80))):
            part[sign : sign + 3] = 0x20
        latin = np.flatnonzero((part == 0xC2) & (after >= 0xA0) & ~np.isin(after, (0xAA, 0xB5, 0xBA)))
        part[latin] = part[latin + 1] = 0x20
        letter = _LETTERS[part] & (part != 0x27)
        mark = np.flatnonzero(part == 0x27)
        inner = mark[(mark > 0) & (mark < len(part) - 1)]
        part[np.setdiff1d(mark, inner[letter[inner - 1] & letter[inner + 1]])] = 0x20
        yield i, j, Words(part, at, _LETTERS)


def _beginning(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have more than k characters, and the end of their first k."""
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    number = np.searchsorted(starts, words.start)
    longer = np.flatnonzero(np.append(starts, np.full(k + 1, len(words.data)))[number + k] < words.end)
    return longer, starts[number[longer] + k]


class _Lexicon:
    """Classes and insult weights of words, by hash."""

    def __init__(self, model: Model):
        fixed = [(w, c, 0.0) for c, some in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in some]
        self.whole = self._index(fixed + [(w, INSULT, x) for w, x in model.weights.items() if not w.endswith("*")])
        self.begin = {k: self._index([(w[:-1], INSULT, x) for w, x in model.weights.items() if w.endswith("*") and len(w) == k + 1]) for k in BEGINNINGS}

    @staticmethod
    def _index(entries: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [w.encode() for w, _, _ in entries]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        h = byte_hashes(data, ends - np.array([len(r) for r in raw], np.int64), ends) if raw else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], np.array([c for _, c, _ in entries], np.int64)[order], np.array([x for _, _, x in entries], float)[order]

    @staticmethod
    def _find(index: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = index[0]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(keys, h, "right") - 1  # an insult entry after a fixed one of the same word wins
        hit = np.flatnonzero(keys[np.maximum(at, 0)] == h)
        return hit, at[hit]

    def classes(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        kind, weight = np.zeros(len(words.start), np.int64), np.zeros(len(words.start))
        hit, at = self._find(self.whole, byte_hashes(words.data, words.start, words.end))
        kind[hit], weight[hit] = self.whole[1][at], self.whole[2][at]
        for k, index in self.begin.items():
            if len(index[0]):
                longer, end = _beginning(words, k)
                hit, at = self._find(index, byte_hashes(words.data, words.start[longer], end))
                kind[longer[hit]] = INSULT
                weight[longer[hit]] = np.maximum(weight[longer[hit]], index[2][at])
        return kind, weight


def _matches(words: Words, kind: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The grammar's matches: clause, pattern, value; and the row of each clause. Clauses run side by side."""
    none = np.zeros(0, np.int64)
    if not (kind >= THREAT).any():
        return none, none, none, none
    ends = np.cumsum(_ENDS[words.data])[words.start]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = (ends[1:] != ends[:-1]) | (words.row[1:] != words.row[:-1])
    clause = np.cumsum(fresh) - 1
    first = np.append(np.flatnonzero(fresh), len(kind))
    lanes = np.unique(clause[kind >= THREAT])
    lengths = first[lanes + 1] - first[lanes]
    by = np.argsort(-lengths, kind="stable")
    lanes, lengths = lanes[by], lengths[by]
    state = np.zeros(len(lanes), np.int64)
    found = []
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))  # lanes with more than t words
        at = first[lanes[:n]] + t
        c = kind[at]
        matched = MATCHED[state[:n], c]
        hit = np.flatnonzero(matched >= 0)
        if len(hit):
            found.append((lanes[hit], matched[hit], np.where(c[hit] == INSULT, weight[at[hit]], 1.0)))
        state[:n] = GRAMMAR.moves[state[:n], c]
    if not found:
        return none, none, none, none
    lane, pattern, value = (np.concatenate(x) for x in zip(*found, strict=True))
    number = np.searchsorted(np.sort(lanes), lane)
    return number, pattern, value, words.row[first[np.sort(lanes)]]


def features(words: Words, lexicon: _Lexicon, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with matches: the row, and how much of each pattern its clauses hold, faded by their order of weight."""
    clause, pattern, value, row = _matches(words, *lexicon.classes(words))
    if not len(clause):
        return np.zeros(0, np.int64), np.zeros((0, PATTERNS))
    total = np.bincount(clause, value * patterns[pattern], minlength=len(row))
    order = np.lexsort((np.arange(len(row)), -total, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = row[order][1:] != row[order][:-1]
    start = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    part = np.empty(len(row))
    part[order] = FADING**place
    rows, number = np.unique(row, return_inverse=True)
    out = np.zeros((len(rows), PATTERNS))
    np.add.at(out, (number[clause], pattern), value * part[clause])
    return rows, out


def _units(text: str) -> list[str]:
    """The words of a text, in order."""
    return [words.data[a:b].tobytes().decode() for _, _, words in tokens(pa.array([text])) for a, b in zip(words.start, words.end, strict=True)]


def _entries(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({u for w in set(_units(text)) for u in _entries(w)})
        units = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([counts[0][u] for u in units], pa.int64()), pa.array([counts[1][u] for u in units], pa.int64())], names=["unit", "clean", "toxic"])


def _contexts(units: set[str]):
    """The neighbours of every occurrence of the given units: copies of a passage repeat them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _units(text)
                for k, w in enumerate(words):
                    for unit in units.intersection(_entries(w)):
                        found.add((unit, toxic, " ".join((*words[max(0, k - 1) : k], "", *words[k + 1 : k + 2]))))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["unit", "toxic", "context"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (0 or more) and offset by damped Newton steps, drawn to those before any fit."""
    prior = np.append(1.5 * prior_weights(), -4.0)
    design = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + PULL / 2 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + PULL * (w - prior)
        hess = design.T @ (design * (p * (1 - p))[:, None]) + PULL * np.eye(len(w))
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while size > 1e-6 and not loss(w - size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    return np.maximum(w[:-1], 0.0), float(w[-1])


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of rows with 0/1 labels; other labels and nulls are left out.

    It is fitted to at most `sample` different texts of each class, those with the lowest hashes; copies of
    a text count once. Without toxic or without clean rows it is the built-in one.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = labelled.select(text.alias("text"), F.col(f"`{label_column}`").cast("int").alias("toxic"), F.xxhash64(text).alias("h")).where("toxic IN (0, 1)")
    keys = shared.saved(rows.select("toxic", "h").distinct())
    last = {c: keys.where(F.col("toxic") == c).orderBy("h").limit(sample).agg(F.max("h"), F.count(F.lit(1))).first() for c in (0, 1)}
    n = {c: r[1] for c, r in last.items()}
    if not all(n.values()):
        return Model({w: 4.0 for w in SEED})
    chosen = rows.where(F.col("h") <= F.when(F.col("toxic") == 1, F.lit(last[1][0])).otherwise(F.lit(last[0][0])))
    rows = shared.saved(chosen.groupBy("h", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    counts = rows.mapInArrow(_count_units, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = _strongest(counts, n)
    # a unit counts once for each different context, so a passage that is in many texts doesn't make one of its words
    seen = rows.mapInArrow(_contexts({r["unit"] for r in strong}), "unit string, toxic int, context string")
    contexts = seen.groupBy("unit").agg(F.count_distinct(F.when(F.col("toxic") == 0, F.col("context"))).alias("clean"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("toxic"))
    own = rows.sparkSession.createDataFrame([(r["unit"], r["clean"], r["toxic"]) for r in strong], "unit string, docs_clean long, docs_toxic long")
    found = _strongest(own.join(contexts, "unit").select("unit", F.col("docs_clean").alias("clean"), F.least("docs_toxic", "toxic").alias("toxic")), n)
    weights = {r["unit"]: r["weight"] for r in found if r["weight"] >= LEAST_SHARE * found[0]["weight"]} or {w: 4.0 for w in SEED}
    model = Model(weights)
    for _ in range(2):  # which clauses are the heaviest depends on the weights
        pairs = rows.mapInArrow(_features_of(model), "toxic int, features array<double>").collect()  # a few numbers for each text of the bounded sample
        x = np.array([r["features"] for r in pairs])
        model = Model(weights, *_logistic(x, np.array([r["toxic"] for r in pairs], float)))
    return model


def _strongest(counts: DataFrame, n: dict[int, int]) -> list:
    """Units (unit, clean, toxic) with enough evidence, strongest first; the sample bounds their number."""
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    least = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    return counts.select("unit", "clean", "toxic", least.alias("weight")).where(F.col("weight") >= LEAST_ODDS).orderBy(F.desc("weight"), "unit").collect()


def _features_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(model)
        for batch in batches:
            for i, j, words in tokens(batch.column(0)):
                x = np.zeros((j - i, PATTERNS))
                rows, found = features(words, lexicon, model.patterns)
                x[rows] = found
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "features"])

    return run


def evidence(column: pa.Array, model: Model, lexicon: _Lexicon) -> np.ndarray:
    """What the heaviest clauses of each text weigh; 0 without matches."""
    out = np.zeros(len(column))
    for i, _, words in tokens(column):
        rows, found = features(words, lexicon, model.patterns)
        out[i + rows] = found @ model.patterns
    return out


def _evidence_of(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in `keep` and the evidence of the column text."""
    read = keep if "text" in keep else [*keep, "text"]
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(evidence(batch.column(at), model, lexicon))], names=[*keep, "evidence"])

    rows = df.select(*[F.col(f"`{c}`") for c in read])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, `evidence` double" if schema else "`evidence` double")


def score(df: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns in `keep` (all of df if None), score (0 to 1) and predicted (1 from the threshold on).

    The score is a function of the text alone; null, empty and wordless texts score the least. Columns
    of df that are named evidence, score or predicted are replaced; rows that repeat count each, an empty
    df stays empty.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("evidence", "score", "predicted")]
    rows = df if text_column == "text" else df.withColumn("text", F.col(f"`{text_column}`"))
    out = _evidence_of(rows, model, keep)
    value = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.offset))))
    return out.withColumn("score", value).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("evidence")


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not be fitted to: crc32 of the id as text is 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents (doc_id, text; doc_id, toxic) that are not held out.

    A document with labels of both kinds counts as toxic.
    """
    own = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(shared.small(own), "doc_id"), sample=sample)
