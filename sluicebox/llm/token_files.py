"""Token ids of documents in Re-Pair compressed files, and their readers.

The file format is a folder of Parquet files. A row is a shard: the ids of consecutive documents, each
with its end id, as Re-Pair grammars (`grammar`) of at most `shard_ids` ids. `part` and `shard` number the
shards in document order; `doc_ids` and `counts` give its documents, `grammars` their first nonterminal,
symbols, rules, expansion lengths and rounds as little-endian integers. Lengths of expansions let a reader
find any id without expanding what comes before it (`read_ranges`).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import shared
from .grammar import Expander, Grammar, _spread, compress
from .text import LOWER, buffers, pieces

#: Ids of a grammar; a shard has as many or one document more.
SHARD_IDS = 1 << 20
#: Different pieces whose ids a worker keeps.
KEPT_PIECES = 1_000_000
#: Text that is encoded at a time.
_TEXT_BYTES = 8 << 20

_ARROW = pa.struct([("first", pa.int64()), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("rounds", pa.binary())])
_GRAMMAR = StructType([StructField("first", LongType()), *[StructField(x, BinaryType()) for x in ("symbols", "rules", "lengths", "rounds")]])
SCHEMA = StructType([
    StructField("part", IntegerType()), StructField("shard", IntegerType()), StructField("n_tokens", LongType()), StructField("doc_ids", ArrayType(LongType())),
    StructField("counts", ArrayType(LongType())), StructField("grammars", ArrayType(_GRAMMAR)),
])

# Classes of bytes: blanks, letters and bytes of other characters, digits, other ASCII.
_BLANKS = bytes([0x20, 9, 10, 11, 12, 13])
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(_BLANKS)] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
# Bytes whose words are encoded whole: ', <, controls, and lead bytes but those of U+00C0 to U+027F,
# of which 0xC3, 0xC4 and 0xC9 have exceptions.
_ODD, _UNSURE, _WHOLE = 16, 32, 4
_CLASS[[0x27, 0x3C, 0x7F, 0xC2, *range(9), *range(14, 32), *range(0xCA, 0x100)]] |= _ODD
_CLASS[[0xC3, 0xC4, 0xC9]] |= _UNSURE
_CLASS, _LOWER = _CLASS.tobytes(), LOWER.tobytes()


_CUT = re.compile("[^!-~]|['<A-Za-z0-9]")
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level BPE writes a byte that is no printable Latin-1 character as one from U+0100 on, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGNS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Ids of whole texts; those of words, or their pieces, are looked up where they have been encoded before.

    Tokenizers that drop white space and cut at letters, digits and other characters, as the word-end BPE
    does, give each word the same ids wherever it stands, and each run of letters or signs as well if the
    word is of ASCII and Latin letters without apostrophes. Other tokenizers encode text by text.
    """

    def __init__(self, definition: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_pieces = _cuts_at_blanks(json.loads(definition))
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        """Known pieces, and their ids one after the other; piece 0 is the end of a text."""
        self.known = pa.array([], pa.string())
        self.flat, self.starts = array("i", [self.end_id]), array("i", [0, 1])

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """The numbers of pieces, of which new ones are encoded."""
        if len(self.known) > KEPT_PIECES:
            self._clear()
        found = pc.index_in(names, self.known)
        numbers = np.empty(len(names), np.int32)
        if found.null_count < len(names):
            numbers[:] = found.fill_null(0).to_numpy()
        if found.null_count:
            missing = found.is_null()
            coded = names.filter(missing).dictionary_encode()
            new = coded.dictionary
            numbers[missing.to_numpy(zero_copy_only=False)] = coded.indices.to_numpy() + np.int32(len(self.known))
            model, whole, plain = self.tokenizer.model, [], {}
            texts = new.to_pylist()
            for x in texts:
                # of what is cut no further, the normaliser changes capitals only, and signs for bytes go to the model
                if x.isascii() and (x.isalpha() and x.islower() or not _CUT.search(x)):
                    plain[x] = [t.id for t in model.tokenize(x)]
                elif _LATIN.fullmatch(x):
                    plain[x] = [t.id for t in model.tokenize(x.lower().encode().decode("latin-1").translate(_SIGNS))]
                else:
                    whole.append(x)
            plain.update((x, e.ids) for x, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)))
            for x in texts:
                self.flat.extend(plain[x])
                self.starts.append(len(self.flat))
            self.known = pa.concat_arrays([self.known, new])
        return numbers + np.int32(1)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each text) of some texts after the other; each text ends with the end id."""
        data, offs = buffers(column)
        for i, j in pieces(offs, _TEXT_BYTES):
            part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if self.by_pieces:
                yield self._by_pieces(part, own)
            else:
                texts = [part[a:b].tobytes().decode() for a, b in zip(own[:-1], own[1:])]
                ids = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield np.array([x for e in ids for x in e], np.uint32), np.array([len(e) for e in ids], np.int64)

    def _by_pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, n = data.tobytes(), len(data)
        coded = np.frombuffer(raw.translate(_CLASS), np.uint8)
        kind, low = coded & 3, raw.translate(_LOWER)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        odd = np.flatnonzero(coded >= _ODD)
        if len(odd):
            lead, after = data[odd], data[np.minimum(odd + 1, n - 1)]
            # signs, and letters with two-letter small forms, among the Latin letters
            sign = ((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((lead == 0xC4) & (after == 0xB0)) | ((lead == 0xC9) & (after > 0x8F))
            odd = odd[sign | (coded[odd] & _ODD > 0)]
        if len(odd):
            blank = kind == 0
            heads = np.flatnonzero(~blank & (first[:-1] | np.concatenate([[True], blank[:-1]])))
            tails = np.flatnonzero(~blank & (first[1:] | np.concatenate([blank[1:], [True]]))) + 1
            own = np.unique(np.searchsorted(heads, odd, "right") - 1)
            own = _spread(heads[own], tails[own] - heads[own])
            kind[own] = _WHOLE
            lowered = np.frombuffer(low, np.uint8).copy()
            lowered[own] = data[own]
            low = lowered.tobytes()
        cut = first
        cut[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        bounds = np.flatnonzero(cut).astype(np.int32)
        start, end = bounds[:-1], bounds[1:]
        solid = kind[start] > 0 if n else np.zeros(0, bool)
        start, end = start[solid], end[solid]
        ends = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=ends[1:])
        names = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low.translate(None, _BLANKS))])
        # a text's end is the piece 0 after its last one
        stops = np.searchsorted(start, offs[1:])
        numbers = np.insert(self._numbers(names), stops, np.int32(0))
        ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(self.starts), [None, pa.py_buffer(self.starts)]), pa.Array.from_buffers(pa.int32(), len(self.flat), [None, pa.py_buffer(self.flat)]))
        out = ids.take(pa.array(numbers))
        del ids  # which holds the lists at their length
        counts = np.diff(out.offsets.to_numpy()[stops + np.arange(1, len(stops) + 1)], prepend=0)
        return out.values.to_numpy().view(np.uint32), counts.astype(np.int64)


def _cuts_at_blanks(definition: dict) -> bool:
    """Whether a tokenizer's definition is that of BPE with word ends over lower-cased runs of one class."""
    steps = (definition.get("normalizer") or {}).get("normalizers", [])
    cuts = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": pattern}, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and definition["model"]["type"] == "BPE"
        and not definition.get("truncation") and not definition.get("padding") and not definition.get("post_processor")
        and all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) for t in definition["added_tokens"])
    )


#: Encoders of this worker by their definition; tasks that follow find them warm.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(definition: str, end_id: int) -> Encoder:
    if (definition, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition, end_id] = Encoder(definition, end_id)
    return _ENCODERS[definition, end_id]


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


class _Shards:
    """Takes documents' ids and gives shards."""

    def __init__(self, part: int, first: int, limit: int, least: int):
        self.part, self.first, self.limit, self.least, self.made = part, first, limit, least, 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.doc_ids, self.counts, self.held = [], [], [], 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends, low, given = np.cumsum(counts), 0, 0
        while low < len(counts):
            # up to the document that fills the shard
            high = min(len(counts), int(np.searchsorted(ends, given + self.limit - self.held, "left")) + 1)
            self.ids.append(ids[given : ends[high - 1]])
            self.held += int(ends[high - 1]) - given
            self.doc_ids += doc_ids[low:high]
            self.counts += counts[low:high].tolist()
            low, given = high, int(ends[high - 1])
            if self.held >= self.limit:
                yield self.close()

    def close(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        grammars = []
        for at in range(0, len(ids), self.limit):
            g = compress(ids[at : at + self.limit], self.first, self.least)
            grammars.append({"first": g.first, "symbols": _bytes(g.symbols, "<u4"), "rules": _bytes(g.rules, "<u4"), "lengths": _bytes(g.lengths, "<i8"), "rounds": _bytes(g.rounds, "<i8")})
        columns = [pa.array([self.part], pa.int32()), pa.array([self.made], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.counts], pa.list_(pa.int64())), pa.array([grammars], pa.list_(_ARROW))]
        self.made += 1
        self._clear()
        return pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)


def write_tokens(df: DataFrame, path: str, definition: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS, least: int = 8) -> None:
    """Write the ids of every row's whole text, in ascending order of ids, to a new folder that executors can reach.

    definition is a tokenizer's JSON text; end_id follows each text. Rows without an id come last, rows
    that repeat an id in any order; a null or empty text has its end id alone. A text of more than
    shard_ids ids is several grammars of one shard. Other columns don't matter; an empty df gives no shards.
    """
    first = max(end_id, *(t["id"] for t in json.loads(definition)["added_tokens"]), _largest(definition)) + 1
    shared_definition = df.sparkSession.sparkContext.broadcast(definition)

    def encode(batches):
        encoder, shards = _encoder(shared_definition.value, end_id), _Shards(TaskContext.get().partitionId(), first, shard_ids, least)
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.encode(batch.column(1)):
                yield from shards.add(doc_ids[at : at + len(counts)], ids, counts)
                at += len(counts)
        if shards.counts:
            yield shards.close()

    # equal ids are told apart by their place, so that many of them don't make one range
    order = [F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = docs.repartitionByRange(shared.shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def _largest(definition: str) -> int:
    vocabulary = json.loads(definition)["model"]["vocab"]
    return max(vocabulary.values()) if isinstance(vocabulary, dict) else len(vocabulary) - 1


def _shard_starts(files: DataFrame) -> DataFrame:
    """part, shard and the ids before it: totals of the parts first, of which there are as many as writing tasks."""
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    shards = files.select("part", "shard", F.col("n_tokens").alias("n")).join(parts, "part")
    return shards.select("part", "shard", (F.col("part_start") + before(Window.partitionBy("part").orderBy("shard"))).alias("start"))


def _read_grammar(g: dict) -> Grammar:
    return Grammar(g["first"], np.frombuffer(g["symbols"], "<u4"), np.frombuffer(g["rules"], "<u4").reshape(-1, 2), np.frombuffer(g["lengths"], "<i8"), np.frombuffer(g["rounds"], "<i8"))


def _shards(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the files; ids are little-endian unsigned 32-bit integers.

    start is the number of ids of all documents before it. A document's row is no longer than its ids.
    """
    files = spark.read.schema(SCHEMA).parquet(path)

    def expand(batches):
        for row in _shards(batches):
            ids = [e.expand(e.grammar.symbols) for e in map(Expander, map(_read_grammar, row["grammars"]))]
            raw = memoryview((np.concatenate(ids) if len(ids) > 1 else ids[0]).astype("<u4")).cast("B")
            ends = np.cumsum(row["counts"])
            # some documents at a time, as their ids are longer than the grammar
            low = 0
            while low < len(ends):
                base = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, base + SHARD_IDS, "right")))
                high = min(high, len(ends))
                offsets = (np.concatenate([[base], ends[low:high]]) - base) * 4
                body = raw[base * 4 : int(ends[high - 1]) * 4]
                values = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
                start = np.concatenate([[base], ends[low : high - 1]]) + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][low:high], pa.int64()), pa.array(start, pa.int64()), pa.array(row["counts"][low:high], pa.int64()), values.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                low = high

    starts = shared.small(_shard_starts(files), files.select("part").count())
    return files.join(starts, ["part", "shard"]).mapInArrow(expand, "doc_id long, start long, n_tokens long, ids binary")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The ids of ranges (range_id, start, n_tokens) of the whole sequence: range_id, start, ids.

    A range over several shards has a row for each, whose start is that of its first id; what lies
    beyond the sequence, and ranges with nulls or without ids, give none. Of each shard only the symbols
    that cover its ranges are expanded.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    starts = _shard_starts(files).join(files.select("part", "shard", F.col("n_tokens").alias("size")), ["part", "shard"])
    cell = lambda x: F.floor(x / SHARD_IDS)
    cells = lambda at, n: F.explode(F.sequence(cell(at), cell(at + n - 1)))
    asked = ranges.where("n_tokens > 0 AND start >= 0").select("range_id", F.col("start").alias("low"), F.col("n_tokens").alias("asked"))
    asked = asked.withColumn("cell", cells(F.col("low"), F.col("asked")))
    met = starts.withColumn("cell", cells(F.col("start"), F.col("size"))).join(asked, "cell").where("low < start + size AND start < low + asked")
    met = met.select("part", "shard", "range_id", "start", F.greatest("low", "start").alias("low"), F.least(F.expr("low + asked"), F.expr("start + size")).alias("high")).distinct()

    def cut(batches):
        last, parts, bounds = None, [], None
        for row in _shards(batches):
            if last != (row["part"], row["shard"]):
                parts = [Expander(_read_grammar(g)) for g in row["grammars"]]
                bounds = np.concatenate([[0], np.cumsum([int(e.lengths(e.grammar.symbols).sum()) for e in parts])])
                last = (row["part"], row["shard"])
            low, high = row["low"] - row["start"], row["high"] - row["start"]
            ids = [e.slice(max(low - b, 0), min(high, c) - b) for e, b, c in zip(parts, bounds[:-1].tolist(), bounds[1:].tolist()) if low < c and b < high]
            yield pa.RecordBatch.from_arrays([pa.array([row["range_id"]], pa.int64()), pa.array([row["low"]], pa.int64()), pa.array([np.concatenate(ids).astype("<u4").tobytes()], pa.binary())], names=["range_id", "start", "ids"])

    return files.select("part", "shard", "grammars").join(met, ["part", "shard"]).sortWithinPartitions("part", "shard").mapInArrow(cut, "range_id long, start long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own among the shared ones."""
    return f"{shared.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
