"""Pattern rules over contents: matches, evidence, limits, findings and status.

A content is read once: an automaton of all strings' anchors tells which strings can occur, and only
those run their expressions over the bytes. Contents don't move between machines; rows are made of hits only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is kept of a scan.
MOST_RULES, MOST_STRINGS, MOST_INSTANCES, MOST_OFFSETS, MOST_BYTES = 32, 16, 4096, 16, 12 << 10
#: Anchors shorter than this are looked for by themselves, as an automaton would stop at each of them.
_SHORT = 3
_WIDE = re.compile(rb"(?:[^\x00]\x00)+")


class Pattern(NamedTuple):
    """A rule's string: an expression over bytes, what each match of it must contain, and how it may be written.

    A rule matches where all its strings occur. `anchor` may be empty; it is compared without case. `wide` finds the string
    with a zero byte behind each byte too.
    """

    rule_id: str
    string_id: str
    expression: str
    code: str
    anchor: str = ""
    nocase: bool = False
    wide: bool = False


class _Scanner:
    """All strings of a pack, compiled once for a task."""

    def __init__(self, patterns: list[Pattern]):
        import ahocorasick

        self.patterns = patterns
        self.compiled = [re.compile(p.expression.encode(), re.IGNORECASE if p.nocase else 0) for p in patterns]
        self.always, self.short, by_anchor = [], [], {}
        for k, p in enumerate(patterns):
            low = p.anchor.lower()
            for wide in (False, True) if p.wide else (False,):
                form = "".join(c + "\0" for c in low) if wide else low
                if not low:
                    self.always.append((k, wide))
                elif len(form) < _SHORT:
                    self.short.append((form.encode("latin-1"), (k, wide)))
                else:
                    by_anchor.setdefault(form, []).append((k, wide))
        self.automaton = ahocorasick.Automaton()
        for form, which in by_anchor.items():
            self.automaton.add_word(form, which)
        self.waits = sum(map(len, by_anchor.values()))
        if by_anchor:
            self.automaton.make_automaton()

    def places(self, content: bytes) -> dict[int, list[int]]:
        """The offsets of each string that occurs, leftmost matches first."""
        low = content.lower()
        can = {*self.always, *(which for form, which in self.short if form in low)}
        if self.waits:
            seen: set[tuple[int, bool]] = set()
            for _, which in self.automaton.iter(low.decode("latin-1")):
                seen.update(which)
                if len(seen) == self.waits:
                    break
            can |= seen
        found: dict[int, list[int]] = {}
        for k, wide in sorted(can):
            if wide:
                at = [s.start() + 2 * m.start() for s in _WIDE.finditer(content) for m in self.compiled[k].finditer(s[0][::2])]
            else:
                at = [m.start() for m in self.compiled[k].finditer(content)]
            if at:
                found[k] = sorted({*found.get(k, []), *at})
        return found


def matches(contents: DataFrame, patterns: list[Pattern], id_column: str = "scan_id", content_column: str = "content", most_offsets: int = MOST_OFFSETS) -> DataFrame:
    """scan_id, rule_id, code, match_count, strings (sorted), offsets (bytes, sorted) of rules whose strings all occur.

    Contents are bytes, or text, which counts as its UTF-8. A string's matches don't overlap. Of the offsets the first
    most_offsets are kept, string by string in the order of the pack. Null contents match nothing.
    """
    kind = contents.schema[id_column].dataType.simpleString()
    rows = contents.select(F.col(id_column).alias("scan_id"), F.col(content_column).cast("binary").alias("content"))
    shared = rows.sparkSession.sparkContext.broadcast(list(patterns))  # a pack has a fixed number of rules
    needed: dict[str, int] = {}
    for p in patterns:
        needed[p.rule_id] = needed.get(p.rule_id, 0) + 1
    arrow = pa.schema([("k", pa.int64()), ("rule_id", pa.string()), ("code", pa.string()), ("match_count", pa.int64()), ("strings", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(shared.value)
        for batch in batches:
            out = []
            for k, content in enumerate(batch.column(1)):
                found = scanner.places(content.as_py() or b"")
                by_rule: dict[str, list[int]] = {}
                for s in found:
                    by_rule.setdefault(shared.value[s].rule_id, []).append(s)
                for rule_id, strings in sorted(by_rule.items()):
                    if len(strings) < needed[rule_id]:
                        continue
                    offsets = [x for s in strings for x in found[s]][:most_offsets]
                    out.append({"k": k, "rule_id": rule_id, "code": shared.value[strings[0]].code, "match_count": sum(len(found[s]) for s in strings), "strings": sorted(shared.value[s].string_id for s in strings), "offsets": sorted(set(offsets))})
            table = pa.RecordBatch.from_pylist(out, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(table.column(0)), *table.columns[1:]], names=["scan_id", *arrow.names[1:]])

    return rows.mapInArrow(scan, f"scan_id {kind}, rule_id string, code string, match_count long, strings array<string>, offsets array<long>")


def limits(found: DataFrame, definitions: DataFrame, pack_version: str, pack_sha256: str, most_rules: int = MOST_RULES, most_strings: int = MOST_STRINGS, most_instances: int = MOST_INSTANCES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Matches with their metadata as JSON of sorted keys, cut to the limits, and each scan's reasons for what was cut.

    Rules come by id; beyond most_rules they go, as does the first whose metadata passes the scan's bytes, with
    all after it. Definitions have rule_id, title, explanation, category, confidence. Rows that go stay
    with kept = false, so that their scan's reasons are told.
    """
    order = Window.partitionBy("scan_id").orderBy("rule_id")
    scan = Window.partitionBy("scan_id")
    own = F.broadcast(definitions.select("rule_id", "title", "explanation", "category", "confidence"))
    rows = found.join(own, "rule_id", "left").withColumn("nth", F.row_number().over(order))
    meta = F.to_json(F.struct(
        F.col("confidence").alias("confidence_class"), F.least("match_count", F.lit(most_instances)).alias("match_count"), "offsets", F.col("category").alias("rule_category"), F.col("explanation").alias("rule_explanation"), "rule_id",
        F.lit(pack_sha256).alias("rule_pack_sha256"), F.lit(pack_version).alias("rule_pack_version"), F.col("title").alias("rule_title"), F.lit("TOP_LEVEL").alias("scope"), F.slice("strings", 1, most_strings).alias("string_ids"),
    ))
    rows = rows.withColumn("metadata", meta).withColumn("bytes", F.sum(F.octet_length("metadata")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = F.col("nth") <= most_rules
    # a rule is looked at unless one before it has passed the bytes
    looked = within & (F.coalesce(F.lag("bytes").over(order), F.lit(0)) <= most_bytes)
    own_reasons = F.array_compact(F.array(
        F.when(F.count(F.lit(1)).over(scan) > most_rules, "matched_rule_limit"), F.when(looked & (F.size("strings") > most_strings), "string_identifier_limit"), F.when(looked & (F.col("match_count") > most_instances), "match_instance_limit"),
        F.when(looked & (F.col("match_count") > F.size("offsets")), "offset_limit"), F.when(looked & (F.col("bytes") > most_bytes), "metadata_limit"),
    ))
    rows = rows.withColumn("own", own_reasons).withColumn("reasons", F.array_sort(F.array_distinct(F.flatten(F.collect_list("own").over(scan)))))
    kept = within & (F.col("bytes") <= most_bytes)
    return rows.select("scan_id", "rule_id", "code", F.least("match_count", F.lit(most_instances)).alias("match_count"), F.slice("strings", 1, most_strings).alias("strings"), "offsets", "metadata", kept.alias("kept"), "reasons")


def findings(limited: DataFrame, dim: DataFrame) -> DataFrame:
    """One finding for each kept match, with the code's attributes, and a partial one for scans with reasons."""
    own = limited.where("kept").select("scan_id", "code", "rule_id")
    partial = limited.where(F.size("reasons") > 0).select("scan_id", F.lit("YARA_PARTIAL_ANALYSIS").alias("code"), F.lit("").alias("rule_id")).distinct()
    return own.unionByName(partial).join(F.broadcast(dim.select("code", "severity", "techniques")), "code", "left")


def status(scans: DataFrame, limited: DataFrame) -> DataFrame:
    """scan_id, status, matched_rules, retained_findings, reasons of every scan, those without a match included."""
    by = limited.groupBy("scan_id").agg(F.count(F.lit(1)).alias("matched_rules"), F.count_if("kept").alias("_kept"), F.first("reasons").alias("reasons"))
    rows = scans.select("scan_id").join(by, "scan_id", "left")
    partial = F.coalesce(F.size("reasons") > 0, F.lit(False))
    return rows.select(
        "scan_id", F.when(partial, "PARTIAL").otherwise("COMPLETE").alias("status"), F.coalesce("matched_rules", F.lit(0)).alias("matched_rules"),
        (F.coalesce("_kept", F.lit(0)) + partial.cast("int")).alias("retained_findings"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def pack_digest(pack: DataFrame) -> DataFrame:
    """One digest of a pack (rule_id, string_id, expression, code): of each rule's strings first, then of the rules in order."""
    line = F.concat_ws("\t", "rule_id", "string_id", "expression", "code")
    by_rule = pack.groupBy("rule_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
    return by_rule.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "digest"))), lambda r: r["digest"]), "\n"), 256).alias("digest"))


def pack_faults(pack: DataFrame, manifest: DataFrame, expected: str) -> DataFrame:
    """What is wrong with a pack: fault and rule_id (null for the pack as a whole).

    repeated: a string declared twice, or a rule with two codes; undeclared: a rule that the manifest (rule_id) doesn't name; missing: one
    that only the manifest names; digest: the pack isn't the expected one.
    """
    repeated = pack.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("string_id").alias("strings"), F.count_distinct("code").alias("codes")).where("n > strings OR codes > 1")
    declared = pack.select("rule_id").distinct().withColumn("declared", F.lit(True)).join(manifest.select("rule_id").distinct().withColumn("named", F.lit(True)), "rule_id", "full_outer")
    sets = declared.select(F.when(F.col("named").isNull(), "undeclared").when(F.col("declared").isNull(), "missing").alias("fault"), "rule_id").where("fault IS NOT NULL")
    digest = pack_digest(pack).where(F.coalesce("digest", F.lit("")) != expected).select(F.lit("digest").alias("fault"), F.lit(None).cast("string").alias("rule_id"))
    return repeated.select(F.lit("repeated").alias("fault"), "rule_id").unionAll(sets).unionAll(digest)
