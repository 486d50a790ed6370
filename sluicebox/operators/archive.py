"""Archive jobs over rows of members and containers: names, visits under limits, evidence and findings of a root.

Members: root_id, container_id, ordinal (from 1), name, is_dir, create_system, external_attr, flag_bits,
compress_type, actual_bytes. Containers: root_id, container_id, parent_id and parent_ordinal (the member that
holds it, null for a root's own), bytes, sha, malformed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.dims import DANGEROUS

#: Compression methods that can be read: stored, deflate, bzip2, lzma.
METHODS = (0, 8, 12, 14)


@dataclass(frozen=True)
class Limits:
    """What an analysis of one root reads at most. Fixed values."""

    entries: int = 4096
    depth: int = 3
    members: int = 8192
    compressed_bytes: int = 128 << 20
    member_bytes: int = 32 << 20
    total_bytes: int = 128 << 20
    nested_bytes: int = 32 << 20


def _slashed(v: Column) -> Column:
    return F.replace(v, F.lit("\\"), F.lit("/"))


def name_marks(members: DataFrame) -> DataFrame:
    """Members with what their names show: traversal, rooted path, collision, dangerous, double extension, marks."""
    # the root is a key too, so that members that lie by root stay where they are
    same = Window.partitionBy("root_id", "container_id", "key").orderBy("ordinal")
    rows = members.withColumn("key", names.collision_key(F.col("name")))
    rows = rows.withColumn("occurrence", F.row_number().over(same)).withColumn("first_name", F.first("name").over(same))
    return rows.withColumns(
        {
            "traversal": F.contains("name", F.lit("..")) & F.array_contains(F.split(_slashed(F.col("name")), "/"), ".."),
            "rooted": F.startswith(_slashed(F.col("name")), F.lit("/")) | ((F.substring("name", 2, 1) == ":") & F.regexp_like("name", F.lit(r"^[A-Za-z]:[\\/]"))),
            "collides_with": F.when(F.col("occurrence") > 1, F.col("first_name")),
            "collision_kind": F.when(F.col("occurrence") > 1, F.when(F.col("name") == F.col("first_name"), "exact").otherwise("portable_normalized")),
            "dangerous": F.coalesce(names.final_extension(F.col("name")).isin(*DANGEROUS), F.lit(False)),
            "double_extension": F.coalesce(names.double_extension(F.col("name")), F.lit(False)),
            "bidi": names.has_bidi_marks(F.col("name")),
        }
    ).drop("occurrence", "first_name")


def disposition() -> Column:
    """What becomes of a member: the first that fits of directory, symlink, encrypted, unsupported, read."""
    link = (F.col("create_system") == 3) & (F.shiftrightunsigned(F.col("external_attr"), 16).bitwiseAND(F.lit(0xF000)) == 0xA000)
    return F.when(F.col("is_dir"), "directory").when(link, "symlink").when(F.col("flag_bits").bitwiseAND(F.lit(1)) == 1, "encrypted").when(~F.col("compress_type").isin(*METHODS), "unsupported").otherwise("read")


def container_paths(containers: DataFrame, most_depth: int) -> DataFrame:
    """Containers within the depth that hang on a root, with their depth and path: the ordinals of the members that lead there.

    Containers are dealt by root once, and each goes up to its root there; the task holds the ids of one root's containers, as the replay of the root does.
    """
    rows = containers.repartition("root_id").sortWithinPartitions("root_id")
    ids = ("root_id", "container_id", "parent_id", "parent_ordinal")
    at = [rows.columns.index(c) for c in ids]

    def climbed(batch: pa.RecordBatch) -> pa.RecordBatch:
        roots, numbers, parents, ordinals = (c.to_pylist() if c.null_count or not pa.types.is_integer(c.type) else c.to_numpy().tolist() for c in (batch.column(k) for k in at))
        above = dict(zip(zip(roots, numbers, strict=True), zip(parents, ordinals, strict=True), strict=True))
        places, ends, steps = [], [0], []
        for k, (root, up, ordinal) in enumerate(zip(roots, parents, ordinals, strict=True)):
            path: list[int] = []
            while up is not None and len(path) < most_depth and (further := above.get((root, up))) is not None:
                path.append(ordinal)
                up, ordinal = further
            if up is None:
                places.append(k)
                steps += path[::-1]
                ends.append(len(steps))
        paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, pa.int64()))
        kept = [c.take(pa.array(places, pa.int64())) for c in batch.columns]
        return pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends), pa.int32()), paths], names=[*batch.schema.names, "depth", "path"])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            roots = batch.column(at[0])
            last = batch.num_rows and len(roots) - pc.sum(pc.equal(roots, roots[-1])).as_py() if roots and roots[-1].is_valid else 0
            if held and roots and held[0].column(at[0])[0] != roots[0]:
                yield climbed(pa.concat_batches(held))
                held = []
            if last:
                yield climbed(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield climbed(pa.concat_batches(held))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(climb, f"{schema}, depth int, path array<long>")


#: Why an analysis is incomplete, with the kind of each reason.
REASONS = {
    "compressed_input_limit": "resource", "zip_entry_limit": "resource", "member_inspection_limit": "resource", "member_actual_byte_limit": "resource", "total_actual_byte_limit": "resource", "nested_materialization_limit": "resource",
    "malformed_archive": "malformed", "malformed_nested_archive": "malformed", "encrypted_member": "partial", "unsupported_compression_method": "partial", "nesting_depth_limit": "partial",
}
_VISIT = "place long, inspected boolean, read_bytes long, verdict string, kind string, reason string"
#: Bytes that are read of a member to tell what it is, and then at a time.
_SNIFFED, _CHUNK = 4, 1 << 16


class _Visit:
    """The state of one root's analysis while its containers and members come by in order."""

    def __init__(self, limits: Limits):
        self.limits, self.place, self.inspected, self.total, self.considered, self.nested = limits, 0, 0, 0, 0, 0
        self.seen: set[str] = set()
        self.open: set[int] = set()  # containers that are being read
        self.next: int | None = None

    def container(self, number: int, depth: int, size: int, malformed: bool | None, crowded: bool | None) -> tuple | None:
        if depth and number != self.next:
            return None
        self.considered += size
        if self.considered > self.limits.compressed_bytes:
            return False, 0, "left", "resource", "compressed_input_limit"
        if malformed:
            return False, 0, "left", "malformed", "malformed_nested_archive" if depth else "malformed_archive"
        self.open.add(number)
        return False, 0, "opened", *(("resource", "zip_entry_limit") if crowded else (None, None))

    def member(self, number: int, depth: int, what: str, size: int, child: int | None, sha: str | None) -> tuple | None:
        if number not in self.open:
            return None
        if self.inspected >= self.limits.members:
            self.open.discard(number)
            return False, 0, "left", "resource", "member_inspection_limit"
        self.inspected += 1
        if what != "read":
            return True, 0, what, *{"encrypted": ("partial", "encrypted_member"), "unsupported": ("partial", "unsupported_compression_method")}.get(what, (None, None))
        within = self.limits.total_bytes - self.total
        room = min(self.limits.member_bytes, within, *(() if child is None else (self.limits.nested_bytes - self.nested,)))
        read = min(size, max(1, room + 1))
        self.total += read
        breach = None
        if read > self.limits.member_bytes:
            breach = "member_actual_byte_limit"
        elif self.total > self.limits.total_bytes:
            breach = "total_actual_byte_limit"
        elif child is not None and self.nested + read > self.limits.nested_bytes:
            breach = "nested_materialization_limit"
        if child is not None:
            # what whole chunks have left behind, if a chunk breaks a budget
            self.nested += read if breach is None else max(0, min(read, _SNIFFED + (read - 1 - _SNIFFED) // _CHUNK * _CHUNK))
        if breach:
            self.open.discard(number)
            return True, read, "stopped", "resource", breach
        if child is None:
            return True, read, "read", None, None
        if depth + 1 > self.limits.depth:
            return True, read, "too_deep", "partial", "nesting_depth_limit"
        if sha in self.seen:
            return True, read, "repeated", None, None
        self.seen.add(sha)
        self.next = child
        return True, read, "nested", None, None


def visit(marked: DataFrame, containers: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The members (output of name_marks) and containers of each root that an analysis gets to, in its order.

    A nested container is visited at its member, before the members behind that. Budgets run over the root in this
    order. A stop ends its container only: the one above goes on, under what is left. Rows of
    containers come with ordinal 0. Columns: root_id, container_id, ordinal, those of marked (or of them those in `keep`: what isn't kept isn't
    shuffled), depth, what, place (from 1), inspected, read_bytes,
    verdict, and the kind (resource, partial, malformed) and reason of an incomplete analysis. Members that are
    not reached, behind a stop or in a container that isn't opened, give no row; where the limit of members
    ends a container there is one row that isn't inspected.

    Members beyond the entry limit of a container are left out before the root's rows are sorted; a root
    is replayed in one task, batch by batch. Members that lie by root are not shuffled, only paths are, and a nested container
    announces itself by a row before its member. Of containers that claim one member the smallest counts; members of
    equal ordinal are ordered by name.
    """
    containers = containers.select("root_id", "container_id", "parent_id", "parent_ordinal", F.col("bytes").cast("long").alias("size"), "sha", "malformed")
    kinds = {f.name: f.dataType for f in marked.schema}
    ids = ("root_id", "container_id", "ordinal")
    columns = [*ids, *(c for c in marked.columns if c not in (*ids, "depth", "what") and (keep is None or c in keep))]
    # one level more, for the members that lead there; by root again, since what Python gives has lost that
    paths = container_paths(containers, limits.depth + 1).repartition("root_id")
    number = containers.schema["container_id"].dataType

    # three rows of a container: itself, the notice before the member that holds it, and one that its members are joined with
    at = lambda *ordinal: F.concat("path", F.array(*[F.lit(x).cast("long") for x in ordinal]))
    row = lambda own, ordinal, what, child, order: F.struct(own.cast(number).alias("own"), ordinal.cast(kinds["ordinal"]).alias("ordinal"), F.lit(what).alias("what"), child.cast(number).alias("child"), order.alias("order"))
    nothing, within = F.lit(None), F.col("depth") <= limits.depth
    head = F.when(within, row(nothing, F.lit(0), "container", nothing, at(0)))
    notice = F.when(F.col("parent_ordinal").between(1, limits.entries), row(nothing, F.col("parent_ordinal"), "child", F.col("container_id"), F.col("path")))
    opener = F.when(within, row(F.col("container_id"), nothing, None, nothing, F.col("path")))
    told = paths.select(F.col("root_id").alias("_root"), F.explode(F.array_compact(F.array(head, notice, opener))).alias("r"), "container_id", "parent_id", "depth", "size", "sha", "malformed")
    of = lambda what, c: F.when(F.col("r.what") == what, F.col(c))
    told = told.select("_root", F.col("r.own").alias("_own"), F.when(F.col("r.what") == "child", F.col("parent_id")).otherwise(F.col("container_id")).alias("_container"), "depth", F.col("r.ordinal").alias("_ordinal"), F.col("r.what").alias("_what"), F.col("r.child").alias("child"), F.col("r.order").alias("_order"), of("container", "size").alias("_size"), of("child", "sha").alias("child_sha"), of("container", "malformed").alias("malformed"))

    # of the members beyond the limit the first stays, to tell that there are any
    beyond = F.col("ordinal") > limits.entries
    first = F.min(F.when(beyond, F.col("ordinal"))).over(Window.partitionBy("root_id", "container_id"))
    own = marked.withColumn("_first", first).where((F.col("ordinal") >= 1) & (~beyond | (F.col("ordinal") == F.col("_first"))))
    own = own.select(*columns, F.when(beyond, "beyond").otherwise(disposition()).alias("what"), F.col("actual_bytes").cast("long").alias("size"), F.col("name").alias("by"))
    # both sides lie by root, and rows of no member have no key
    rows = told.join(own, (F.col("_root") == F.col("root_id")) & (F.col("_own") == F.col("container_id")), "left").where("_own IS NULL OR ordinal IS NOT NULL")
    order = F.when(F.col("_own").isNull(), F.col("_order")).when(F.col("what") == "beyond", F.concat("_order", F.array(F.lit(-1).cast("long")))).otherwise(F.concat("_order", F.array(F.col("ordinal").cast("long"), F.lit(-1).cast("long"))))
    rows = rows.select(
        F.col("_root").alias("root_id"), F.col("_container").cast(kinds["container_id"]).alias("container_id"), F.coalesce("ordinal", "_ordinal").alias("ordinal"), *columns[3:], "depth", F.coalesce("_what", "what").alias("what"),
        F.coalesce("_size", "size").alias("size"), "child", "child_sha", "malformed", order.alias("order"), "by",
    )
    # the window deals a root's rows to one task and sorts them, and holds the plan to that whatever joins are chosen when it runs
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("root_id").orderBy("order", "by", "child"))).drop("order", "by")
    fields = rows.columns
    kept = [c for c in fields if c not in ("size", "child", "child_sha", "malformed", "nth")]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, claim, full = None, (None,) * 4, None
        for batch in batches:
            of = lambda c: batch.column(fields.index(c))  # noqa: E731, B023
            plain = lambda c: pc.fill_null(of(c), 0).to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(of(c).type) else of(c).to_pylist()  # noqa: E731, B023
            what = of("what").dictionary_encode()
            names_of = what.dictionary.to_pylist()
            # few rows have these
            children, malformed = (iter(pc.filter(of(c), pc.equal(of("what"), kind)).to_pylist()) for c, kind in (("child", "child"), ("malformed", "container")))
            shas = iter(pc.filter(of("child_sha"), pc.equal(of("what"), "child")).to_pylist())
            places, out = [], []
            for k, (nth, number, ordinal, depth, code, size) in enumerate(zip(plain("nth"), plain("container_id"), plain("ordinal"), plain("depth"), what.indices.to_numpy().tolist(), plain("size"), strict=True)):
                if nth == 1:
                    state, claim, full = _Visit(limits), (None,) * 4, None
                kind = names_of[code]
                if kind == "beyond":
                    full = number
                    continue
                if kind == "child":
                    child, sha = next(children), next(shas)
                    claim = claim if claim[:2] == (number, ordinal) else (number, ordinal, child, sha)
                    continue
                if kind == "container":
                    found = state.container(number, depth, size, next(malformed), number == full)
                elif number in state.open:
                    found = state.member(number, depth, kind, size, *(claim[2:] if claim[:2] == (number, ordinal) else (None, None)))
                else:
                    continue
                if found:
                    state.place += 1
                    places.append(k)
                    out.append((state.place, *found))
            at = pa.array(np.array(places, np.int64))
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [*(batch.column(fields.index(c)).take(at) for c in kept), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(x.split()[0] for x in _VISIT.split(", "))])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(replay, f"{schema}, {_VISIT}")


#: Evidence categories in the order of a member's checks, with the records each may keep of a root.
CATEGORIES = (("ARCHIVE_PATH_TRAVERSAL", 16), ("ARCHIVE_ABSOLUTE_PATH", 16), ("ARCHIVE_DUPLICATE_MEMBER", 16), ("ARCHIVE_DANGEROUS_MEMBER", 32), ("ARCHIVE_MEMBER_DOUBLE_EXTENSION", 32), ("ARCHIVE_MEMBER_BIDI_OVERRIDE", 32), ("ARCHIVE_SYMLINK", 32), ("ARCHIVE_ENCRYPTED", 32), ("ARCHIVE_NESTING_LIMIT", 32))
MOST_RECORDS = 32


def evidence(visited: DataFrame) -> DataFrame:
    """One row for each thing found at an inspected member: root_id, code, rank, name, container_id, ordinal, place."""
    what = F.col("what")
    flags = (F.col("traversal"), F.col("rooted"), F.col("collides_with").isNotNull(), F.col("dangerous"), F.col("double_extension"), F.col("bidi"), what == "symlink", what == "encrypted", F.col("verdict") == "too_deep")
    found = F.array_compact(F.array(*[F.when(flag, F.struct(F.lit(k).alias("rank"), F.lit(code).alias("code"))) for k, (flag, (code, _)) in enumerate(zip(flags, CATEGORIES, strict=True))]))
    return visited.where("inspected").select("root_id", "container_id", "ordinal", "name", "place", F.explode(found).alias("f")).select("root_id", "container_id", "ordinal", "name", "place", "f.rank", "f.code")


def retained(records: DataFrame) -> DataFrame:
    """The records that are kept: by category first, then of the root, in the order of the visit; counts stay whole."""
    order = [F.col("place"), F.col("rank")]
    cap = F.element_at(F.create_map(*[x for code, n in CATEGORIES for x in (F.lit(code), F.lit(n))]), F.col("code"))
    kept = records.withColumn("nth", F.row_number().over(Window.partitionBy("root_id", "code").orderBy(*order))).where(F.col("nth") <= cap)
    return kept.withColumn("nth_of_root", F.row_number().over(Window.partitionBy("root_id").orderBy(*order))).where(F.col("nth_of_root") <= MOST_RECORDS)


#: Findings of a root as a whole, behind those of its members and in this order; they are kept before others.
OF_ROOT = ("ARCHIVE_NESTING_LIMIT", "ARCHIVE_RESOURCE_LIMIT", "ARCHIVE_MALFORMED", "ARCHIVE_PARTIAL_ANALYSIS")
MOST_FINDINGS = 64


def reasons(visited: DataFrame) -> DataFrame:
    """root_id, kind, reason: why the analysis of a root is limited, partial or malformed (kind resource, partial, malformed)."""
    return visited.where("reason IS NOT NULL").select("root_id", "kind", "reason").distinct()


def findings(visited: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """root_id, code, n: a finding for each category of what members show, in fixed order, then those of the root.

    n counts the members, or the reasons of a finding of the root. Of more than `most` of a root, those of the root stay,
    and the first of the others; a limit that cuts is a resource reason itself (finding_limit). One
    aggregate by root over the visits, of counts and flags only, which Spark hashes; sets of reasons it would sort.
    """
    inspected = F.coalesce(F.col("inspected"), F.lit(False))
    shown = {
        "ARCHIVE_PATH_TRAVERSAL": F.col("traversal"), "ARCHIVE_ABSOLUTE_PATH": F.col("rooted"), "ARCHIVE_SYMLINK": F.col("what") == "symlink", "ARCHIVE_DUPLICATE_MEMBER": F.col("collides_with").isNotNull(),
        "ARCHIVE_DANGEROUS_MEMBER": F.col("dangerous"), "ARCHIVE_MEMBER_DOUBLE_EXTENSION": F.col("double_extension"), "ARCHIVE_MEMBER_BIDI_OVERRIDE": F.col("bidi"), "ARCHIVE_ENCRYPTED": F.col("what") == "encrypted",
    }
    by = visited.groupBy("root_id").agg(*[F.count_if(inspected & flag).alias(code) for code, flag in shown.items()], *[F.coalesce(F.bool_or(F.col("reason") == reason), F.lit(False)).alias(reason) for reason in REASONS])
    by = by.withColumn("why", F.array_compact(F.array(*[F.when(F.col(reason), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))) for reason, kind in REASONS.items()])))
    members = F.filter(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(code).alias("code"), F.col(code).alias("n")) for k, code in enumerate(shown)]), lambda r: r["n"] > 0)

    def of_root(extra: Column) -> Column:
        of = lambda test: F.size(F.filter("why", test)).cast("long")
        counts = (
            F.when(F.exists("why", lambda r: r["reason"] == "nesting_depth_limit"), F.lit(1)).otherwise(0).cast("long"),
            of(lambda r: r["kind"] == "resource") + extra, of(lambda r: r["kind"] == "malformed"), F.size("why").cast("long") + extra,
        )
        return F.filter(F.array(*[F.struct(F.lit(100 + k).alias("rank"), F.lit(code).alias("code"), n.alias("n")) for k, (code, n) in enumerate(zip(OF_ROOT, counts, strict=True))]), lambda r: r["n"] > 0)

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = by.select("root_id", members.alias("members"), "why").withColumns({"root": of_root(none), "over": of_root(one)})
    whole = F.size("members") + F.size("root") <= most
    kept = F.when(whole, F.concat("members", "root")).otherwise(F.concat(F.slice("members", F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size("over"))), F.slice("over", 1, most)))
    return rows.select("root_id", F.explode(kept).alias("f")).select("root_id", "f.code", "f.n")


def status(visited: DataFrame) -> DataFrame:
    """Status and totals of a root's analysis: malformed or partial where a reason says so, else complete. One aggregate."""
    inspected = F.coalesce(F.col("inspected"), F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    of = lambda what: inspected & (F.col("what") == what)
    out = visited.groupBy("root_id").agg(
        count(F.col("verdict") == "opened", "containers"), count(inspected, "members"), count(of("directory"), "directories"), count(of("symlink"), "symlinks"), count(of("encrypted"), "encrypted"), count(of("unsupported"), "unsupported"), count(of("read"), "read"),
        count(inspected & F.col("traversal"), "traversals"), count(inspected & F.col("rooted"), "rooted"), count(inspected & F.col("collides_with").isNotNull(), "duplicates"), count(inspected & F.col("dangerous"), "dangerous"),
        count(F.col("verdict").isin("nested", "repeated", "too_deep"), "nested"), count(F.col("verdict") == "repeated", "repeated"), F.sum("read_bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set(F.when(of("unsupported"), F.col("compress_type")))).cast("array<string>"), ",").alias("methods"),
        F.bool_or(F.col("kind") == "malformed").alias("_bad"), F.count("reason").alias("_reasons"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )
    state = F.when(F.coalesce("_bad", F.lit(False)), "MALFORMED").when(F.col("_reasons") > 0, "PARTIAL").otherwise("COMPLETE")
    return out.withColumn("status", state).drop("_bad", "_reasons")
