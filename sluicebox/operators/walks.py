"""Page documents as graphs: which objects and actions an inspection gets to, in its order, under its budgets.

Objects: doc_id, object_id (their order in the file), kind (open, catalog, name, acroform, field, page, annotation,
action, other), parent_id (of fields and annotations), a (the object's actions), aa (additional actions as
trigger and action), subtype and next (of actions). Actions are named by object_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


@dataclass(frozen=True)
class Limits:
    """What an inspection of one document visits at most. Fixed values."""

    pages: int = 10_000
    objects: int = 100_000
    depth: int = 32
    actions: int = 512
    triggers: int = 128
    trigger_names: int = 32


SCHEMA = """doc_id long, visited array<struct<action_id:long,source:string,depth:int,subtype:string>>, fields array<long>, pages long, annotations long, objects long,
    names long, holders long, triggers_visited long, triggers array<string>, triggers_capped boolean, custom_objects long, open_actions long, forms long, reasons array<string>"""
_VISIT = (("action_id", pa.int64()), ("source", pa.string()), ("depth", pa.int32()), ("subtype", pa.string()))
_PLAIN = ("pages", "annotations", "objects", "names", "holders", "triggers_visited", "custom_objects", "open_actions", "forms")


class _Rows:
    """A batch of objects, column by column; lists are flat values and where each row's begin and end."""

    def __init__(self, batch: pa.RecordBatch):
        plain = lambda c: batch.column(c).to_pylist()
        self.doc_id, self.object_id, self.kind, self.parent_id, self.subtype, self.nth = map(plain, ("doc_id", "object_id", "kind", "parent_id", "subtype", "nth"))
        self.a, self.next = self.lists(batch.column("a")), self.lists(batch.column("next"))
        self.aa = self.lists(batch.column("aa"))

    @staticmethod
    def lists(column: pa.ListArray) -> list[list | None]:
        at, there = column.offsets.to_numpy().tolist(), column.is_valid().to_pylist()
        flat = column.values
        flat = list(zip(flat.field("trigger").to_pylist(), flat.field("action").to_pylist(), strict=True)) if pa.types.is_struct(flat.type) else flat.to_pylist()
        return [flat[i:j] if ok else None for i, j, ok in zip(at, at[1:], there, strict=False)]


class _Document:
    """One document's inspection, of the rows from lo to hi. Budgets are shared by all that is visited, so the order of visits matters."""

    def __init__(self, rows: _Rows, lo: int, hi: int, limits: Limits):
        self.limits, self.rows, self.lo, self.hi = limits, rows, lo, hi
        kind, parent, ids = rows.kind, rows.parent_id, rows.object_id
        self.by_id = dict(zip(ids[lo:hi], range(lo, hi), strict=True))
        self.of_kind: dict[str, list[int]] = {}
        self.kids: dict[tuple, list[int]] = {}
        for i in range(lo, hi):
            k = kind[i]
            if k in self.of_kind:
                self.of_kind[k].append(i)
            else:
                self.of_kind[k] = [i]
            if parent[i] is not None and k in ("field", "annotation"):
                self.kids.setdefault((k, parent[i]), []).append(i)
        self.seen: set[int] = set()
        self.held: set[int] = set()
        self.visited, self.fields, self.reasons = [], [], set()
        self.pages = self.annotations = self.objects = self.names = self.triggers_visited = self.custom_objects = 0
        self.triggers: set[str] = set()
        self.triggers_capped = False

    def run(self) -> "_Document":
        of, a, most = self.of_kind, self.rows.a, self.limits
        if len(of.get("page", ())) > most.pages:
            self.reasons.add("page_limit")
        if self.hi - self.lo > most.objects:
            self.reasons.add("indirect_object_limit")
        for i in of.get("open", ()):
            self.walk(a[i], "OpenAction")
        for i in of.get("catalog", ()):
            self.additional(i, "Catalog")
        for i in of.get("name", ()):
            if self.names >= most.actions:
                self.reasons.add("javascript_name_tree_limit")
                break
            self.names += 1
            self.walk(a[i], "NameTree")
        for i in of.get("acroform", ()):
            self.additional(i, "AcroForm")
        self.form()
        self.all_pages()
        kind, aa, ids = self.rows.kind, self.rows.aa, self.rows.object_id
        self.objects = min(self.hi - self.lo, most.objects)
        for i in range(self.lo, self.lo + self.objects):
            if a[i]:
                self.walk(a[i], "Object")
            if aa[i] is not None:
                self.additional(i, "Object")
            if kind[i] == "action" and ids[i] not in self.seen:
                self.walk((ids[i],), "Object")
        self.doc_id, self.holders = self.rows.doc_id[self.lo], len(self.held)
        self.open_actions, self.forms = sum(1 for i in of.get("open", ()) if a[i]), len(of.get("acroform", ()))
        return self

    def spend(self) -> bool:
        if self.custom_objects >= self.limits.objects:
            self.reasons.add("custom_object_limit")
            return False
        self.custom_objects += 1
        return True

    def form(self) -> None:
        """Fields, the last of each row first; one that is met again costs an object but isn't counted."""
        met: set[int] = set()
        ids, parent = self.rows.object_id, self.rows.parent_id
        left = [(i, 0) for i in self.of_kind.get("field", ()) if parent[i] is None]
        while left:
            i, depth = left.pop()
            if depth > self.limits.depth:
                self.reasons.add("form_tree_depth_limit")
                continue
            if not self.spend():
                return
            if ids[i] in met:
                continue
            met.add(ids[i])
            self.fields.append(ids[i])
            self.holder(i, "FormField")
            left += [(k, depth + 1) for k in self.kids.get(("field", ids[i]), ())]

    def all_pages(self) -> None:
        for page in self.of_kind.get("page", ())[: self.limits.pages]:
            self.pages += 1
            self.holder(page, "Page")
            for i in self.kids.get(("annotation", self.rows.object_id[page]), ()):
                if not self.spend():
                    return
                self.annotations += 1
                self.holder(i, "Annotation")

    def holder(self, i: int, source: str) -> None:
        self.walk(self.rows.a[i], source)
        self.additional(i, source)

    def additional(self, i: int, source: str) -> None:
        aa, number = self.rows.aa[i], self.rows.object_id[i]
        if aa is None or number in self.held:
            return
        self.held.add(number)
        for trigger, action in aa:
            if self.triggers_visited >= self.limits.triggers:
                self.reasons.add("additional_action_trigger_limit")
                break
            self.triggers_visited += 1
            if len(self.triggers) < self.limits.trigger_names:
                self.triggers.add(trigger)
            else:
                self.triggers_capped = True
            self.walk((action,), f"{source}AA")

    def walk(self, actions: list[int] | tuple | None, source: str) -> None:
        """Actions and what follows them, depth first; each costs one visit however many ways lead to it."""
        if not actions:
            return
        left = [(a, 0) for a in reversed(actions)]
        by_id, kind, seen = self.by_id, self.rows.kind, self.seen
        while left:
            number, depth = left.pop()
            if depth > self.limits.depth:
                self.reasons.add("action_depth_limit")
                continue
            i = by_id.get(number)
            if i is None or kind[i] != "action" or number in seen:
                continue
            if len(self.visited) >= self.limits.actions:
                self.reasons.add("action_node_limit")
                continue
            seen.add(number)
            self.visited.append((number, source, depth, self.rows.subtype[i]))
            left += [(a, depth + 1) for a in reversed(self.rows.next[i] or ())]


def _batch(done: list[_Document]) -> pa.RecordBatch:
    """Results of documents as a batch, its lists from flat columns."""

    def lists(of: list, values: Callable[[list], pa.Array]) -> pa.Array:
        at = np.zeros(len(of) + 1, np.int32)
        np.cumsum([len(x) for x in of], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), values([y for x in of for y in x]))

    def visits(flat: list) -> pa.Array:
        columns = zip(*flat, strict=True) if flat else [[]] * len(_VISIT)
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _VISIT, strict=True)], names=[n for n, _ in _VISIT])

    text, numbers = (lambda v: pa.array(v, pa.string())), (lambda v: pa.array(v, pa.int64()))
    columns = {c: numbers([getattr(d, c) for d in done]) for c in ("doc_id", *_PLAIN)}
    columns |= {"visited": lists([d.visited for d in done], visits), "fields": lists([d.fields for d in done], numbers), "triggers": lists([sorted(d.triggers) for d in done], text), "reasons": lists([sorted(d.reasons) for d in done], text)}
    columns["triggers_capped"] = pa.array([d.triggers_capped for d in done], pa.bool_())
    names_ = re.findall(r"(\w+) (?:long|boolean|array)", SCHEMA)
    return pa.RecordBatch.from_arrays([columns[c] for c in names_], names=names_)


def inspect(objects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document: the actions visited, in order, with their source, depth and subtype; fields in order; counts; reasons (sorted).

    The order is that of the open action, the catalog's additional actions, the script names, the form's, the
    fields, the pages with their annotations, and all objects of the file. A field, an annotation costs
    one of the custom objects, an action one of the actions; at a limit the part that met it ends, with a reason.
    Visits in depth-first order under budgets can't be told apart from the steps before them, so
    a document's objects are taken together by one task; documents come one by one. They are numbered by a window, which
    shuffles them only if they don't lie by document yet. The subtype may be missing.
    """
    subtype = F.col("subtype") if "subtype" in objects.columns else F.lit(None).cast("string")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("object_id"))
    rows = objects.select("doc_id", "object_id", "kind", "parent_id", "a", "aa", "next", subtype.alias("subtype"), nth.alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if not len(starts):
                held.append(batch)
                continue
            own = pa.concat_batches([*held, batch.slice(0, starts[-1])])
            held = [batch.slice(starts[-1])]
            if own.num_rows:
                yield inspected(own)
        if held:
            yield inspected(pa.concat_batches(held))

    def inspected(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _Rows(batch)
        at = [*(i for i, n in enumerate(own.nth) if n == 1), batch.num_rows]
        return _batch([_Document(own, lo, hi, limits).run() for lo, hi in zip(at, at[1:], strict=False)])

    return rows.mapInArrow(run, SCHEMA)


def visited_actions(inspected: DataFrame, *more: str) -> DataFrame:
    """doc_id, place (from 1), action_id, source, depth of each visit, and more of its fields."""
    return inspected.select("doc_id", F.posexplode("visited").alias("place", "v")).select("doc_id", (F.col("place") + 1).alias("place"), "v.action_id", "v.source", "v.depth", *[f"v.{c}" for c in more])


def visits_of(subtype: str) -> Column:
    """How many actions of a subtype a document's inspection visited."""
    return F.size(F.filter("visited", lambda v: v["subtype"] == subtype)).cast("long")


def link_targets(links: DataFrame, most_kept: int = 32, most_links: int = 128) -> DataFrame:
    """doc_id, links, targets, capped, reasons of visited links (doc_id, place, target).

    targets are the first ones in visiting order as parse_status, scheme and hostname, nothing else of a link is kept; capped
    tells that there were more. Links beyond most_links are a reason for a partial result.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    target = F.struct(names.link_status(F.col("target")).alias("parse_status"), names.link_scheme(F.col("target")).alias("scheme"), names.link_host(F.col("target")).alias("hostname"))
    rows = links.withColumn("nth", nth).withColumn("kept", F.when(F.col("nth") <= most_kept, F.struct("nth", target.alias("target"))))
    out = rows.groupBy("doc_id").agg(F.max("nth").cast("long").alias("links"), F.transform(F.array_sort(F.collect_list("kept")), lambda x: x["target"]).alias("targets"))
    return out.withColumns({"capped": F.col("links") > most_kept, "reasons": F.array_compact(F.array(F.when(F.col("links") > most_links, "uri_action_limit")))})
