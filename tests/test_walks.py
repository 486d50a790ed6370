"""Inspections of page documents: what is met once, in which order, and where budgets end."""

from sluicebox.operators import walks

OBJECT = "doc_id long, object_id long, kind string, parent_id long, a array<long>, aa array<struct<trigger:string,action:long>>, next array<long>"


def inspected(spark, objects, /, **limits):
    rows = [(1, k, kind, parent, a, aa, next_) for k, kind, parent, a, aa, next_ in objects]
    return walks.inspect(spark.createDataFrame(rows, OBJECT), walks.Limits(**limits)).collect()[0]


def action(k, *next_):
    return (k, "action", None, None, None, list(next_))


def visits(r):
    return [(v["action_id"], v["source"], v["depth"]) for v in r["visited"]]


def test_branches_that_meet_again_cost_each_action_once(spark):
    graph = [(1, "open", None, [10], None, None), action(10, 11, 12), action(11, 13), action(12, 13, 10), action(13, 11)]
    r = inspected(spark, graph, actions=4)
    assert visits(r) == [(10, "OpenAction", 0), (11, "OpenAction", 1), (13, "OpenAction", 2), (12, "OpenAction", 1)] and r["reasons"] == []


def test_limits_of_actions_and_depth_at_the_right_node(spark):
    chain = [(1, "open", None, [10], None, None), action(10, 11, 20), action(11, 12), action(12, 13), action(13), action(20)]
    r = inspected(spark, chain, depth=2)
    assert visits(r) == [(10, "OpenAction", 0), (11, "OpenAction", 1), (12, "OpenAction", 2), (20, "OpenAction", 1), (13, "Object", 0)] and r["reasons"] == ["action_depth_limit"]
    r = inspected(spark, chain, actions=3)
    assert [v[0] for v in visits(r)] == [10, 11, 12] and r["reasons"] == ["action_node_limit"]


def test_fields_and_annotations_share_a_budget(spark):
    form = [(1, "field", None, None, None, None), (2, "field", 1, None, None, None), (3, "field", 1, None, None, None), (4, "field", None, None, None, None), (5, "page", None, None, None, None), (6, "annotation", 5, None, None, None), (7, "annotation", 5, None, None, None), (8, "page", None, None, None, None)]
    whole = inspected(spark, form)
    assert (whole["fields"], whole["annotations"], whole["pages"], whole["custom_objects"]) == ([4, 1, 3, 2], 2, 2, 6)
    r = inspected(spark, form, objects=5)
    assert (r["fields"], r["annotations"], r["pages"], r["objects"]) == ([4, 1, 3, 2], 1, 1, 5)
    assert r["reasons"] == ["custom_object_limit", "indirect_object_limit"]
    r = inspected(spark, form, objects=3)
    assert (r["fields"], r["annotations"]) == ([4, 1, 3], 0)
    assert inspected(spark, form, pages=1)["reasons"] == ["page_limit"]
    assert inspected(spark, form, depth=0)["reasons"] == ["form_tree_depth_limit"]


def test_holders_and_triggers(spark):
    aa = [{"trigger": t, "action": 9} for t in ("O", "C", "K")]
    objects = [(1, "catalog", None, None, aa[:1], None), (2, "page", None, None, aa, None), action(9)]
    r = inspected(spark, objects, trigger_names=2)
    assert (r["holders"], r["triggers_visited"], r["triggers"], r["triggers_capped"]) == (2, 4, ["C", "O"], True)
    r = inspected(spark, objects, triggers=3)
    assert r["reasons"] == ["additional_action_trigger_limit"] and r["triggers_visited"] == 3
    assert visits(r) == [(9, "CatalogAA", 0)]


def test_documents_are_apart(spark):
    rows = [(d, k, "action", None, None, None, [k % 3 + 1]) for d in range(40) for k in range(1, 4)]
    got = walks.inspect(spark.createDataFrame(rows, OBJECT)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and all(len(r["visited"]) == 3 for r in got)


def test_links_are_kept_in_order(spark):
    links = [(1, k, t) for k, t in enumerate(["https://u:p@Host.example:8/x?q", None, "mailto:a", "nothing"], 1)]
    r = walks.link_targets(spark.createDataFrame(links, "doc_id long, place long, target string"), 3, 3).collect()[0]
    assert [tuple(t) for t in r["targets"]] == [("parsed", "https", "host.example"), ("missing", None, None), ("parsed", "mailto", None)]
    assert (r["links"], r["capped"], r["reasons"]) == (4, True, ["uri_action_limit"])


def test_page_queries_read_and_deal_the_objects_once(spark):
    """Subtypes come with the visits and counts with the inspection, so nothing is joined to them; documents stay where the view has put them."""
    from sluicebox.plans import page_queries

    for query in (page_queries.p02_action_walk, page_queries.p03_04_capabilities, page_queries.p05_uri_targets, page_queries.p10_15_object_budgets, page_queries.p11_page_results, page_queries.p12_form_fields):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("FileScan parquet"), plan.count("Join"), plan.count("REPARTITION_BY_COL")) == (1, 0, 0), plan


def test_documents_over_many_batches(spark):
    """A document may be longer than a batch, and end with it."""
    rows = [(d, k, "action", None, [k], None, [k + 1]) for d in range(5) for k in range(1, 1 + (7, 3, 20, 1, 4)[d])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r["doc_id"]: r for r in walks.inspect(spark.createDataFrame(rows, OBJECT), walks.Limits(depth=100)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {d: [v["action_id"] for v in r["visited"]] for d, r in got.items()} == {d: list(range(1, n + 1)) for d, n in enumerate((7, 3, 20, 1, 4))}
