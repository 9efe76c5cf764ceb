"""Graph and link operators."""

import random

import pytest
from pyspark.sql import functions as F

from batchwright.errors import BatchError
from batchwright.model import Check, Entity, ForeignKey, Model, Navigation
from batchwright.operators import graph, links
from batchwright.options import Cascade, Cycles, DuplicateKey, GraphOptions, LinkInsert, NavigationFilter, Orphans
from batchwright.queries.graphs import QUERIES

MODEL = Model.of(
    Entity("order", ("id",), navigations=(Navigation("items", "item", ("order_id",)),)),
    Entity("item", ("id",), foreign_keys=(ForeignKey(("order_id",), "order", "cascade"),), checks=(Check("qty > 0", "quantity"),), navigations=(Navigation("notes", "note", ("item_id",)),)),
    Entity("note", ("id",), foreign_keys=(ForeignKey(("item_id",), "item", "cascade"),), checks=(Check("length(text) > 0", "blank"),)),
)
TREE = Model.of(Entity("node", ("id",), foreign_keys=(ForeignKey(("parent",), "node", "cascade"),), navigations=(Navigation("children", "node", ("parent",), required=False),)))


def tables(spark, orders, items, notes):
    return {
        "order": spark.createDataFrame(orders, "__idx long, id long"),
        "item": spark.createDataFrame(items, "id long, order_id long, qty long"),
        "note": spark.createDataFrame(notes, "id long, item_id long, text string"),
    }


def nothing(frames):
    return {k: v.drop("__idx").limit(0) for k, v in frames.items()}


def test_a_bad_leaf_fails_its_root_only(spark):
    frames = tables(spark, [(0, 1), (1, 2)], [(10, 1, 1), (20, 2, 1)], [(100, 10, "x"), (200, 20, "")])
    result = graph.insert_graph(frames, nothing(frames), MODEL, "order")
    found = {r["idx"]: (r["status"], r["reason"], r["message"]) for r in result.outcomes.collect()}
    assert found == {0: ("Success", None, None), 1: ("Failed", "ValidationError", "Graph insert failed: ValidationError")}
    assert [r["id"] for r in result.state["note"].collect()] == [100]
    assert sorted((r["depth"], r["entity"], r["rows"]) for r in result.statistics().collect()) == [(0, "order", 1), (1, "item", 1), (2, "note", 1)]


def test_depth_and_filter(spark):
    frames = tables(spark, [(0, 1)], [(10, 1, 1)], [(100, 10, "x")])
    assert set(graph.expand(frames, MODEL, "order", GraphOptions(max_depth=0))) == {"order"}
    assert set(graph.expand(frames, MODEL, "order", GraphOptions(max_depth=1))) == {"order", "item"}
    assert set(graph.expand(frames, MODEL, "order", GraphOptions(navigation_filter=NavigationFilter.including(("order", "items"))))) == {"order", "item"}
    with pytest.raises(BatchError):
        graph.expand(frames, MODEL, "order", GraphOptions(navigation_filter=NavigationFilter.including(("order", "nothing"))))
    with pytest.raises(ValueError):
        NavigationFilter.including()


def test_chain_of_six_with_depth_three(spark):
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, 7)]
    root = spark.createDataFrame([(0, 1, None)], "__idx long, id long, parent long")
    below = spark.createDataFrame(rows[1:], "id long, parent long")
    frames = {"node": root.unionByName(below, allowMissingColumns=True)}
    start = frames["node"].where("__idx = 0")
    nodes = graph.expand({"node": frames["node"].where("__idx is null").drop("__idx").withColumn("__idx", F.lit(None).cast("long")).unionByName(start)}, TREE, "node", GraphOptions(max_depth=3))
    assert nodes["node"].where("__root = 0").count() == 4


def test_first_root_gets_a_shared_child(spark):
    claims = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c")], "root long, key string")
    assert sorted(r[0] for r in graph.first_roots(claims).collect()) == [0, 2, 3]


def test_orphans(spark):
    stored = tables(spark, [(0, 1)], [(10, 1, 1), (11, 1, 1)], [(100, 11, "x"), (101, 10, "y")])
    targets = {k: v.drop("__idx") for k, v in stored.items()}
    frames = {**tables(spark, [(0, 1)], [(10, 1, 5)], [(101, 10, "y")])}
    with pytest.raises(BatchError):
        graph.update_graph(frames, targets, MODEL, "order")
    gone = graph.update_graph(frames, targets, MODEL, "order", GraphOptions(orphans=Orphans.DELETE)).state
    assert sorted(tuple(r) for r in gone["item"].collect()) == [(10, 1, 5)]
    assert sorted(r["id"] for r in gone["note"].collect()) == [101]
    kept = graph.update_graph(frames, targets, MODEL, "order", GraphOptions(orphans=Orphans.DETACH)).state
    assert sorted(r["id"] for r in kept["item"].collect()) == [10, 11]


def test_delete_modes(spark):
    stored = tables(spark, [(0, 1), (1, 2)], [(10, 1, 1)], [(100, 10, "x")])
    targets = {k: v.drop("__idx") for k, v in stored.items()}
    state = graph.delete_graph(stored["order"].where("id = 1"), targets, MODEL, "order").state
    assert [state[k].count() for k in ("order", "item", "note")] == [1, 0, 0]
    with pytest.raises(BatchError):
        graph.delete_graph(stored["order"], targets, MODEL, "order", GraphOptions(cascade=Cascade.THROW))
    absent = graph.delete_graph(spark.createDataFrame([(0, 9)], "__idx long, id long"), targets, MODEL, "order")
    assert absent.outcomes.first()["reason"] == "ConcurrencyConflict"


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, 5)], "node long, parent long")
    assert sorted(r[0] for r in graph.cycle_nodes(edges).collect()) == [1, 2, 3, 5]
    chain = graph.chain(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node long, parent long"))
    assert sorted(tuple(r) for r in chain.collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]
    model = Model.of(Entity("a", ("id",), navigations=(Navigation("bs", "b", ("a_id",)), Navigation("more", "b", ("a_id",)))), Entity("b", ("id",)))
    frames = {"a": spark.createDataFrame([(0, 1)], "__idx long, id long"), "b": spark.createDataFrame([(5, 1)], "id long, a_id long")}
    with pytest.raises(BatchError):
        graph.insert_graph(frames, nothing(frames), model, "a")
    assert graph.insert_graph(frames, nothing(frames), model, "a", GraphOptions(cycles=Cycles.IGNORE)).state["b"].count() == 1


def test_links(spark):
    stored = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "l long, r long")
    wanted = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 1, 3)], "__root long, l long, r long")
    pair = (("l",), ("r",))
    assert [tuple(r) for r in links.created(wanted, stored, *pair).select("l", "r").collect()] == [(1, 3)]
    change = links.changes(stored, wanted, *pair)
    assert sorted(tuple(r) for r in change.collect()) == [(1, 1, "removed"), (1, 3, "added")]
    assert sorted(tuple(r) for r in links.apply_changes(stored, change, *pair).collect()) == [(1, 2), (1, 3), (2, 1)]
    assert [tuple(r) for r in links.over_cap(wanted, 2).collect()] == [(0, 3)]
    assert links.over_cap(wanted, 0).count() == 0
    related = spark.createDataFrame([(2,)], "id long")
    assert [(r["root"], r["ids"]) for r in links.missing_related(wanted, related, ("r",), ("id",)).collect()] == [(0, ["3"])]


SCHOOL = Model.of(
    Entity("student", ("id",), navigations=(Navigation("courses", "course", ("student_id",), "link", "enrolled", ("course_id",)),)),
    Entity("course", ("id",)),
    Entity("enrolled", ("student_id", "course_id"), foreign_keys=(ForeignKey(("student_id",), "student", "cascade"), ForeignKey(("course_id",), "course"))),
)


def school(spark):
    targets = {"student": spark.createDataFrame([(9,)], "id long"), "course": spark.createDataFrame([(1,), (2,)], "id long"), "enrolled": spark.createDataFrame([(9, 1)], "student_id long, course_id long")}
    frames = {"student": spark.createDataFrame([(0, 5), (1, 6)], "__idx long, id long"), "course": spark.createDataFrame([(1,), (2,), (3,)], "id long"), "enrolled": spark.createDataFrame([(5, 1), (5, 2), (6, 3)], "student_id long, course_id long")}
    return frames, targets


def test_graphs_with_links(spark):
    frames, targets = school(spark)
    options = GraphOptions(include_links=True, cycles=Cycles.IGNORE_ALL)
    result = graph.insert_graph(frames, targets, SCHOOL, "student", options)
    assert {r["idx"]: r["reason"] for r in result.outcomes.collect()} == {0: None, 1: "DatabaseConstraint"}
    assert sorted(tuple(r) for r in result.state["enrolled"].collect()) == [(5, 1), (5, 2), (9, 1)]
    assert "course" not in result.state
    assert [tuple(r) for r in result.extra["links"].collect()] == [("student.courses", 2, 0)]
    new = graph.insert_graph(frames, targets, SCHOOL, "student", GraphOptions(include_links=True, cycles=Cycles.IGNORE_ALL, link_insert=LinkInsert.INSERT_IF_NEW))
    assert sorted(r["id"] for r in new.state["course"].collect()) == [1, 2, 3]
    capped = graph.insert_graph(frames, targets, SCHOOL, "student", GraphOptions(include_links=True, cycles=Cycles.IGNORE_ALL, max_link_count=1, validate_links=False))
    assert {r["idx"]: r["reason"] for r in capped.outcomes.collect()} == {0: "ValidationError", 1: None}


def test_link_changes_of_an_updated_root(spark):
    frames, targets = school(spark)
    frames["student"] = spark.createDataFrame([(0, 9)], "__idx long, id long")
    frames["enrolled"] = spark.createDataFrame([(9, 2)], "student_id long, course_id long")
    result = graph.update_graph(frames, targets, SCHOOL, "student", GraphOptions(include_links=True, cycles=Cycles.IGNORE_ALL, orphans=Orphans.DETACH))
    assert [tuple(r) for r in result.state["enrolled"].collect()] == [(9, 2)]
    assert [tuple(r) for r in result.extra["links"].collect()] == [("student.courses", 1, 1)]


def test_first_roots_with_several_keys_against_one_after_the_other(spark):
    rng = random.Random(5)
    claims = [(root, f"k{rng.randrange(60)}") for root in range(80) for _ in range(rng.randrange(1, 5))]
    taken, expected = set(), []
    for root in range(80):
        own = {k for r, k in claims if r == root}
        if not own & taken:
            taken |= own
            expected.append(root)
    assert sorted(r[0] for r in graph.first_roots(spark.createDataFrame(claims, "root long, key string")).collect()) == expected
    assert "graph_first_claims" not in QUERIES  # it read a fiftieth of the orders and never called first_roots


SHOP = Model.of(
    Entity("shop", ("id",), generated_key=True, uniques=(("name",),), navigations=(Navigation("goods", "good", ("shop_id",)),)),
    Entity("good", ("id",), generated_key=True, uniques=(("num",),), foreign_keys=(ForeignKey(("shop_id",), "shop", "cascade"),), checks=(Check("price > 0", "price"),), navigations=(Navigation("parts", "part", ("good_id",)),)),
    Entity("part", ("id",), generated_key=True, foreign_keys=(ForeignKey(("good_id",), "good", "cascade"),)),
)


def shops(spark, stored=()):
    return {
        "shop": spark.createDataFrame(list(stored), "id int, name string"),
        "good": spark.createDataFrame([(7, 70, 5, 1)] if stored else [], "id long, num long, shop_id int, price long"),
        "part": spark.createDataFrame([], "id long, good_id long"),
    }


def test_new_rows_of_a_graph_get_ids(spark):
    """Roots and children without keys, several levels down; a failing root takes no id."""
    frames = {
        "shop": spark.createDataFrame([(0, 0, "a"), (1, None, "b"), (2, 0, "c"), (3, 0, "d")], "__idx long, id int, name string"),
        "good": spark.createDataFrame([(0, 0, 1, 0, 0, 1), (1, 0, 2, 0, 0, 1), (2, 0, 3, 0, 1, -1), (3, 0, 4, 0, 3, 1), (4, 9, 5, 0, 3, 1)], "__idx long, id long, num long, shop_id int, __owner long, price long"),
        "part": spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 0, 4), (0, 0, 4)], "id long, good_id long, __owner long"),
    }
    result = graph.insert_graph(frames, shops(spark, [(5, "old")]), SHOP, "shop")
    assert {r["idx"]: (r["entity_id"]["id"], r["status"], r["reason"]) for r in result.outcomes.collect()} == {0: (6, "Success", None), 1: (0, "Failed", "ValidationError"), 2: (7, "Success", None), 3: (8, "Success", None)}
    goods = {(r["id"], r["num"], r["shop_id"]) for r in result.state["good"].collect()}
    assert goods == {(7, 70, 5), (10, 1, 6), (11, 2, 6), (12, 4, 8), (9, 5, 8)}
    assert sorted((r["id"], r["good_id"]) for r in result.state["part"].collect()) == [(1, 10), (2, 12), (3, 9), (4, 9)]
    assert result.state["shop"].schema == shops(spark)["shop"].schema
    edges = {(r["parent"], r["entity"], r["id"], r["depth"]) for r in result.hierarchy().collect()}
    assert {(None, "shop", "6", 0), ("shop 6", "good", "10", 1), ("good 9", "part", "3", 2)} <= edges


def test_unique_values_in_graphs(spark):
    stored = shops(spark, [(5, "old"), (6, "other")])
    frames = {
        "shop": spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (2, 0, "old"), (3, 0, "e"), (4, 0, "f")], "__idx long, id int, name string"),
        "good": spark.createDataFrame([(0, 0, 70, 0, 3, 1), (1, 0, 8, 0, 4, 1), (2, 0, 8, 0, 4, 1)], "__idx long, id long, num long, shop_id int, __owner long, price long"),
        "part": stored["part"],
    }
    found = graph.insert_graph(frames, stored, SHOP, "shop").outcomes.collect()
    assert {r["idx"]: r["reason"] for r in found} == {0: None, 1: "DuplicateKey", 2: "DuplicateKey", 3: "DuplicateKey", 4: "DuplicateKey"}
    frames = {"shop": spark.createDataFrame([(0, 5, "other"), (1, 6, "new"), (2, 6, "other"), (3, 5, "new")], "__idx long, id int, name string"), "good": stored["good"], "part": stored["part"]}
    found = graph.update_graph(frames, stored, SHOP, "shop", GraphOptions(orphans=Orphans.DETACH)).outcomes.collect()
    assert {r["idx"]: r["reason"] for r in found} == {0: "DuplicateKey", 1: None, 2: None, 3: "DuplicateKey"}


def test_upsert_graph_without_keys(spark):
    """The second new root of a name is a duplicate; new children of a stored root are inserted."""
    stored = shops(spark, [(5, "old")])
    frames = {
        "shop": spark.createDataFrame([(0, 5, "older"), (1, 0, "n"), (2, 0, "n")], "__idx long, id int, name string"),
        "good": spark.createDataFrame([(0, 7, 70, 5, None, 2), (1, 0, 71, 0, 0, 1), (2, 0, 72, 0, 0, 1), (3, 0, 73, 0, 1, 1)], "__idx long, id long, num long, shop_id int, __owner long, price long"),
        "part": stored["part"],
    }
    for strategy, last in ((DuplicateKey.FAIL, ("Failed", "DuplicateKey", False)), (DuplicateKey.SKIP, ("Skipped", None, False)), (DuplicateKey.RETRY_AS_UPDATE, ("Failed", "ConcurrencyConflict", True))):
        result = graph.upsert_graph(frames, stored, SHOP, "shop", GraphOptions(duplicate_key=strategy))
        found = {r["idx"]: (r["status"], r["reason"], r["retried"]) for r in result.outcomes.collect()}
        assert found == {0: ("Success", None, False), 1: ("Success", None, False), 2: last}
        assert sorted((r["id"], r["num"], r["shop_id"]) for r in result.state["good"].collect()) == [(7, 70, 5), (8, 71, 5), (9, 72, 5), (10, 73, 6)]
        assert sorted((r["id"], r["name"]) for r in result.state["shop"].collect()) == [(5, "older"), (6, "n")]


def test_stored_key_is_retried_as_update(spark):
    model = Model.of(Entity("order", ("id",), navigations=(Navigation("items", "item", ("order_id",)),)), Entity("item", ("id",)))
    stored = {"order": spark.createDataFrame([(0, "x")], "id long, v string"), "item": spark.createDataFrame([], "id long, order_id long")}
    frames = {"order": spark.createDataFrame([(0, 0, "y")], "__idx long, id long, v string"), "item": spark.createDataFrame([(3, 0)], "id long, order_id long").limit(0)}
    result = graph.upsert_graph(frames, stored, model, "order", GraphOptions(duplicate_key=DuplicateKey.RETRY_AS_UPDATE))
    row = result.outcomes.first()
    assert (row["operation"], row["status"], row["retried"], row["is_default_key"]) == ("Update", "Success", True, True)
    assert [r["v"] for r in result.state["order"].collect()] == ["y"]


def test_delete_graph_marks_depth_and_repeats(spark):
    orders = spark.createDataFrame([(1,), (2,)], "id long")
    stored = {"order": orders, "item": spark.createDataFrame([(10, 1, 1), (11, 1, 1), (20, 2, 1)], "id long, order_id long, qty long"), "note": spark.createDataFrame([(100, 10, "x")], "id long, item_id long, text string")}
    roots = spark.createDataFrame([(0, 1), (1, 1), (2, 9)], "__idx long, id long")
    result = graph.delete_graph(roots, stored, MODEL, "order")
    assert {r["idx"]: r["reason"] for r in result.outcomes.collect()} == {0: None, 1: "ConcurrencyConflict", 2: "ConcurrencyConflict"}
    assert sorted((r["root"], r["parent"], r["id"], r["depth"]) for r in result.hierarchy().collect() if r["depth"]) == [(0, "item 10", "100", 2), (0, "order 1", "10", 1), (0, "order 1", "11", 1)]
    assert [r["id"] for r in result.state["item"].collect()] == [20] and result.state["note"].count() == 0
    strict = Model(MODEL.entities | {"item": Entity("item", ("id",), foreign_keys=(ForeignKey(("order_id",), "order", "restrict"),))})
    shallow = graph.delete_graph(roots, stored, strict, "order", GraphOptions(max_depth=0))
    assert shallow.outcomes.where("idx = 0").first()["reason"] == "DatabaseConstraint" and shallow.state["item"].count() == 3
    with pytest.raises(BatchError, match="2 of item"):
        graph.delete_graph(roots, stored, MODEL, "order", GraphOptions(cascade=Cascade.THROW))


def test_rows_that_delete_each_other_go(spark):
    rows = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, None)], "id long, parent long")
    result = graph.delete_graph(spark.createDataFrame([(0, 2)], "__idx long, id long"), {"node": rows}, TREE, "node")
    assert [r["id"] for r in result.state["node"].collect()] == [5]


def test_long_chains_and_cycles(spark):
    long = spark.range(3000).selectExpr("id AS node", "if(id = 0, null, id - 1) AS parent")
    assert {(r["root"], r["node"] - r["depth"]) for r in graph.chain(long).collect()} == {(0, 0)}
    assert graph.chain(long, 10).count() == 11 and graph.chain(long.limit(0)).count() == 0
    ring = spark.range(1000).selectExpr("id AS node", "(id + 1) % 1000 AS parent").unionByName(spark.range(1000, 1400).selectExpr("id AS node", "id - 1 AS parent"))
    assert sorted(r["node"] for r in graph.cycle_nodes(ring.unionByName(long.selectExpr("node + 5000", "parent + 5000").toDF("node", "parent"))).collect()) == list(range(1000))
    assert graph.cycle_nodes(long).count() == 0


def test_rows_without_a_key_to_rename_are_dealt_out(spark):
    """Null and given keys meet no id; they once went to one task by their common value."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = graph.PROVISIONAL - 3
        ids = spark.createDataFrame([(old, 70)], "__old long, __new long")
        rows = spark.range(400).selectExpr("id AS n", f"if(id = 7, 'orders {old}', null) AS __parent", f"case when id = 7 then {old}L when id = 9 then null else 5L end AS fk")
        for column, text, known in (("__parent", "orders ", "orders 70"), ("fk", None, 70)):
            made = graph._renamed(rows, column, ids, text)
            assert made.where("n = 7").first()[column] == known and made.count() == 400
            assert made.where(F.col(column).isNull()).count() == (399 if text else 1)
            assert max(map(len, made.rdd.glom().collect())) < 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_link_changes_are_one_aggregation(spark):
    """Stored and wanted links meet in one shuffle by link; nulls are as they were with joins."""
    stored = spark.createDataFrame([(1, 1), (1, None), (None, 2), (3, 4), (2, 2)], "a long, b long")
    wanted = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 2, None), (9, None, 2)], "__root long, a long, b long")
    made = links.changes(stored, wanted, ("a",), ("b",))
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(1, 2, "added"), (None, 2, "added"), (1, None, "removed"), (2, 2, "removed")], key=str)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_payload_of_added_links(spark):
    stored = spark.createDataFrame([(1, 1, "kept"), (1, 2, "gone")], "a long, b long, note string")
    wanted = spark.createDataFrame([(0, 1, 1, "no"), (0, 1, 3, "new")], "__root long, a long, b long, note string")
    change = links.changes(stored, wanted, ("a",), ("b",))
    assert sorted(map(tuple, links.apply_changes(stored, change, ("a",), ("b",), wanted).collect())) == [(1, 1, "kept"), (1, 3, "new")]


def test_depth_with_links_is_bounded():
    with pytest.raises(ValueError):
        GraphOptions(max_depth=101, include_links=True)
    assert GraphOptions(max_depth=101).depth == 100
