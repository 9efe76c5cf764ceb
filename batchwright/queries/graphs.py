"""Queries of the graph and link operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.model import Check, Entity, ForeignKey, Model, Navigation
from batchwright.operators import graph, links
from batchwright.options import Cascade, Cycles, DuplicateKey, GraphOptions, NavigationFilter, Orphans
from batchwright.plans.index import IDX, with_index
from batchwright.queries.rows import CUSTOMERS, LINE_KEY, ORDERS, raises
from batchwright.queries.tables import MODEL, indexed, none_of, read
from batchwright.session import materialize

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Orders and their lines only, without the rule on discounts where keys matter.
TWO = Model.of(
    Entity("orders", ("o_orderkey",), navigations=(Navigation("lines", "lineitem", ("l_orderkey",)),)),
    replace(MODEL["lineitem"], foreign_keys=(ForeignKey(("l_orderkey",), "orders", "cascade"),), navigations=()),
)
LOOSE = Model(TWO.entities | {"lineitem": replace(TWO["lineitem"], checks=())})
ONCE = GraphOptions(cycles=Cycles.IGNORE_ALL)
TREE = ("region", "nation", "customer", "orders", "lineitem")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(read(spark, sf_dir, "orders"))


def one_line_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the least part of each key, so that keys are unique; written once, as they are read several times."""
    lines = read(spark, sf_dir, "lineitem")
    rest = [c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]
    each = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("r")).select("l_orderkey", *(F.col("r")[c].alias(c) if c in rest else c for c in lines.columns if c != "l_orderkey"))
    return materialize(each, "lines")


KEYED = "numbered AS (SELECT *, row_number() OVER (ORDER BY " + ORDERS + ") - 1 AS idx FROM orders), keyed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS nr FROM lineitem), lines AS (SELECT * FROM keyed WHERE nr = 1)"


@query(
    f"""WITH {KEYED}, bad AS (SELECT DISTINCT l_orderkey FROM lines WHERE l_discount > 0.09)
SELECT idx, o_orderkey, 'Insert' AS operation, CASE WHEN l_orderkey IS NULL THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN l_orderkey IS NOT NULL THEN 'ValidationError' END AS reason FROM numbered LEFT JOIN bad ON l_orderkey = o_orderkey"""
)
def graph_insert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"orders": ordered(spark, sf_dir), "lineitem": one_line_each(spark, sf_dir)}
    result = graph.insert_graph(frames, {k: none_of(v) for k, v in frames.items()}, TWO, "orders", ONCE)
    return result.outcomes.select("idx", F.col("entity_id")["o_orderkey"].alias("o_orderkey"), "operation", "status", "reason")


def whole_tree(spark: SparkSession, sf_dir: str, root: str) -> dict[str, DataFrame]:
    frames = {n: read(spark, sf_dir, n) for n in TREE}
    return {**frames, root: indexed(frames[root])}


@query("SELECT 0 AS depth, 'customer' AS entity, count(*) AS rows FROM customer UNION ALL SELECT 1, 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 2, 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def graph_three_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(graph.hierarchy(graph.expand(whole_tree(spark, sf_dir, "customer"), MODEL, "customer", GraphOptions()), MODEL))


@query("SELECT 0 AS depth, 'region' AS entity, count(*) AS rows FROM region UNION ALL SELECT 1, 'nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 2, 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(graph.hierarchy(graph.expand(whole_tree(spark, sf_dir, "region"), MODEL, "region", GraphOptions(max_depth=2)), MODEL))


@query("SELECT 0 AS depth, 'customer' AS entity, count(*) AS rows FROM customer UNION ALL SELECT 1, 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey")
def graph_nav_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = GraphOptions(navigation_filter=NavigationFilter.excluding(("orders", "lines")))
    return graph.statistics(graph.hierarchy(graph.expand(whole_tree(spark, sf_dir, "customer"), MODEL, "customer", options), MODEL))


@query("SELECT n_nationkey AS root, NULL::VARCHAR AS parent, 'nation' AS entity, n_nationkey::VARCHAR AS id, 0 AS depth FROM nation UNION ALL SELECT n_nationkey, 'nation ' || n_nationkey, 'customer', c_custkey::VARCHAR, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {k: v for k, v in whole_tree(spark, sf_dir, "nation").items() if k in ("nation", "customer")}
    edges = graph.hierarchy(graph.expand(frames, MODEL, "nation", GraphOptions()), MODEL)
    return edges.withColumn("root", F.col("root").cast("int"))


def trimmed(spark: SparkSession, sf_dir: str, orphans: Orphans) -> tuple[dict, dict, GraphOptions]:
    """Even orders come with their lines up to number 3."""
    lines, orders = one_line_each(spark, sf_dir), ordered(spark, sf_dir)
    frames = {"orders": orders.where("o_orderkey % 2 = 0"), "lineitem": lines.where("l_linenumber <= 3")}
    return frames, {"orders": read(spark, sf_dir, "orders"), "lineitem": lines}, GraphOptions(cycles=Cycles.IGNORE_ALL, orphans=orphans)


@query(f"WITH {KEYED} SELECT idx AS root, l_orderkey, l_linenumber FROM lines JOIN numbered ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 0 AND l_linenumber > 3")
def graph_update_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, targets, options = trimmed(spark, sf_dir, Orphans.DETACH)
    found = graph.orphans(graph.expand(frames, LOOSE, "orders", options), targets, LOOSE, options)["lineitem"]
    return found.select(F.col("__root").alias("root"), "l_orderkey", "l_linenumber")


@query(f"WITH {KEYED} SELECT l_orderkey, l_linenumber FROM lines WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber > 3)")
def graph_update_orphan_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, targets, options = trimmed(spark, sf_dir, Orphans.DELETE)
    return graph.update_graph(frames, targets, LOOSE, "orders", options).state["lineitem"].select("l_orderkey", "l_linenumber")


CUSTOMER_TREE = Model.of(
    Entity("nation", ("n_nationkey",), navigations=(Navigation("customers", "customer", ("c_nationkey",), required=False),)),
    Entity("customer", ("c_custkey",), foreign_keys=(ForeignKey(("c_nationkey",), "nation", "set_null"),)),
)


@query("SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 0 AND 4 AND c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def graph_update_orphan_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    frames = {"nation": indexed(nations).where("n_nationkey between 0 and 4"), "customer": customers.where("c_custkey % 4 <> 0")}
    options = GraphOptions(orphans=Orphans.DETACH)
    result = graph.update_graph(frames, {"nation": nations, "customer": customers}, CUSTOMER_TREE, "nation", options)
    return result.state["customer"].select("c_custkey", "c_nationkey")


STORE = Model.of(
    Entity("customer", ("c_custkey",)),
    Entity("orders", ("o_orderkey",), foreign_keys=(ForeignKey(("o_custkey",), "customer", "cascade"),)),
    Entity("lineitem", ("l_orderkey", "l_linenumber"), foreign_keys=(ForeignKey(("l_orderkey",), "orders", "cascade"),)),
)
STRICT = Model(STORE.entities | {"orders": replace(STORE["orders"], foreign_keys=(ForeignKey(("o_custkey",), "customer", "restrict"),))})


def of_nation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    targets = {"customer": read(spark, sf_dir, "customer"), "orders": read(spark, sf_dir, "orders"), "lineitem": one_line_each(spark, sf_dir)}
    return indexed(targets["customer"].where("c_nationkey = 3")), targets


@query(
    f"""WITH {KEYED}, c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey), l AS (SELECT l_orderkey FROM lines JOIN o ON l_orderkey = o_orderkey)
SELECT 'customer' AS entity, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS rows UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lines) - (SELECT count(*) FROM l)"""
)
def graph_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, targets = of_nation(spark, sf_dir)
    state = graph.delete_graph(roots, targets, STORE, "customer").state
    counts = [state[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "rows") for n in ("customer", "orders", "lineitem")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) AS idx, c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'DatabaseConstraint' END AS reason FROM customer WHERE c_nationkey = 3")
def graph_delete_parent_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, targets = of_nation(spark, sf_dir)
    result = graph.delete_graph(roots, targets, STRICT, "customer", GraphOptions(cascade=Cascade.PARENT_ONLY))
    return result.outcomes.select("idx", F.col("entity_id")["c_custkey"].alias("c_custkey"), "status", "reason")


WITH_ORDERS = "c_custkey IN (SELECT o_custkey FROM orders)"


@query(f"SELECT 'with orders' AS roots, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3 AND {WITH_ORDERS}) AS raised UNION ALL SELECT 'without', EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3 AND NOT {WITH_ORDERS} AND {WITH_ORDERS})")
def graph_delete_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete that must not cascade aborts if a root has children, and only then."""
    roots, targets = of_nation(spark, sf_dir)
    options, found = GraphOptions(cascade=Cascade.THROW), []
    for name, how in (("with orders", "left_semi"), ("without", "left_anti")):
        some = roots.join(targets["orders"].select(F.col("o_custkey").alias("c_custkey")), "c_custkey", how)
        found.append((name, raises(lambda some=some: graph.delete_graph(some, targets, STORE, "customer", options))))
    return spark.createDataFrame(found, "roots string, raised boolean")


GONE = f"""{KEYED}, c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT idx, o_orderkey, o_custkey FROM orders JOIN c ON o_custkey = c_custkey)"""


@query(
    f"""WITH {GONE} SELECT idx AS root, NULL::VARCHAR AS parent, 'customer' AS entity, c_custkey::VARCHAR AS id, 0 AS depth FROM c UNION ALL SELECT idx, 'customer ' || o_custkey, 'orders', o_orderkey::VARCHAR, 1 FROM o
UNION ALL SELECT o.idx, 'orders ' || l_orderkey, 'lineitem', '(' || l_orderkey || ', ' || l_linenumber || ')', 2 FROM lines JOIN o ON l_orderkey = o_orderkey"""
)
def graph_delete_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, targets = of_nation(spark, sf_dir)
    return graph.delete_graph(roots, targets, STORE, "customer").hierarchy()


@query(f"WITH {GONE} SELECT 0 AS depth, 'customer' AS entity, count(*) AS rows FROM c UNION ALL SELECT 1, 'orders', count(*) FROM o UNION ALL SELECT 2, 'lineitem', count(*) FROM lines JOIN o ON l_orderkey = o_orderkey")
def graph_delete_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, targets = of_nation(spark, sf_dir)
    return graph.delete_graph(roots, targets, STORE, "customer").statistics()


DETACHED = Model(STORE.entities | {"orders": replace(STORE["orders"], foreign_keys=(ForeignKey(("o_custkey",), "customer", "set_null"),))})


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) c ON o_custkey = c_custkey")
def graph_delete_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots only: what refers to them acts as its foreign key is declared."""
    roots, targets = of_nation(spark, sf_dir)
    return graph.delete_graph(roots, targets, DETACHED, "customer", GraphOptions(max_depth=0)).state["orders"].select("o_orderkey", "o_custkey")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) AS idx, c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'DatabaseConstraint' END AS reason FROM customer WHERE c_nationkey = 3")
def graph_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A navigation that the filter leaves out isn't followed, so its rows hold their parents back."""
    roots, targets = of_nation(spark, sf_dir)
    model = Model(STRICT.entities | {"customer": replace(STRICT["customer"], navigations=(Navigation("orders", "orders", ("o_custkey",)),))})
    options = GraphOptions(navigation_filter=NavigationFilter.excluding(("customer", "orders")))
    return graph.delete_graph(roots, targets, model, "customer", options).outcomes.select("idx", F.col("entity_id")["c_custkey"].alias("c_custkey"), "reason")


@query(
    """WITH b AS (SELECT c_custkey, c_acctbal, n, row_number() OVER (ORDER BY c_custkey, n) - 1 AS idx FROM customer, (VALUES (0), (1), (2)) AS t(n) WHERE c_nationkey = 3)
SELECT idx, c_custkey, CASE WHEN n = 1 THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN n <> 1 THEN 'ConcurrencyConflict' END AS reason FROM b"""
)
def graph_delete_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root three times: first with a stale token, then as it is, then again."""
    _, targets = of_nation(spark, sf_dir)
    model = Model(STORE.entities | {"customer": replace(STORE["customer"], tokens=("c_acctbal",))})
    thrice = targets["customer"].where("c_nationkey = 3").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    roots = with_index(thrice.withColumn("c_acctbal", F.expr("if(n = 0, c_acctbal + 1, c_acctbal)")), "c_custkey", "n").drop("n")
    return graph.delete_graph(roots, targets, model, "customer").outcomes.select("idx", F.col("entity_id")["c_custkey"].alias("c_custkey"), "status", "reason")


def linked_suppliers(spark: SparkSession, sf_dir: str):
    suppliers = read(spark, sf_dir, "supplier")
    targets = {"supplier": suppliers, "part": read(spark, sf_dir, "part"), "partsupp": stored_pairs(spark, sf_dir, "true")}
    return graph.delete_graph(indexed(suppliers.where("s_nationkey < 12")), targets, MODEL, "supplier", GraphOptions(include_links=True))


@query("SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def graph_delete_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_suppliers(spark, sf_dir).state["partsupp"].select("ps_suppkey", "ps_partkey")


@query("SELECT 'supplier.parts' AS navigation, 0::BIGINT AS created, count(*) AS removed FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12))")
def graph_delete_link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_suppliers(spark, sf_dir).extra["links"]


# Generated ids, unique values and upserts

MADE = Model(TWO.entities | {"orders": replace(TWO["orders"], generated_key=True)})
UNSET = "o_orderkey % 6 = 0"


@query(
    f"""WITH {KEYED}, b AS (SELECT * FROM numbered WHERE o_orderkey % 3 = 0), bad AS (SELECT DISTINCT l_orderkey FROM lines WHERE l_discount > 0.09), good AS (SELECT * FROM b WHERE o_orderkey NOT IN (SELECT l_orderkey FROM bad)),
top AS (SELECT max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 OR NOT ({UNSET}) AND o_orderkey NOT IN (SELECT l_orderkey FROM bad)),
ids AS (SELECT idx, (SELECT k FROM top) + row_number() OVER (ORDER BY idx) AS k FROM good WHERE {UNSET}),
held AS (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY 1)
SELECT b.idx, CASE WHEN i.k IS NOT NULL THEN i.k WHEN b.{UNSET} THEN 0 ELSE b.o_orderkey END AS o_orderkey, CASE WHEN g.idx IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN g.idx IS NULL THEN 'ValidationError' END AS reason,
CASE WHEN g.idx IS NULL THEN 0 ELSE coalesce(n, 0) END AS lines FROM b LEFT JOIN good g ON g.idx = b.idx LEFT JOIN ids i ON i.idx = b.idx LEFT JOIN held ON l_orderkey = b.o_orderkey"""
)
def graph_insert_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the roots have no key yet; their lines name them by their place, and get their ids."""
    orders, lines = ordered(spark, sf_dir), one_line_each(spark, sf_dir)
    roots = orders.where("o_orderkey % 3 = 0")
    own = lines.join(roots.select(F.col("o_orderkey").alias("l_orderkey"), IDX), "l_orderkey")
    own = own.withColumn(graph.OWNER, F.expr(f"if({UNSET.replace('o_', 'l_')}, __idx, null)")).withColumn("l_orderkey", F.expr(f"if({UNSET.replace('o_', 'l_')}, 0L, l_orderkey)")).drop(IDX)
    frames = {"orders": roots.withColumn("o_orderkey", F.expr(f"if({UNSET}, 0L, o_orderkey)")), "lineitem": own}
    targets = {"orders": read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), "lineitem": lines.where(F.lit(False))}
    result = graph.insert_graph(frames, targets, MADE, "orders")
    held = result.state["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    shown = result.outcomes.select("idx", F.col("entity_id")["o_orderkey"].alias("o_orderkey"), "status", "reason")
    return shown.join(held, "o_orderkey", "left").select("idx", "o_orderkey", "status", "reason", F.coalesce(F.expr("if(status = 'Success', lines, 0)"), F.lit(0)).cast("long").alias("lines"))


NAMED = Model.of(
    Entity("customer", ("c_custkey",), uniques=(("c_name",),), checks=(Check("c_acctbal >= 0", "balance"),), navigations=(Navigation("orders", "orders", ("o_custkey",)),)),
    Entity("orders", ("o_orderkey",), foreign_keys=(ForeignKey(("o_custkey",), "customer", "cascade"),)),
)
PEOPLE = f"people AS (SELECT *, row_number() OVER (ORDER BY {CUSTOMERS}) - 1 AS idx FROM customer)"


@query(
    f"""WITH {PEOPLE}, b AS (SELECT *, 'n' || (c_custkey // 4) AS name, (c_custkey // 4) % 2 = 1 AND EXISTS (SELECT 1 FROM customer s WHERE s.c_custkey = p.c_custkey // 4) AS taken FROM people p WHERE c_custkey % 2 = 0),
won AS (SELECT min(idx) AS idx FROM b WHERE c_acctbal >= 0 AND NOT taken GROUP BY name)
SELECT b.idx, c_custkey, CASE WHEN w.idx IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN c_acctbal < 0 THEN 'ValidationError' WHEN w.idx IS NULL THEN 'DuplicateKey' END AS reason FROM b LEFT JOIN won w ON w.idx = b.idx"""
)
def graph_insert_duplicate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots want each name, and some the name of a stored row; the first root that can have it gets it."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    roots = indexed(customers).where("c_custkey % 2 = 0").withColumn("c_name", F.expr("concat('n', c_custkey div 4)"))
    targets = {"customer": customers.where("c_custkey % 2 = 1").withColumn("c_name", F.expr("concat('n', c_custkey)")), "orders": orders.where(F.lit(False))}
    result = graph.insert_graph({"customer": roots, "orders": orders}, targets, NAMED, "customer")
    return result.outcomes.select("idx", F.col("entity_id")["c_custkey"].alias("c_custkey"), "status", "reason")


UPSERTED = f"""{PEOPLE}, b AS (SELECT *, c_custkey % 5 = 0 AS fresh, CASE WHEN c_custkey % 5 = 0 THEN 'new' || (c_custkey // 10) WHEN c_custkey % 7 = 1 THEN 'Customer#000000002' ELSE c_name || '+' END AS name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = 0) AS has_unset FROM people),
won AS (SELECT min(idx) AS idx FROM b WHERE c_acctbal >= 0 AND (fresh OR c_custkey % 7 <> 1 AND NOT has_unset) GROUP BY name),
ids AS (SELECT b.idx, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY b.idx) AS k FROM b JOIN won w ON w.idx = b.idx WHERE fresh),
judged AS (SELECT b.idx, CASE WHEN i.k IS NOT NULL THEN i.k WHEN fresh THEN 0 ELSE c_custkey END AS c_custkey, fresh, CASE WHEN c_acctbal < 0 THEN 'ValidationError' WHEN w.idx IS NULL THEN 'DuplicateKey' END AS reason
  FROM b LEFT JOIN won w ON w.idx = b.idx LEFT JOIN ids i ON i.idx = b.idx)"""


def upserted_customers(spark: SparkSession, sf_dir: str, strategy: DuplicateKey) -> DataFrame:
    """A fifth of the roots have no key; two of them want each new name, and some updates the name of another row. The
    order 0 has no key either, but isn't given one; it is an insert that meets a stored row."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    name = "case when c_custkey % 5 = 0 then concat('new', c_custkey div 10) when c_custkey % 7 = 1 then 'Customer#000000002' else concat(c_name, '+') end"
    roots = indexed(customers).withColumns({"c_name": F.expr(name), "c_custkey": F.expr("if(c_custkey % 5 = 0, 0L, c_custkey)")})
    model = Model(NAMED.entities | {"customer": replace(NAMED["customer"], generated_key=True)})
    options = GraphOptions(duplicate_key=strategy, orphans=Orphans.DETACH)
    result = graph.upsert_graph({"customer": roots, "orders": orders}, {"customer": customers, "orders": orders}, model, "customer", options)
    return result.outcomes.select("idx", F.col("entity_id")["c_custkey"].alias("c_custkey"), "operation", "status", "reason", "retried", "is_default_key")


@query(f"WITH {UPSERTED} SELECT idx, c_custkey, CASE WHEN fresh THEN 'Insert' ELSE 'Update' END AS operation, CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS status, reason, false AS retried, fresh AS is_default_key FROM judged")
def graph_upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_customers(spark, sf_dir, DuplicateKey.FAIL)


SKIPS = "fresh AND reason = 'DuplicateKey'"


@query(f"WITH {UPSERTED} SELECT idx, c_custkey, CASE WHEN fresh THEN 'Insert' ELSE 'Update' END AS operation, CASE WHEN reason IS NULL THEN 'Success' WHEN {SKIPS} THEN 'Skipped' ELSE 'Failed' END AS status, CASE WHEN {SKIPS} THEN NULL ELSE reason END AS reason, false AS retried, fresh AS is_default_key FROM judged")
def graph_upsert_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_customers(spark, sf_dir, DuplicateKey.SKIP)


@query(f"WITH {UPSERTED} SELECT idx, c_custkey, CASE WHEN fresh THEN 'Insert' ELSE 'Update' END AS operation, CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN {SKIPS} THEN 'ConcurrencyConflict' ELSE reason END AS reason, coalesce({SKIPS}, false) AS retried, fresh AS is_default_key FROM judged")
def graph_upsert_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_customers(spark, sf_dir, DuplicateKey.RETRY_AS_UPDATE)


@query(
    f"""WITH {KEYED}, o AS (SELECT idx, o_orderkey, o_orderkey % 10 = 0 AS fresh FROM numbered WHERE o_orderkey % 5 = 0), ids AS (SELECT idx, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY idx) AS k FROM o WHERE fresh)
SELECT o.idx AS root, 'orders' AS entity, coalesce(k, o_orderkey)::VARCHAR AS id, CASE WHEN fresh THEN 'Insert' ELSE 'Update' END AS route FROM o LEFT JOIN ids ON ids.idx = o.idx
UNION ALL SELECT idx, 'lineitem', '(' || l_orderkey || ', ' || l_linenumber || ')', 'Update' FROM o JOIN lines ON l_orderkey = o_orderkey WHERE NOT fresh"""
)
def graph_upsert_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph upsert does with each row; roots without a key get one."""
    lines, orders = one_line_each(spark, sf_dir), read(spark, sf_dir, "orders")
    roots = ordered(spark, sf_dir).where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.expr("if(o_orderkey % 10 = 0, 0L, o_orderkey)"))
    model = Model(LOOSE.entities | {"orders": replace(LOOSE["orders"], generated_key=True)})
    frames = {"orders": roots, "lineitem": lines.where("l_orderkey % 10 <> 0")}
    return graph.upsert_graph(frames, {"orders": orders, "lineitem": lines}, model, "orders", ONCE).extra["routes"]


@query(
    """SELECT * FROM (SELECT 'orphans' AS guard, EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber > 3) AS raised UNION ALL SELECT 'no orphans', false UNION ALL SELECT 'unknown navigation', true UNION ALL SELECT 'reference without its flag', true UNION ALL SELECT 'empty filter', true
UNION ALL SELECT 'a row met twice', EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'refers to a row without a key', EXISTS (SELECT 1 FROM orders WHERE o_custkey = 0)) g"""
)
def guards_of_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls abort as a whole."""
    lines, orders = one_line_each(spark, sf_dir), read(spark, sf_dir, "orders")
    targets, roots = {"orders": orders, "lineitem": lines}, ordered(spark, sf_dir)
    every = read(spark, sf_dir, "lineitem")
    found = {
        "orphans": raises(lambda: graph.update_graph({"orders": roots, "lineitem": lines.where("l_linenumber <= 3")}, targets, LOOSE, "orders", ONCE)),
        "no orphans": raises(lambda: graph.update_graph({"orders": roots, "lineitem": lines}, targets, LOOSE, "orders", ONCE)),
        "unknown navigation": raises(lambda: graph.expand({"orders": roots}, LOOSE, "orders", GraphOptions(navigation_filter=NavigationFilter.including(("orders", "nothing"))))),
        "reference without its flag": raises(lambda: graph.expand({"orders": roots}, MODEL, "orders", GraphOptions(navigation_filter=NavigationFilter.including(("orders", "customer"))))),
        "empty filter": raises(NavigationFilter.including),
        "a row met twice": raises(lambda: graph.insert_graph({"orders": roots, "lineitem": every}, {"orders": none_of(roots), "lineitem": every.where(F.lit(False))}, LOOSE, "orders")),
        "refers to a row without a key": raises(lambda: graph.delete_graph(roots, targets, STORE, "orders")),
    }
    return spark.createDataFrame(sorted(found.items()), "guard string, raised boolean")


# Self-references and composite keys


@query("SELECT turn::INT AS depth, 'step' AS entity, count(*) AS rows FROM conversations WHERE turn <= 3 GROUP BY turn")
def graph_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns answer each other; the first ones are the roots, three more steps are followed."""
    model = Model.of(Entity("step", ("node",), navigations=(Navigation("answers", "step", ("parent",)),)))
    rows = steps(spark, sf_dir).withColumn(IDX, F.when(F.col("parent").isNull(), F.col("node")))
    return graph.statistics(graph.hierarchy(graph.expand({"step": rows}, model, "step", GraphOptions(max_depth=3)), model))


@query(
    f"""WITH {KEYED}, roots AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lines)
SELECT idx AS root, NULL::VARCHAR AS parent, 'lineitem' AS entity, '(' || l_orderkey || ', ' || l_linenumber || ')' AS id, 0 AS depth FROM roots
UNION ALL SELECT idx, '(' || l_orderkey || ', ' || l_linenumber || ')', 'shipment', (l_orderkey * 10 + l_linenumber)::VARCHAR, 1 FROM roots WHERE l_partkey % 2 = 0"""
)
def graph_composite_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with a key of two columns, and children that refer to both."""
    model = Model.of(Entity("lineitem", LINE_KEY, navigations=(Navigation("shipments", "shipment", ("s_orderkey", "s_linenumber")),)), Entity("shipment", ("s_id",)))
    lines = one_line_each(spark, sf_dir)
    parts = lines.where("l_partkey % 2 = 0").selectExpr("l_orderkey * 10 + l_linenumber AS s_id", "l_orderkey AS s_orderkey", "l_linenumber AS s_linenumber")
    frames = {"lineitem": with_index(lines, *LINE_KEY), "shipment": parts}
    return graph.hierarchy(graph.expand(frames, model, "lineitem", GraphOptions()), model).withColumn("parent", F.expr("substring_index(parent, 'lineitem ', -1)"))


# Chains

STEPS = "SELECT conv_id * 1000 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))


@query("SELECT conv_id * 1000 + turn AS node, conv_id * 1000 AS root, turn::INT AS depth FROM conversations")
def self_ref_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain(steps(spark, sf_dir))


@query("SELECT conv_id * 1000 AS root, max(turn) AS descendants FROM conversations GROUP BY conv_id HAVING max(turn) > 0")
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain(steps(spark, sf_dir)).where("depth > 0").groupBy("root").agg(F.count(F.lit(1)).alias("descendants"))


@query("SELECT conv_id * 1000 + turn AS node FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 7)")
def graph_cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a conversation has a turn 7, its first turn follows that one."""
    edges = steps(spark, sf_dir)
    back = edges.where("node % 1000 = 7").select((F.col("node") - 7).alias("node"), F.col("node").alias("parent"))
    return graph.cycle_nodes(edges.where("parent is not null").unionByName(back))


# References and shared children


@query(f"WITH {KEYED} SELECT idx AS root, l_partkey::VARCHAR AS id FROM (SELECT DISTINCT idx, l_partkey FROM lines JOIN numbered ON l_orderkey = o_orderkey) x")
def graph_references_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = GraphOptions(include_references=True, cycles=Cycles.IGNORE_ALL, navigation_filter=NavigationFilter.including(("orders", "lines"), ("lineitem", "part")))
    frames = {"orders": ordered(spark, sf_dir), "lineitem": one_line_each(spark, sf_dir), "part": read(spark, sf_dir, "part")}
    nodes = graph.once_each(graph.expand(frames, MODEL, "orders", options), MODEL, options)
    return graph.hierarchy({"part": nodes["part"]}, MODEL).select("root", "id")


@query(
    """WITH c AS (SELECT DISTINCT o_orderkey // 2 AS child, o_orderkey AS root FROM orders), w AS (SELECT child, min(root) AS root FROM c GROUP BY child)
SELECT c.root, w.root IS NOT NULL AS first FROM c LEFT JOIN w ON w.root = c.root AND w.child = c.child"""
)
def graph_shared_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders each ask for the same child: the first one gets it."""
    claims = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root"), F.expr("cast(o_orderkey div 2 as string)").alias("key"))
    won = graph.first_roots(claims).withColumn("first", F.lit(True))
    return claims.select("root").join(won, "root", "left").select("root", F.coalesce("first", F.lit(False)).alias("first"))


@query("SELECT o_orderkey AS root, o_orderkey % 2 = 0 AS first FROM orders")
def graph_shared_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for two children, one of them with the next order: every second one goes ahead."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root"))
    claims = keys.select("root", F.explode(F.array(F.col("root").cast("string"), (F.col("root") + 1).cast("string"))).alias("key"))
    won = graph.first_roots(claims).withColumn("first", F.lit(True))
    return keys.join(won, "root", "left").select("root", F.coalesce("first", F.lit(False)).alias("first"))


# Many to many

PAIR = (("ps_suppkey",), ("ps_partkey",))


def pairs(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where(where)
    return lines.select(F.col("l_suppkey").alias("__root"), F.col("l_suppkey").alias("ps_suppkey"), F.col("l_partkey").alias("ps_partkey"))


def stored_pairs(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return pairs(spark, sf_dir, where).select("ps_suppkey", "ps_partkey").distinct()


NEW = "l_orderkey % 4 <> 0"
OLD = "l_orderkey % 4 <> 1"
OLD_PAIRS = f"SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey FROM lineitem WHERE {OLD}"
NEW_PAIRS = f"SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey FROM lineitem WHERE {NEW}"
DIFF = f"""old AS ({OLD_PAIRS}), new AS ({NEW_PAIRS}), own AS (SELECT * FROM old WHERE ps_suppkey IN (SELECT ps_suppkey FROM new)),
diff AS (SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM own) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM own EXCEPT SELECT * FROM new))"""


@query(f"SELECT * FROM ({NEW_PAIRS}) EXCEPT SELECT * FROM ({OLD_PAIRS})")
def m2m_links_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.created(pairs(spark, sf_dir, NEW), stored_pairs(spark, sf_dir, OLD), *PAIR).select("ps_suppkey", "ps_partkey")


@query("SELECT l_suppkey AS root, count(DISTINCT l_partkey) AS missing FROM lineitem WHERE l_partkey % 9 = 0 GROUP BY 1")
def m2m_missing_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.missing_related(pairs(spark, sf_dir, "true"), read(spark, sf_dir, "part").where("p_partkey % 9 <> 0"), PAIR[1], ("p_partkey",))
    return found.select("root", F.size("ids").cast("long").alias("missing"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 9 = 0 OR p_partkey = 0")
def m2m_insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return links.insert_if_new(parts.where("p_partkey % 9 <> 0"), parts, ("p_partkey",))[0].select("p_partkey", "p_name")


@query(f"WITH {DIFF} SELECT * FROM diff")
def m2m_link_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.changes(stored_pairs(spark, sf_dir, OLD), pairs(spark, sf_dir, NEW), *PAIR)


@query(f"WITH {DIFF} SELECT 'supplier.parts' AS navigation, count(*) FILTER (change = 'added') AS created, count(*) FILTER (change = 'removed') AS removed FROM diff")
def m2m_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.counts(links.changes(stored_pairs(spark, sf_dir, OLD), pairs(spark, sf_dir, NEW), *PAIR), "supplier.parts")


@query("SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def m2m_delete_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.without(stored_pairs(spark, sf_dir, "true"), read(spark, sf_dir, "supplier").where("s_nationkey < 12"), ("ps_suppkey",), ("s_suppkey",))


@query("SELECT l_suppkey AS root, count(DISTINCT l_partkey) AS links FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 500")
def m2m_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.over_cap(stored_pairs(spark, sf_dir, "true").withColumnRenamed("ps_suppkey", "__root"), 500)


@query(
    f"""WITH old AS (SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey, 0.0::DOUBLE AS ps_qty FROM lineitem WHERE {OLD}), new AS (SELECT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey, min(l_quantity) AS ps_qty FROM lineitem WHERE {NEW} GROUP BY 1, 2)
SELECT * FROM old WHERE (ps_suppkey, ps_partkey) IN (SELECT (ps_suppkey, ps_partkey) FROM new) OR ps_suppkey NOT IN (SELECT ps_suppkey FROM new) UNION ALL SELECT * FROM new WHERE (ps_suppkey, ps_partkey) NOT IN (SELECT (ps_suppkey, ps_partkey) FROM old)"""
)
def m2m_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a column of their own: kept ones keep it, added ones bring it."""
    lines = read(spark, sf_dir, "lineitem").where(NEW)
    wanted = lines.select(F.col("l_suppkey").alias("__root"), F.col("l_suppkey").alias("ps_suppkey"), F.col("l_partkey").alias("ps_partkey"), F.col("l_quantity").alias("ps_qty"))
    stored = stored_pairs(spark, sf_dir, OLD).withColumn("ps_qty", F.lit(0.0))
    return links.apply_changes(stored, links.changes(stored, wanted, *PAIR), *PAIR, wanted)
