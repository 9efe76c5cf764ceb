"""Queries of the flat operators."""

from __future__ import annotations

from dataclasses import replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.cancellation import not_attempted
from batchwright.errors import BatchError
from batchwright.functions.failures import classify, is_transient
from batchwright.model import Entity, Model
from batchwright.operators import flat, partition
from batchwright.options import Detail, DuplicateKey, GraphOptions, Options, Retry, Strategy, UpsertOptions
from batchwright.plans.constraints import first_of
from batchwright.plans.index import IDX
from batchwright.queries.tables import MODEL, indexed, none_of, read
from batchwright.queries.tables import flat as shown
from batchwright.result import Result
from batchwright.session import new_path
from batchwright.sources.opaque import validated
from batchwright.sources.store import Store, with_retry
from batchwright.writer import BatchWriter

QUERIES, SQL = {}, {}

LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
CUSTOMERS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
LINE_KEY = ("l_orderkey", "l_linenumber")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def numbered(columns: str, table: str, where: str = "true", name: str = "batch") -> str:
    """SQL of a table's rows with their dense index."""
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY {columns}) - 1 AS idx FROM {table} WHERE {where})"


ISOLATED = f"""{numbered(LINES, 'lineitem')},
taken AS (SELECT min(idx) AS idx FROM batch WHERE l_discount <= 0.09 GROUP BY l_orderkey, l_linenumber),
outcome AS (SELECT b.idx, l_orderkey, l_linenumber, 'Insert' AS operation,
  CASE WHEN t.idx IS NOT NULL THEN 'Success' ELSE 'Failed' END AS status,
  CASE WHEN l_discount > 0.09 THEN 'ValidationError' WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason
  FROM batch b LEFT JOIN taken t ON t.idx = b.idx)"""


def isolated(spark: SparkSession, sf_dir: str, options: Options | None = None) -> Result:
    lines = indexed(read(spark, sf_dir, "lineitem"))
    return flat.insert(lines, none_of(lines), MODEL, "lineitem", options=options)


@query(f"WITH {ISOLATED} SELECT * FROM outcome")
def insert_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(isolated(spark, sf_dir).outcomes, *LINE_KEY)


@query(
    f"""WITH {numbered(LINES, 'lineitem', 'l_orderkey % 2 = 0')},
stored AS (SELECT DISTINCT l_orderkey, l_linenumber, true AS held FROM lineitem WHERE l_orderkey % 3 <> 0),
flagged AS (SELECT b.*, held IS NOT NULL AS dup FROM batch b LEFT JOIN stored USING (l_orderkey, l_linenumber)),
taken AS (SELECT min(idx) AS idx FROM flagged WHERE l_discount <= 0.09 AND NOT dup GROUP BY l_orderkey, l_linenumber)
SELECT f.idx, l_orderkey, l_linenumber, 'Insert' AS operation, CASE WHEN t.idx IS NOT NULL THEN 'Success' ELSE 'Failed' END AS status,
CASE WHEN l_discount > 0.09 THEN 'ValidationError' WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason FROM flagged f LEFT JOIN taken t ON t.idx = f.idx"""
)
def insert_into_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return shown(flat.insert(indexed(lines.where("l_orderkey % 2 = 0")), lines.where("l_orderkey % 3 <> 0"), MODEL, "lineitem").outcomes, *LINE_KEY)


FK_CHECK = f"""{numbered(LINES, 'lineitem')},
flagged AS (SELECT b.*, o_orderkey IS NULL AS dangling FROM batch b LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) o ON o_orderkey = l_orderkey),
taken AS (SELECT min(idx) AS idx FROM flagged WHERE l_discount <= 0.09 AND NOT dangling GROUP BY l_orderkey, l_linenumber),
outcome AS (SELECT f.idx, l_orderkey, l_linenumber, 'Insert' AS operation, CASE WHEN t.idx IS NOT NULL THEN 'Success' ELSE 'Failed' END AS status,
CASE WHEN l_discount > 0.09 THEN 'ValidationError' WHEN dangling THEN 'DatabaseConstraint' WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason FROM flagged f LEFT JOIN taken t ON t.idx = f.idx)"""


def fk_checked(spark: SparkSession, sf_dir: str, options: Options | None = None) -> Result:
    lines = indexed(read(spark, sf_dir, "lineitem"))
    return flat.insert(lines, none_of(lines), MODEL, "lineitem", {"orders": read(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")}, options)


@query(f"WITH {FK_CHECK} SELECT * FROM outcome")
def insert_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fk_checked(spark, sf_dir).outcomes, *LINE_KEY)


@query(f"WITH {FK_CHECK} SELECT reason, count(*) AS failures FROM outcome WHERE status = 'Failed' GROUP BY reason")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fk_checked(spark, sf_dir).reasons()


@query(f"WITH {FK_CHECK} SELECT idx, l_orderkey, l_linenumber, operation, reason FROM outcome WHERE status = 'Failed'")
def detail_minimal_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fk_checked(spark, sf_dir, Options(detail=Detail.MINIMAL)).failures()
    return found.select("idx", *(F.col("entity_id")[k].alias(k) for k in LINE_KEY), "operation", "reason")


@query(
    f"""WITH {numbered(CUSTOMERS, 'customer', 'c_custkey % 10 <> 0')},
good AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM batch WHERE c_acctbal >= 0)
SELECT b.idx, coalesce((SELECT max(c_custkey) FROM customer WHERE c_custkey % 10 = 0) + r, 0)::BIGINT AS c_custkey, 'Insert' AS operation,
CASE WHEN r IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN r IS NULL THEN 'ValidationError' END AS reason FROM batch b LEFT JOIN good g ON g.idx = b.idx"""
)
def insert_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    batch = indexed(customers.where("c_custkey % 10 <> 0")).withColumn("c_custkey", F.lit(0).cast("long"))
    return shown(flat.insert(batch, customers.where("c_custkey % 10 = 0"), MODEL, "customer").outcomes, "c_custkey")


@query(
    f"""WITH {numbered(CUSTOMERS, 'customer', 'c_custkey % 2 = 1')}, good AS (SELECT idx, c_custkey, c_custkey % 10 = 1 AS unset FROM batch WHERE c_acctbal >= 0),
top AS (SELECT max(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 10 <> 1 AND c_acctbal >= 0), ids AS (SELECT idx, (SELECT k FROM top) + row_number() OVER (ORDER BY idx) AS k FROM good WHERE unset)
SELECT b.idx, CASE WHEN k IS NOT NULL THEN k WHEN b.c_custkey % 10 = 1 THEN 0 ELSE b.c_custkey END AS c_custkey, 'Insert' AS operation, CASE WHEN c_acctbal < 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN c_acctbal < 0 THEN 'ValidationError' END AS reason FROM batch b LEFT JOIN ids i ON i.idx = b.idx"""
)
def insert_given_and_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with keys of their own beside rows without: the next ids come after all of them."""
    customers = read(spark, sf_dir, "customer")
    batch = indexed(customers.where("c_custkey % 2 = 1")).withColumn("c_custkey", F.expr("if(c_custkey % 10 = 1, 0L, c_custkey)"))
    return shown(flat.insert(batch, customers.where("c_custkey % 2 = 0"), MODEL, "customer").outcomes, "c_custkey")


@query(f"""WITH {ISOLATED}, c AS (SELECT count(*) FILTER (status = 'Success') AS s, count(*) FILTER (status = 'Failed') AS f FROM outcome)
SELECT s AS success_count, f AS failure_count, 0::BIGINT AS skipped_count, s AS inserted_count, 0::BIGINT AS updated_count, 0::BIGINT AS not_attempted_count, s + f AS total_processed,
CASE WHEN s + f > 0 THEN s / (s + f) ELSE 0.0 END AS success_rate, f = 0 AND s > 0 AS is_complete_success, s = 0 AND f > 0 AS is_complete_failure, s > 0 AND f > 0 AS is_partial_success, false AS was_cancelled FROM c""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(spark, sf_dir).metrics()


@query(f"WITH {ISOLATED} SELECT count(*) AS attempts FROM outcome")
def attempts_obo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(spark, sf_dir).attempts()


@query(
    f"""WITH RECURSIVE {ISOLATED},
sums AS (SELECT idx, sum(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS bad FROM outcome),
seg AS (SELECT 0::BIGINT AS lo, (SELECT count(*) FROM outcome)::BIGINT AS n UNION ALL
  SELECT CASE WHEN side = 0 THEN lo ELSE lo + n // 2 END, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END FROM seg, (VALUES (0), (1)) AS v(side) WHERE n > 1)
SELECT (1 + 2 * count(*))::BIGINT AS attempts FROM seg JOIN sums z ON z.idx = lo + n - 1 LEFT JOIN sums a ON a.idx = lo - 1 WHERE n > 1 AND z.bad > coalesce(a.bad, 0)"""
)
def attempts_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(spark, sf_dir, Options(strategy=Strategy.DIVIDE_AND_CONQUER)).attempts()


CHUNKS = f"""{ISOLATED}, size AS (SELECT greatest(ceil(count(*) / 7), 1)::BIGINT AS k FROM outcome),
chunks AS (SELECT idx // k AS chunk, (idx // k) * k AS "offset", count(*) AS rows, count(*) FILTER (status = 'Success') AS success_count, count(*) FILTER (status = 'Failed') AS failure_count FROM outcome, size GROUP BY 1, 2)"""


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def partition_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.chunk_measures(isolated(spark, sf_dir).outcomes, 7)


@query(f"WITH {ISOLATED} SELECT idx, l_orderkey, l_linenumber, operation, status, reason FROM outcome")
def merge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts with indices of their own, put together."""
    whole = isolated(spark, sf_dir)
    chunks = partition.with_chunk(whole.outcomes, 2, "idx")
    second = chunks.where("chunk = 1").agg(F.min("offset")).first()[0] or 0
    parts = [replace(whole, outcomes=chunks.where(F.col("chunk") == i).withColumn("idx", F.col("idx") - F.col("offset")).drop("chunk", "offset")) for i in range(2)]
    return shown(partition.merge([(parts[0], 0), (parts[1], second)]).outcomes, *LINE_KEY)


@query("SELECT 3 + 4 AS retries, 2.5 AS duration, CAST(NULL AS BIGINT) AS round_trips")
def merge_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't known of any part isn't known of the whole; else known numbers are added."""
    one = isolated(spark, sf_dir)
    whole = partition.merge([(replace(one, retries=3, duration=2.5), 0), (replace(one, retries=4), 0)]).summary()
    return whole.select(F.col("total_retries").cast("int").alias("retries"), F.col("duration_seconds").cast("decimal(2,1)").alias("duration"), "round_trips")


@query()
def unique_multi_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = Entity("line", ("l_orderkey",), uniques=(("l_partkey",), ("l_suppkey", "l_linenumber")))
    return first_of(indexed(read(spark, sf_dir, "lineitem")), entity).withColumnRenamed(IDX, "idx")


@query(f"WITH {numbered(ORDERS, 'orders')} SELECT idx FROM batch WHERE idx % 2 = 0")
def unique_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row wants a value of the one before it and one of the next: the longest chain of rivals there is."""
    chained = indexed(read(spark, sf_dir, "orders")).select(IDX, F.expr("-1 - __idx").alias("k"), F.expr("(__idx + 1) div 2").alias("a"), F.expr("__idx div 2").alias("b"))
    return first_of(chained, Entity("link", ("k",), uniques=(("a",), ("b",)))).withColumnRenamed(IDX, "idx")


@query(
    f"""WITH {numbered(LINES, 'lineitem')}, taken AS (SELECT min(idx) AS idx FROM batch WHERE l_discount <= 0.09 AND l_linenumber <> 3 GROUP BY l_orderkey, l_linenumber)
SELECT b.idx, CASE WHEN t.idx IS NOT NULL THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN l_linenumber = 3 OR l_discount > 0.09 THEN 'ValidationError' WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason,
CASE WHEN l_linenumber = 3 THEN 'the key column l_linenumber of lineitem is null' WHEN l_discount > 0.09 THEN 'the discount is over 0.09' WHEN t.idx IS NULL THEN 'an earlier row of the batch has this key' END AS message FROM batch b LEFT JOIN taken t ON t.idx = b.idx"""
)
def insert_null_key_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = indexed(read(spark, sf_dir, "lineitem")).withColumn("l_linenumber", F.expr("nullif(l_linenumber, 3)"))
    return flat.insert(lines, none_of(lines), MODEL, "lineitem").outcomes.select("idx", "status", "reason", "message")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'ValidationError' END AS reason, CASE WHEN p_size % 7 = 0 THEN 'a size of sevens' END AS message FROM part")
def insert_opaque_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator that raises for a whole set of rows if one of them is bad."""

    def validate(rows):
        if (rows["p_size"] % 7 == 0).any():
            raise ValueError("a size of sevens")

    return validated(read(spark, sf_dir, "part"), validate).select("p_partkey", "reason", "message")


@query("SELECT count(*) AS not_attempted_count, 0::BIGINT AS success_count, 0::BIGINT AS failure_count, true AS was_cancelled, false AS is_complete_success FROM lineitem")
def cancelled_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_attempted(isolated(spark, sf_dir)).metrics().select("not_attempted_count", "success_count", "failure_count", "was_cancelled", "is_complete_success")


@query("SELECT 0::BIGINT AS success_count, 0::BIGINT AS failure_count, 0::BIGINT AS total_processed, 0.0::DOUBLE AS success_rate, false AS is_complete_success, false AS is_complete_failure")
def empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = indexed(read(spark, sf_dir, "lineitem").where(F.lit(False)))
    return flat.insert(lines, none_of(lines), MODEL, "lineitem").metrics().select("success_count", "failure_count", "total_processed", "success_rate", "is_complete_success", "is_complete_failure")


@query(f"WITH {ISOLATED} SELECT * FROM outcome WHERE idx IN (0, 7, 1000)")
def outcome_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the batch looked up by their place."""
    result = isolated(spark, sf_dir)
    return shown(result.at(0).unionByName(result.at(7)).unionByName(result.at(1000)), *LINE_KEY)


@query(f"WITH {ISOLATED} SELECT idx, l_orderkey, l_linenumber, operation, reason, CASE reason WHEN 'ValidationError' THEN 'the discount is over 0.09' ELSE 'an earlier row of the batch has this key' END AS message FROM outcome WHERE status = 'Failed'")
def detail_full_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(spark, sf_dir).failures().select("idx", *(F.col("entity_id")[k].alias(k) for k in LINE_KEY), "operation", "reason", "message")


# Update and delete


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    batch = indexed(orders.where("o_orderkey % 2 = 0")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return flat.update(batch, orders, MODEL, "orders").state["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    f"""WITH {numbered(ORDERS, 'orders', 'o_orderkey % 3 = 0')}
SELECT idx, b.o_orderkey + 10 AS o_orderkey, 'Update' AS operation, CASE WHEN o.o_orderkey IS NULL THEN 'Failed' ELSE 'Success' END AS status,
CASE WHEN o.o_orderkey IS NULL THEN 'ConcurrencyConflict' END AS reason FROM batch b LEFT JOIN (SELECT o_orderkey FROM orders) o ON o.o_orderkey = b.o_orderkey + 10"""
)
def update_missing_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    batch = indexed(orders.where("o_orderkey % 3 = 0")).withColumn("o_orderkey", F.col("o_orderkey") + 10)
    return shown(flat.update(batch, orders, MODEL, "orders").outcomes, "o_orderkey")


@query(
    f"""WITH {numbered(ORDERS, 'orders', 'o_orderkey % 2 = 1')}
SELECT idx, o_orderkey, 'Update' AS operation, CASE WHEN o_orderkey % 4 = 1 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN o_orderkey % 4 = 1 THEN 'ConcurrencyConflict' END AS reason FROM batch"""
)
def update_stale_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    model = Model(MODEL.entities | {"orders": replace(MODEL["orders"], tokens=("o_orderdate",))})
    batch = indexed(orders.where("o_orderkey % 2 = 1")).withColumn("o_orderdate", F.expr("o_orderdate + make_dt_interval(if(o_orderkey % 4 = 1, 1, 0))"))
    return shown(flat.update(batch, orders, model, "orders").outcomes, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return flat.delete(indexed(orders.where("o_orderkey % 3 = 0")), orders, MODEL, "orders").state["orders"].select("o_orderkey", "o_totalprice")


@query(
    f"""WITH {numbered(LINES, 'lineitem', 'l_orderkey % 4 = 0')},
wanted AS (SELECT idx, CASE WHEN l_linenumber = 2 THEN l_orderkey + 1 ELSE l_orderkey END AS l_orderkey, l_linenumber FROM batch),
found AS (SELECT w.*, s.held IS NOT NULL AS held FROM wanted w LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, true AS held FROM lineitem WHERE l_orderkey % 4 = 0) s USING (l_orderkey, l_linenumber)),
firsts AS (SELECT min(idx) AS idx FROM found WHERE held GROUP BY l_orderkey, l_linenumber)
SELECT f.idx, l_orderkey, l_linenumber, 'Delete' AS operation, CASE WHEN x.idx IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN x.idx IS NULL THEN 'ConcurrencyConflict' END AS reason FROM found f LEFT JOIN firsts x ON x.idx = f.idx"""
)
def delete_missing_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0")
    batch = indexed(lines).withColumn("l_orderkey", F.expr("if(l_linenumber = 2, l_orderkey + 1, l_orderkey)"))
    return shown(flat.delete(batch, lines, MODEL, "lineitem").outcomes, *LINE_KEY)


CUSTOMER = replace(MODEL["customer"], generated_key=False, checks=())
NAMED = Model({"customer": CUSTOMER})


@query(
    f"""WITH {numbered(CUSTOMERS, 'customer', 'c_custkey % 2 = 0')}, named AS (SELECT idx, c_custkey, CASE WHEN c_custkey % 10 = 2 THEN 'Customer#000000001' ELSE 'x' || (c_custkey // 4) END AS name FROM batch),
taken AS (SELECT min(idx) AS idx FROM named WHERE name LIKE 'x%' GROUP BY name)
SELECT n.idx, c_custkey, 'Update' AS operation, CASE WHEN t.idx IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason FROM named n LEFT JOIN taken t ON t.idx = n.idx"""
)
def update_duplicate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of the batch want each new name, and some the name of a stored row."""
    customers = read(spark, sf_dir, "customer")
    batch = indexed(customers.where("c_custkey % 2 = 0")).withColumn("c_name", F.expr("if(c_custkey % 10 = 2, 'Customer#000000001', concat('x', c_custkey div 4))"))
    return shown(flat.update(batch, customers, NAMED, "customer").outcomes, "c_custkey")


@query(
    f"""WITH {numbered(ORDERS, 'orders')}
SELECT idx, o_orderkey, 'Update' AS operation, CASE WHEN o_orderkey % 3 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'ConcurrencyConflict' END AS reason FROM batch"""
)
def update_null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the stored tokens are null; a null token matches a null one."""
    model = Model({"orders": Entity("orders", ("o_orderkey",), tokens=("token",))})
    orders = read(spark, sf_dir, "orders").withColumn("token", F.expr("if(o_orderkey % 2 = 0, null, o_custkey)"))
    batch = indexed(read(spark, sf_dir, "orders")).withColumn("token", F.expr("case when o_orderkey % 3 = 0 then -1 when o_orderkey % 2 = 0 then null else o_custkey end"))
    return shown(flat.update(batch, orders, model, "orders").outcomes, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)")
def delete_null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Model({"orders": Entity("orders", ("o_orderkey",), tokens=("token",))})
    orders = read(spark, sf_dir, "orders").withColumn("token", F.expr("if(o_orderkey % 2 = 0, null, o_custkey)"))
    batch = indexed(read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")).withColumn("token", F.expr("if(o_orderkey % 3 = 0, 5L, null)"))
    return flat.delete(batch, orders, model, "orders").state["orders"].select("o_orderkey")


# Upsert

GENERATED = Model(MODEL.entities | {"orders": replace(MODEL["orders"], generated_key=True, foreign_keys=())})
UPSERTED = ("is_default_key",)


@query(
    f"""WITH {numbered(ORDERS, 'orders')}, fresh AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM batch WHERE o_orderkey % 4 = 0)
SELECT b.idx, CASE WHEN r IS NOT NULL THEN (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 8 <> 1) + r ELSE o_orderkey END::BIGINT AS o_orderkey, CASE WHEN r IS NOT NULL THEN 'Insert' ELSE 'Update' END AS operation,
CASE WHEN o_orderkey % 8 = 1 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN o_orderkey % 8 = 1 THEN 'ConcurrencyConflict' END AS reason, r IS NOT NULL AS is_default_key FROM batch b LEFT JOIN fresh f ON f.idx = b.idx"""
)
def upsert_default_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    batch = indexed(orders).withColumn("o_orderkey", F.expr("if(o_orderkey % 4 = 0, 0L, o_orderkey)"))
    return shown(flat.upsert(batch, orders.where("o_orderkey % 8 <> 1"), GENERATED, "orders").outcomes, "o_orderkey", more=UPSERTED)


PLAIN_CUSTOMER = Model(MODEL.entities | {"customer": replace(MODEL["customer"], generated_key=False, uniques=(), checks=())})
BY_NAME = UpsertOptions(match_by=("c_name",))


def matched_customers(spark: SparkSession, sf_dir: str, name: str, options: UpsertOptions = BY_NAME) -> Result:
    customers = read(spark, sf_dir, "customer")
    batch = indexed(customers).withColumns({"c_name": F.expr(name), "c_custkey": F.col("c_custkey") + 1000000})
    return flat.upsert(batch, customers, PLAIN_CUSTOMER, "customer", options=options)


@query(
    f"""WITH {numbered(CUSTOMERS, 'customer')}
SELECT idx, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Update' ELSE 'Insert' END AS operation, 'Success' AS status, NULL::VARCHAR AS reason, c_custkey % 2 <> 0 AS is_default_key FROM batch"""
)
def upsert_match_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(matched_customers(spark, sf_dir, "if(c_custkey % 2 = 0, c_name, concat(c_name, '+'))").outcomes, "c_custkey", more=UPSERTED)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS null_match_keys, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS inserted, (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS updated")
def upsert_null_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = matched_customers(spark, sf_dir, "if(c_custkey % 7 = 0, null, c_name)")
    done = result.metrics().select(F.col("inserted_count").alias("inserted"), F.col("updated_count").alias("updated"))
    return done.withColumn("null_match_keys", result.extra["null_matches"].scalar())


@query(
    """WITH batch AS (SELECT *, row_number() OVER (ORDER BY event_id, ts, user_id, event_type, value, props) - 1 AS idx FROM events WHERE event_id % 3 <> 0)
SELECT idx, CASE WHEN event_id % 5 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, CASE WHEN event_id % 5 = 0 THEN 'Insert' ELSE 'Update' END AS operation, 'Success' AS status, NULL::VARCHAR AS reason FROM batch"""
)
def upsert_match_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    batch = indexed(events.where("event_id % 3 <> 0")).withColumns({"user_id": F.expr("if(event_id % 5 = 0, -user_id - 1, user_id)"), "event_id": -F.col("event_id") - 1})
    model = Model({"events": replace(MODEL["events"], uniques=())})
    return shown(flat.upsert(batch, events, model, "events", options=UpsertOptions(match_by=("user_id", "ts"))).outcomes, "event_id")


ZERO = f"""{numbered(ORDERS, 'orders')}, keyed AS (SELECT idx, CASE WHEN o_orderkey % 100 = 7 THEN 0 ELSE o_orderkey END AS o_orderkey FROM batch)"""


def zero_keys(spark: SparkSession, sf_dir: str, strategy: DuplicateKey) -> Result:
    orders = read(spark, sf_dir, "orders")
    batch = indexed(orders).withColumn("o_orderkey", F.expr("if(o_orderkey % 100 = 7, 0L, o_orderkey)"))
    return flat.upsert(batch, orders, MODEL, "orders", options=UpsertOptions(duplicate_key=strategy))


@query(f"WITH {ZERO} SELECT idx, o_orderkey, 'Update' AS operation, 'Success' AS status, NULL::VARCHAR AS reason, o_orderkey = 0 AS retried FROM keyed")
def upsert_retry_as_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(zero_keys(spark, sf_dir, DuplicateKey.RETRY_AS_UPDATE).outcomes, "o_orderkey", more=("retried",))


@query(f"WITH {ZERO} SELECT idx, o_orderkey, CASE WHEN o_orderkey = 0 THEN 'Insert' ELSE 'Update' END AS operation, CASE WHEN o_orderkey = 0 THEN 'Skipped' ELSE 'Success' END AS status, NULL::VARCHAR AS reason FROM keyed")
def upsert_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(zero_keys(spark, sf_dir, DuplicateKey.SKIP).outcomes, "o_orderkey")


@query(f"WITH {ZERO} SELECT idx, o_orderkey, 'Update' AS operation, false AS is_default_key FROM keyed WHERE o_orderkey <> 0")
def upsert_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_keys(spark, sf_dir, DuplicateKey.FAIL).in_order().select("idx", F.col("entity_id")["o_orderkey"].alias("o_orderkey"), "operation", "is_default_key")


@query("SELECT p_name, count(*) AS rows FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY p_name HAVING count(*) > 1")
def match_ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return flat.ambiguous_match_keys(parts.where("p_partkey % 2 = 0"), parts, ("p_name",))


@query("SELECT p_name, count(*) AS rows FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name HAVING count(*) > 1")
def match_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.duplicate_match_keys(read(spark, sf_dir, "part").where("p_partkey % 2 = 0"), ("p_name",))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_nationkey < 5)")
def matching_rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    return flat.matching_rows(customers, customers.where("c_nationkey < 5"), ("c_name",)).select("c_custkey", "c_name", "c_acctbal")


@query(
    f"""WITH {numbered(CUSTOMERS, 'customer', 'c_custkey % 4 < 2')}, named AS (SELECT *, c_custkey % 4 = 0 AS fresh, 'y' || (c_custkey // 8) AS name FROM batch),
taken AS (SELECT min(idx) AS idx FROM named GROUP BY name), won AS (SELECT n.idx, row_number() OVER (ORDER BY n.idx) AS r FROM named n JOIN taken t ON t.idx = n.idx WHERE fresh)
SELECT n.idx, CASE WHEN NOT fresh THEN c_custkey WHEN r IS NULL THEN 0 ELSE (SELECT max(c_custkey) FROM customer) + r END AS c_custkey, CASE WHEN fresh THEN 'Insert' ELSE 'Update' END AS operation,
CASE WHEN t.idx IS NULL THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN t.idx IS NULL THEN 'DuplicateKey' END AS reason FROM named n LEFT JOIN taken t ON t.idx = n.idx LEFT JOIN won w ON w.idx = n.idx"""
)
def upsert_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts and updates that want the same name: the first one gets it."""
    customers = read(spark, sf_dir, "customer")
    batch = indexed(customers.where("c_custkey % 4 < 2")).withColumns({"c_name": F.expr("concat('y', c_custkey div 8)"), "c_custkey": F.expr("if(c_custkey % 4 = 0, 0L, c_custkey)")})
    model = Model({"customer": replace(CUSTOMER, generated_key=True)})
    return shown(flat.upsert(batch, customers, model, "customer").outcomes, "c_custkey")


# Guards, options, the front-end


def raises(call) -> bool:
    try:
        call()
    except (BatchError, ValueError):
        return True
    return False


@query(
    """SELECT 'filled navigation' AS guard, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS raised UNION ALL SELECT 'empty navigation', false
UNION ALL SELECT 'repeated match key', EXISTS (SELECT 1 FROM part GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'ambiguous match key', EXISTS (SELECT 1 FROM part WHERE p_name = (SELECT min(p_name) FROM part) HAVING count(*) > 1)
UNION ALL SELECT 'unique match key', EXISTS (SELECT 1 FROM customer GROUP BY c_name HAVING count(*) > 1) UNION ALL SELECT 'match by key', true UNION ALL SELECT 'match by nothing', true UNION ALL SELECT 'match by a navigation', true UNION ALL SELECT 'match by no column', true
UNION ALL SELECT 'match under a filter', true UNION ALL SELECT 'match by a generated column', true"""
)
def guards_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls abort as a whole."""
    orders, parts, customers = (read(spark, sf_dir, n) for n in ("orders", "part", "customer"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("lines"))
    nested, first = indexed(orders.join(lines, "o_orderkey", "left")), parts.agg(F.min("p_name").alias("p_name"))

    def matched(rows: DataFrame, name: str, by: tuple[str, ...], entity: Entity | None = None):
        model = Model({name: entity or replace(MODEL[name], generated_key=False, uniques=(), checks=())})
        return lambda: flat.upsert(indexed(rows), read(spark, sf_dir, name), model, name, options=UpsertOptions(match_by=by))

    found = {
        "filled navigation": raises(lambda: flat.insert(nested, none_of(nested), MODEL, "orders")),
        "empty navigation": raises(lambda: flat.insert(nested.withColumn("lines", F.array().cast("array<int>")), none_of(nested), MODEL, "orders")),
        "repeated match key": raises(matched(parts, "part", ("p_name",))),
        "ambiguous match key": raises(matched(parts.join(first, "p_name", "left_semi").limit(1), "part", ("p_name",))),
        "unique match key": raises(matched(customers, "customer", ("c_name",))),
        "match by key": raises(matched(customers, "customer", ("c_custkey",))),
        "match by nothing": raises(matched(customers, "customer", ())),
        "match by a navigation": raises(matched(customers, "customer", ("orders",))),
        "match by no column": raises(matched(customers, "customer", ("c_nothing",))),
        "match under a filter": raises(matched(customers, "customer", ("c_name",), replace(CUSTOMER, query_filter=True))),
        "match by a generated column": raises(matched(customers, "customer", ("c_name",), replace(CUSTOMER, store_generated=("c_name",)))),
    }
    return spark.createDataFrame(sorted(found.items()), "guard string, raised boolean")


@query(
    """SELECT * FROM (VALUES ('strategy', 'one_by_one'), ('detail', 'full'), ('validate_navigations', 'True'), ('duplicate_key', 'fail'), ('match_by', 'None'), ('max_depth', '10'), ('include_references', 'False'), ('include_links', 'False'),
('cycles', 'throw'), ('max_link_count', '0'), ('orphans', 'throw'), ('cascade', 'cascade'), ('link_insert', 'attach_existing'), ('validate_links', 'True'), ('validate_references', 'True'), ('max_retries', '3'), ('initial_delay', '0.1'), ('backoff', '2.0'), ('depth of 200', '100'), ('links at depth 101', 'refused')) AS v(name, value)"""
)
def option_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {**vars(UpsertOptions()), **vars(GraphOptions()), **vars(Retry())}
    names = "strategy detail validate_navigations duplicate_key match_by max_depth include_references include_links cycles max_link_count orphans cascade link_insert validate_links validate_references max_retries initial_delay backoff".split()
    rows = [(n, (str(v.value) if isinstance(v.value, str) else v.name.lower()) if isinstance(v := found[n], Enum) else str(v)) for n in names]
    rows += [("depth of 200", str(GraphOptions(max_depth=200).depth)), ("links at depth 101", "refused" if raises(lambda: GraphOptions(max_depth=101, include_links=True)) else "taken")]
    return spark.createDataFrame(rows, "name string, value string")


@query(
    """SELECT * FROM (VALUES ('a check', 'ValidationError', false), ('duplicate key value', 'DuplicateKey', false), ('violates foreign key constraint', 'DatabaseConstraint', false), ('row was changed by another commit', 'ConcurrencyConflict', false),
('deadlock detected', 'Unknown', true), ('connection reset by peer', 'Unknown', true), ('something else', 'Unknown', false)) AS v(text, reason, transient)"""
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of failure an error is, and whether it is worth another try."""
    errors = [ValueError("a check"), *map(RuntimeError, ("duplicate key value", "violates foreign key constraint", "row was changed by another commit", "deadlock detected", "connection reset by peer", "something else"))]
    return spark.createDataFrame([(str(e), classify(e), is_transient(e)) for e in errors], "text string, reason string, transient boolean")


@query("SELECT * FROM (VALUES (0, 1, 'raised', 0.0), (1, 1, 'done', 0.1), (3, 3, 'done', 0.7), (3, 4, 'raised', 0.7)) AS v(allowed, failing, ended, paused)")
def retries_and_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for allowed, failing in ((0, 1), (1, 1), (3, 3), (3, 4)):
        left, pauses = [failing], []

        def action(left=left):
            left[0] -= 1
            if left[0] >= 0:
                raise TimeoutError("timed out")

        try:
            with_retry(action, Retry(max_retries=allowed), pauses.append)
            ended = "done"
        except TimeoutError:
            ended = "raised"
        rows.append((allowed, failing, ended, float(round(sum(pauses), 6))))
    return spark.createDataFrame(rows, "allowed int, failing int, ended string, paused double").withColumn("paused", F.col("paused").cast("decimal(2,1)"))


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, 3::BIGINT AS commits FROM customer WHERE c_acctbal >= 0 AND c_custkey % 5 <> 0"""
)
def writer_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert into an empty store, update, delete: each call finds its keys in the model and commits once."""
    store, customers = Store(spark, new_path(spark, "store", released=True)), read(spark, sf_dir, "customer")
    writer = BatchWriter(store, Model({"customer": replace(MODEL["customer"], generated_key=False, navigations=())}), "customer")
    writer.insert(customers)
    writer.update(customers.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("CHANGED")))
    writer.delete(customers.where("c_custkey % 5 = 0"))
    return store.read("customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(store.commits()).cast("long").alias("commits"))
