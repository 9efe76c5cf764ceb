"""The test tables as a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.model import Check, Entity, ForeignKey, Model, Navigation
from batchwright.plans.index import IDX, with_index

MODEL = Model.of(
    Entity("region", ("r_regionkey",), navigations=(Navigation("nations", "nation", ("n_regionkey",)),)),
    Entity("nation", ("n_nationkey",), foreign_keys=(ForeignKey(("n_regionkey",), "region"),), navigations=(Navigation("customers", "customer", ("c_nationkey",)), Navigation("region", "region", ("n_regionkey",), "reference"))),
    Entity(
        "customer",
        ("c_custkey",),
        generated_key=True,
        uniques=(("c_name",),),
        checks=(Check("c_acctbal >= 0", "the balance is negative"),),
        navigations=(Navigation("orders", "orders", ("o_custkey",)), Navigation("nation", "nation", ("c_nationkey",), "reference")),
    ),
    Entity("orders", ("o_orderkey",), foreign_keys=(ForeignKey(("o_custkey",), "customer", "cascade"),), navigations=(Navigation("lines", "lineitem", ("l_orderkey",)), Navigation("customer", "customer", ("o_custkey",), "reference"))),
    Entity(
        "lineitem",
        ("l_orderkey", "l_linenumber"),
        foreign_keys=(ForeignKey(("l_orderkey",), "orders", "cascade"),),
        checks=(Check("l_discount <= 0.09", "the discount is over 0.09"),),
        navigations=(Navigation("part", "part", ("l_partkey",), "reference"), Navigation("supplier", "supplier", ("l_suppkey",), "reference")),
    ),
    Entity("supplier", ("s_suppkey",), navigations=(Navigation("parts", "part", ("ps_suppkey",), "link", "partsupp", ("ps_partkey",)),)),
    Entity("part", ("p_partkey",), uniques=()),
    Entity("partsupp", ("ps_suppkey", "ps_partkey"), foreign_keys=(ForeignKey(("ps_suppkey",), "supplier", "cascade"), ForeignKey(("ps_partkey",), "part"))),
    Entity("events", ("event_id",), uniques=(("user_id", "ts"),)),
    Entity("message", ("conv_id", "turn"), navigations=(Navigation("answers", "message", ("conv_id", "parent_turn")),)),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(df: DataFrame) -> DataFrame:
    """Dense indices by all columns."""
    return with_index(df)


def flat(outcomes: DataFrame, *key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes with their key as columns."""
    return outcomes.select("idx", *(F.col("entity_id")[k].alias(k) for k in key), "operation", "status", "reason", *more)


def none_of(df: DataFrame) -> DataFrame:
    """No rows with the columns of ``df``."""
    return df.where(F.lit(False)).drop(IDX)
