"""Bounded runs over ordered rows, and replacing an owner's rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import until_enough
from ..operators.tables import Passing, shared_folder
from ..operators.versions import OwnedTable
from .base import Tables, query

_MOST = 40
_MISSING = "o_orderstatus <> 'O'"
_RECENT = "o_orderkey % 3 > 0 AND o_totalprice > 20000"
_ORDERED = f"""
WITH m AS (SELECT o_orderkey, coalesce({_RECENT}, false) AS recent, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE {_MISSING}),
c AS (SELECT *, count(*) FILTER (NOT recent) OVER (ORDER BY place) AS taken FROM m)
"""


def _scan(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.where(_MISSING).select("o_orderkey", "o_orderdate", F.expr(_RECENT).alias("recent"))
    return until_enough(rows, [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], ~F.coalesce("recent", F.lit(False)), _MOST, Passing(t.spark, "hydrate"))


@query("hydration_candidates", _ORDERED + f"SELECT o_orderkey FROM c WHERE NOT recent AND taken <= {_MOST}")
def hydration_candidates(t: Tables) -> DataFrame:
    """The newest orders to work on, without those that failed of late, up to the run's bound."""
    return _scan(t)[0].select("o_orderkey")


@query("hydration_counts", _ORDERED + f"SELECT count(*) AS considered, count(*) FILTER (NOT recent AND taken <= {_MOST}) AS taken, count(*) FILTER (recent AND taken < {_MOST}) AS passed FROM c")
def hydration_counts(t: Tables) -> DataFrame:
    """All that is missing, what the run takes, and what it passes over before it stops."""
    return _scan(t)[1]


@query("replaced_rows", """
SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 3 = 1 THEN 'new' ELSE 'old' END AS state, CASE WHEN c_nationkey % 3 = 1 AND c_custkey % 7 = 0 AND c_acctbal > 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_nationkey % 3 <> 2 AND (c_nationkey % 3 <> 1 OR c_custkey % 2 = 0)
""")
def replaced_rows(t: Tables) -> DataFrame:
    """Customers owned by nations: written, replaced for a third of the nations, emptied for another, updated by ids."""
    table = OwnedTable(t.spark, shared_folder(t.spark, "owned"), "c_custkey long, c_nationkey long, state string, c_acctbal double", "c_nationkey")
    rows = t.customer.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("long").alias("c_nationkey"), F.lit("old").alias("state"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    table.replace(rows)
    named = rows.where("c_nationkey % 3 <> 0").select("c_nationkey").distinct()
    table.replace(rows.where("c_nationkey % 3 = 1 AND c_custkey % 2 = 0").withColumn("state", F.lit("new")), named)
    ids = t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    table.update(ids, ["c_custkey"], {"c_acctbal": F.lit(0.0)}, F.expr("state = 'new' AND c_acctbal > 0"))
    return table.read()
