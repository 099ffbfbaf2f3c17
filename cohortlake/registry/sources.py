"""Sources and sinks over the test tables; round trips go through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import frames as O
from cohortlake.operators.tree import node_depths
from cohortlake.registry import query
from cohortlake.session import fresh_path
from cohortlake.sources import io
from cohortlake.sources import views as V
from cohortlake.sources.views import sql_with, table


@query(
    "scan_typed_csv",
    sql_with(
        "subjects",
        "SELECT subject, stratum, balance, last_status, segment || chr(10) || 'line \"two\", end' AS note FROM subjects",
    ),
)
def _(spark, d):
    rows = V.subjects(spark, d).select(
        "subject", "stratum", "balance", "last_status", F.concat("segment", F.lit('\nline "two", end')).alias("note")
    )
    path = fresh_path(spark, "typed-csv")
    io.write_csv(rows, path, compression="gzip")
    return io.read_typed_csv(spark, path, rows.schema, quoted_newlines=True)


@query(
    "union_sources",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def _(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return O.union_sources([customers, suppliers])


@query(
    "tagged_union",
    "SELECT 'urgent' AS cohort, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' "
    "UNION ALL SELECT 'pooled', o_orderkey, o_totalprice FROM orders",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    parts = {"urgent": urgent, "pooled": orders}
    return O.tagged_union({k: v.select("o_orderkey", "o_totalprice") for k, v in parts.items()}, "cohort")


@query(
    "scan_glob",
    "SELECT 'orders.parquet' AS origin, o_orderkey, o_custkey, o_totalprice FROM orders",
)
def _(spark, d):
    rows = io.scan_glob(spark, f"{d}/ord*.parquet").select("origin", "o_orderkey", "o_custkey", "o_totalprice")
    return rows.withColumn("origin", F.element_at(F.split("origin", "/"), -1))


@query("tee_sink", sql_with("counts_dense", "SELECT feature, CAST(sum(n) AS BIGINT) AS n FROM counts_dense GROUP BY feature"))
def _(spark, d):
    kept = io.tee(V.counts_dense(spark, d), fresh_path(spark, "tee"))
    return kept.groupBy("feature").agg(F.sum("n").alias("n"))


@query(
    "partitioned_sink",
    "SELECT CAST(event_id % 4 AS INTEGER) AS chain, event_id, event_type, value FROM events",
)
def _(spark, d):
    rows = table(spark, d, "events").select(
        (F.col("event_id") % 4).cast("int").alias("chain"), "event_id", "event_type", "value"
    )
    return io.partitioned_sink(rows, fresh_path(spark, "chains"), ["chain"])


@query(
    "tree_edges",
    sql_with(
        "tree",
        """
        WITH RECURSIVE walk AS (
            SELECT node, CAST(0 AS INTEGER) AS depth, CAST(0 AS DOUBLE) AS path_length FROM tree WHERE parent IS NULL
            UNION ALL
            SELECT t.node, w.depth + 1, w.path_length + t.length FROM walk w JOIN tree t ON t.parent = w.node)
        SELECT node, depth, round(path_length, 6) AS path_length FROM walk""",
    ),
)
def _(spark, d):
    out = node_depths(V.tree(spark, d), "node", "parent", "length")
    return out.select("node", "depth", F.round("path_length", 6).alias("path_length"))
