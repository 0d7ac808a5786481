"""The loan-application tables as views over the generic star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The same text is valid in Spark SQL and in the checking engine.
APPLICATION_SQL = """
SELECT o.o_orderkey AS SK_ID_CURR,
       CASE WHEN o.o_orderpriority = '1-URGENT' AND (o.o_orderkey * 31 + o.o_custkey) % 1000 < 600 THEN 1 ELSE 0 END AS TARGET,
       CASE WHEN c.c_acctbal <= 0 THEN CAST(0 AS DOUBLE) ELSE c.c_acctbal * 20 END AS AMT_INCOME_TOTAL,
       o.o_totalprice AS AMT_CREDIT,
       CASE WHEN o.o_orderkey % 10 = 3 THEN NULL ELSE o.o_totalprice / 12 END AS AMT_ANNUITY,
       -(7300 + (o.o_custkey * 37 + o.o_orderkey * 11) % 17000) AS DAYS_BIRTH,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 365243 ELSE -(100 + (o.o_orderkey * 13) % 9000) END AS DAYS_EMPLOYED,
       CASE WHEN o.o_orderkey % 10 < 6 THEN NULL ELSE CAST((o.o_orderkey * 7) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_1,
       CAST((o.o_orderkey * 31 + o.o_custkey) % 1000 AS DOUBLE) / 1000 AS EXT_SOURCE_2,
       CASE WHEN o.o_orderkey % 5 = 4 THEN NULL ELSE CAST((o.o_custkey * 17) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_3,
       CASE WHEN o.o_orderkey % 50 = 7 THEN NULL WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
       CASE o.o_orderstatus WHEN 'F' THEN 'Cash loans' WHEN 'O' THEN 'Revolving loans' ELSE 'Unknown' END AS NAME_CONTRACT_TYPE,
       c.c_mktsegment AS NAME_INCOME_TYPE,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
       CASE WHEN o.o_orderkey % 2000 = 0 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_2,
       CASE WHEN o.o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_3,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_6,
       CASE WHEN o.o_orderkey % 20 = 0 THEN CAST(1 AS DOUBLE) END AS MOSTLY_NULL,
       CAST(7 AS DOUBLE) AS CONSTANT_COL
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

BUREAU_SQL = """
SELECT l_orderkey AS SK_ID_CURR, l_orderkey * 10 + l_linenumber AS SK_ID_BUREAU,
       CASE WHEN l_linestatus = 'O' THEN 'Active' ELSE 'Closed' END AS CREDIT_ACTIVE,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END AS CREDIT_DAY_OVERDUE,
       l_extendedprice AS AMT_CREDIT_SUM,
       CASE l_returnflag WHEN 'R' THEN 'Consumer credit' WHEN 'A' THEN 'Car loan' ELSE 'Mortgage' END AS CREDIT_TYPE
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        APPLICATION_SQL, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer")
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BUREAU_SQL, lineitem=table(spark, sf_dir, "lineitem"))
