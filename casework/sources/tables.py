"""Reading and writing tables, and the views that bind the given tables to cases, items, profiles and series."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casework.sources.storage import written


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str, *, records: str | None = None) -> DataFrame:
    """Typed records from Parquet, JSON lines, or JSON documents that hold their records in an array field ``records``."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if records is None:
        return spark.read.schema(schema).json(path)
    inner = schema if isinstance(schema, str) else schema.simpleString()
    whole = spark.read.option("multiLine", True).schema(f"{records} array<{inner if inner.startswith('struct') else f'struct<{inner}>'}>").json(path)
    return whole.select(F.explode(records).alias("record")).select("record.*")


def write_corpus(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Records to Parquet, JSON lines or CSV, partitioned by the named columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def keyed_replace_load(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that ``df`` has, leaving all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


class Tables:
    """The given tables of a folder and the views over them. Nothing is read until a view is used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made = spark, folder, {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` returns, written when first asked for and read by every later step of the same query."""
        if name not in self._made:
            self._made[name] = written(make())
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def cases(self) -> DataFrame:
        in_order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderpriority").alias("objective"),
            F.col("o_orderdate").cast("date").alias("case_date"),
            F.col("o_totalprice").alias("total"),
            F.row_number().over(in_order).alias("version"),
        )

    @cached_property
    def headers(self) -> DataFrame:
        """The cases without their version, which costs a window."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderpriority").alias("objective"),
            F.col("o_orderdate").cast("date").alias("case_date"),
            F.col("o_totalprice").alias("total"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_quantity").alias("quantity"),
            F.concat("l_returnflag", "l_linestatus").alias("slot"),
            F.concat(F.lit("u"), (F.col("l_linenumber") % 3).cast("string")).alias("unit"),
            F.col("l_linestatus").alias("line_group"),
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("family"),
            F.col("p_brand").alias("grp"),
            F.col("p_size").alias("scale"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_size") > 40).alias("bulky"),
            (F.col("p_retailprice") > 1000).alias("costly"),
        )

    @cached_property
    def named_items(self) -> DataFrame:
        """Items with family and group of their product. Spark broadcasts the catalogue when its size allows."""
        return self.items.join(self.catalogue.select("product_id", "family", "grp"), "product_id")

    @cached_property
    def profiles(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))
        return (
            self.table("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"), "nation", "region", F.col("c_acctbal").alias("balance"))
        )

    @cached_property
    def series(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("entity_id"), "ts", F.col("event_type").alias("marker"), "value")


#: The same views in SQL, put before the SQL of every query that is checked.
SQL_VIEWS = """
WITH cases AS (
    SELECT o_orderkey AS case_id, o_custkey AS entity_id, o_orderpriority AS objective, CAST(o_orderdate AS DATE) AS case_date,
           o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version
    FROM orders),
items AS (
    SELECT l_orderkey AS case_id, l_partkey AS product_id, l_linenumber AS line, l_quantity AS quantity,
           l_returnflag || l_linestatus AS slot, 'u' || CAST(l_linenumber % 3 AS VARCHAR) AS unit, l_linestatus AS line_group
    FROM lineitem),
catalogue AS (
    SELECT p_partkey AS product_id, p_name AS name, p_type AS family, p_brand AS grp, p_size AS scale, p_retailprice AS price,
           p_size > 40 AS bulky, p_retailprice > 1000 AS costly FROM part),
named_items AS (SELECT i.*, c.family, c.grp FROM items i JOIN catalogue c USING (product_id)),
profiles AS (
    SELECT c_custkey AS entity_id, c_mktsegment AS segment, n_name AS nation, n_regionkey AS region, c_acctbal AS balance
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
series AS (SELECT event_id, user_id AS entity_id, ts, event_type AS marker, value FROM events)
"""
