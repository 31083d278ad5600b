"""The tables of a data directory, seen as a workspace of projects, documents, symbols and observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Workspace:
    """Facts as DataFrames; nothing is read before a query needs it."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def projects(self) -> DataFrame:
        """``project_key, name``: a project for each nation."""
        return self.table("nation").select(F.concat(F.lit("name:"), "n_name").alias("project_key"), F.col("n_name").alias("name"), "n_nationkey")

    @property
    def documents(self) -> DataFrame:
        """``document_id, name, project_key``: customers and suppliers, in the project of their nation."""
        c = self.table("customer").select(F.concat(F.lit("document:c"), "c_custkey").alias("document_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
        s = self.table("supplier").select(F.concat(F.lit("document:s"), "s_suppkey").alias("document_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
        nations = self.table("nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("name:"), "n_name").alias("project_key"))
        return c.unionByName(s).join(nations, "n").drop("n")

    @property
    def declarations(self) -> DataFrame:
        """``symbol_key, symbol_id, document_id, ordinal``: an order in its customer's document, a part in that of each of its suppliers."""
        return self._declarations(self.table("lineitem").select("l_partkey", "l_suppkey").distinct())

    @property
    def declared(self) -> DataFrame:
        """``declarations`` as they come, some several times; for what tells them apart itself."""
        return self._declarations(self.table("lineitem").select("l_partkey", "l_suppkey"))

    def _declarations(self, pairs: DataFrame) -> DataFrame:
        o = self.table("orders").select(
            F.concat(F.lit("o"), "o_orderkey").alias("symbol_key"), F.concat(F.lit("symbol:o"), "o_orderkey").alias("symbol_id"),
            F.concat(F.lit("document:c"), "o_custkey").alias("document_id"), F.col("o_orderkey").alias("ordinal"),
        )
        p = pairs.select(
            F.concat(F.lit("p"), "l_partkey").alias("symbol_key"), F.concat(F.lit("symbol:p"), "l_partkey").alias("symbol_id"),
            F.concat(F.lit("document:s"), "l_suppkey").alias("document_id"), F.col("l_suppkey").alias("ordinal"),
        )
        return o.unionByName(p)

    @property
    def symbols(self) -> DataFrame:
        """``symbol_id, document_id, kind, name, line``: orders, and parts in the document that declares them first."""
        o = self.table("orders").select(
            F.concat(F.lit("symbol:o"), "o_orderkey").alias("symbol_id"), F.concat(F.lit("document:c"), "o_custkey").alias("document_id"),
            F.col("o_orderpriority").alias("kind"), F.concat(F.lit("Order"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 500 + 1).cast("int").alias("line"),
        )
        first = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
        p = self.table("part").join(first, F.col("p_partkey") == F.col("l_partkey")).select(
            F.concat(F.lit("symbol:p"), "p_partkey").alias("symbol_id"), F.concat(F.lit("document:s"), "s").alias("document_id"),
            F.col("p_type").alias("kind"), F.col("p_name").alias("name"), (F.col("p_partkey") % 500 + 1).cast("int").alias("line"),
        )
        return o.unionByName(p)

    @property
    def observations(self) -> DataFrame:
        """A reference from an order to a part for each line; lines of small quantity carry no sample."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        shown = F.col("l_quantity") >= 10
        return self.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
            F.concat(F.lit("document:c"), "o_custkey").alias("source_document_id"),
            F.concat(F.lit("o"), "l_orderkey").alias("source_symbol_key"), F.concat(F.lit("p"), "l_partkey").alias("target_symbol_key"),
            F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "creation").otherwise("reference").alias("reference_kind"),
            F.when(F.col("l_linestatus") == "O", "high").otherwise("medium").alias("confidence"),
            F.when(shown, F.concat(F.lit("c"), "o_custkey", F.lit(".cs"))).alias("file"),
            F.when(shown, F.col("l_linenumber")).alias("line"),
            F.when(shown, F.concat(F.lit("use p"), "l_partkey")).alias("snippet"),
        )

    @property
    def project_references(self) -> DataFrame:
        """``source, target, weight``: for each customer's nation the two suppliers' nations, but itself, with the most lines; ties by key."""
        o, c, s = self.table("orders"), self.table("customer"), self.table("supplier")
        by_order = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey").join(by_order, F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
        counts = lines.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))
        top = counts.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where("n <= 2")
        n = self.table("nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("name:"), "n_name").alias("key"))
        return (
            top.join(n.select(F.col("k").alias("a"), F.col("key").alias("source")), "a")
            .join(n.select(F.col("k").alias("b"), F.col("key").alias("target")), "b").select("source", "target", "weight")
        )

    @property
    def packages(self) -> DataFrame:
        """``project_key, name``: the brands that a nation's suppliers deliver."""
        return self._external("p_brand")

    @property
    def assemblies(self) -> DataFrame:
        """``project_key, name``: the types that a nation's suppliers deliver."""
        return self._external("p_type")

    def _external(self, column: str) -> DataFrame:
        n = self.table("nation").select("n_nationkey", F.concat(F.lit("name:"), "n_name").alias("project_key"))
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        return (
            pairs.join(self.table("part").select("p_partkey", F.col(column).alias("name")), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("project_key", "name").distinct()
        )
