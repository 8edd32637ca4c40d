"""Measurement tables read from the driver's star schema, and readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = "AUTOMOBILE"  # the label of unperturbed cells in the cells table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, context: 25 rows whatever the scale."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("context"))


def observations(spark: SparkSession, sf_dir: str, gene: str = "p_type") -> DataFrame:
    """context, perturbation, gene, flag, value, price, cell, batch: one row for each measured value.

    Context is the supplier's region, perturbation the part's brand, gene a part or line attribute, value the quantity.
    """
    where = table(spark, sf_dir, "supplier").join(_region_of(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(where, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "context",
            F.col("p_brand").alias("perturbation"),
            F.col(gene).alias("gene"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_quantity").alias("value"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell"),
            F.col("o_orderpriority").alias("batch"),
        )
    )


def responses(spark: SparkSession, sf_dir: str, gene: str = "p_type") -> DataFrame:
    """context, perturbation, gene, delta, n_cells: mean values over a balanced grid."""
    keys = ["context", "perturbation", "gene"]
    return observations(spark, sf_dir, gene).groupBy(*keys).agg(F.avg("value").alias("delta"), F.count(F.lit(1)).alias("n_cells"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, context, perturbation, batch: orders with their customer's region and segment."""
    customer = table(spark, sf_dir, "customer").join(_region_of(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("cell"), "context", F.col("c_mktsegment").alias("perturbation"), F.col("o_orderpriority").alias("batch")
        )
    )


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value: sparse counts, the quantity of each brand in each order; zeros are not stored."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )


MANIFEST = T.StructType(
    [
        T.StructField("season", T.StringType(), False),
        T.StructField("partition", T.StringType(), False),
        T.StructField("panel_id", T.StringType(), False),
        T.StructField("contexts", T.ArrayType(T.StringType()), False),
        T.StructField("control_label", T.StringType(), False),
        T.StructField("n_genes", T.LongType(), False),
        T.StructField("cells_per_pert", T.LongType(), False),
        T.StructField("per_context", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType())), True),
    ]
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest; a wrong type fails the read, a missing required key fails the query."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(MANIFEST).json(path)
    for f in MANIFEST.fields:
        if not f.nullable:
            rows = rows.withColumn(f.name, F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"manifest lacks {f.name}"))).otherwise(F.col(f.name)))
    return rows


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV, plain or compressed, with a given schema; lines starting with # are comments."""
    return spark.read.option("mode", "FAILFAST").option("comment", "#").csv(path, schema=schema, sep=sep, header=header, enforceSchema=False)


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """GMT lines (name, description, members...): set_name, gene."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) >= 3)
    return rows.select(parts[0].alias("set_name"), F.explode(F.slice(parts, 3, F.size(parts))).alias("gene")).filter("gene != ''")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """GTF gene records: gene, chromosome, strand, tss (the start on +, the end on -)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (f[2] == "gene"))
    name = F.regexp_extract(f[8], 'gene_name "([^"]+)"', 1)
    return rows.select(
        name.alias("gene"), f[0].alias("chromosome"), f[6].alias("strand"), F.when(f[6] == "+", f[3]).otherwise(f[4]).cast("long").alias("tss")
    ).filter("gene != ''")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet with an atomic job commit; partitioned where later reads prune."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
