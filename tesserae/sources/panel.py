"""Panel intake: registries with licences, checksums, target counts in several formats, files of contexts, gene axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The licence status and the qualification that a source must have, and the cells that make a target usable.
GREEN, UNKNOWN, QUALIFIED = "GREEN", "UNKNOWN", "qualified"
MINIMUM_CELLS = 20
REGISTRY = "name string, licensing_key string, license_status string, qualification string, role string, kind string, place int"


def _raise_where(bad: Column, message: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(message).cast("string")).otherwise(value)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """name, digest of a checksum file: digest, blanks, name, with a star before the name of a binary file. Empty lines are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).filter(line != "")
    name = F.regexp_replace(F.trim(F.regexp_extract(line, r"^\S+\s*(.*)$", 1)), r"^\*+", "")
    return rows.select(name.alias("name"), F.regexp_extract(line, r"^(\S+)", 1).alias("digest"))


def read_registry(spark: SparkSession, path: str, statuses: DataFrame) -> DataFrame:
    """The entries of a JSON registry (an object with `sources`), each checked against statuses (licensing_key, status).

    An entry whose stated status is not the known one, and a name that comes twice, raise an error when rows are read. Unlisted keys are UNKNOWN.
    """
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"sources array<struct<{REGISTRY.replace(' ', ':').replace(',:', ',')}>>").json(path)
    rows = raw.select(F.explode("sources").alias("s")).select("s.*").join(statuses, "licensing_key", "left").withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))
    times = F.count(F.lit(1)).over(Window.partitionBy("name"))  # a registry is a list of sources
    said = F.concat(F.lit("registry says "), "name", F.lit(" is "), "license_status", F.lit(", known is "), "status")
    checked = _raise_where(F.col("license_status") != F.col("status"), said, F.col("name"))
    return rows.withColumn("times", times).withColumn("name", _raise_where(F.col("times") > 1, F.lit("duplicate source names"), checked)).drop("times")


def usable_source(role: str) -> Column:
    """Whether an entry has the role, a known good licence and the qualification."""
    return (F.col("role") == role) & (F.col("qualification") == QUALIFIED) & (F.col("status") == GREEN)


def sources_of(registry: DataFrame, role: str) -> DataFrame:
    """The entries of a role in their order; one that may not be used raises an error when rows are read."""
    said = F.concat("name", F.lit(f" is registered as {role} but is not {GREEN} and {QUALIFIED}"))
    rows = registry.filter(F.col("role") == role)
    return rows.withColumn("name", _raise_where(~usable_source(role), said, F.col("name"))).orderBy("place")


def read_target_counts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """target, cells of a coverage file: values and counts in JSON, a table parted by blanks, a CSV, or a FASTA guide library.

    A guide library tells presence only, so its cells are null; numbers at the end of guide names drop out.
    """
    if kind == "coverage_obs_json":
        values = spark.read.option("multiLine", True).json(path).select(F.col("obs_values.gene_target").alias("g"))
        return values.select(F.explode(F.arrays_zip("g.categories", "g.counts")).alias("z")).select(F.col("z.categories").alias("target"), F.col("z.counts").cast("double").alias("cells"))
    if kind == "coverage_manifest":
        lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
        head = lines.first()["f"]  # the names of the columns
        at = {c: F.col("f")[head.index(c)] for c in ("gene", "cell_count")}
        return lines.filter(at["gene"] != "gene").select(at["gene"].alias("target"), at["cell_count"].cast("double").alias("cells"))
    if kind == "coverage_counts_csv":
        rows = spark.read.option("mode", "FAILFAST").csv(path, header=True)
        return rows.select(F.col("gene_target").alias("target"), F.col("n_cells").cast("double").alias("cells"))
    if kind == "coverage_guide_library":
        names = spark.read.text(path).filter(F.col("value").startswith(">")).select(F.trim(F.substring("value", 2, 1_000_000)).alias("n"))
        return names.select(F.regexp_replace("n", r"_\d+$", "").alias("target"), F.lit(None).cast("double").alias("cells")).distinct()
    raise ValueError(f"unknown kind {kind}")


def coverage_audit(targets: DataFrame, usable: DataFrame, counts: DataFrame) -> DataFrame:
    """target, n_sources, sources, audits: how many sources can use each target, and which audit-only sources have it.

    usable: source, target; counts: source, target, cells (null: presence only). Audit sources never count among the sources.
    """
    own = usable.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    there = counts.filter(F.col("cells").isNull() | (F.col("cells") >= MINIMUM_CELLS)).groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("audits"))
    none = F.array().cast("array<string>")
    out = targets.select("target").distinct().join(own, "target", "left").join(there, "target", "left")
    out = out.select("target", F.coalesce("sources", none).alias("sources"), F.coalesce("audits", none).alias("audits"))
    return out.select("target", F.size("sources").alias("n_sources"), "sources", "audits")


def control_files(spark: SparkSession, folder: str, contexts: list[str], named: dict[str, str], context_col: str) -> dict[str, tuple[str, str]]:
    """Each context's Parquet file in a folder and how it was found: named by the manifest, by its usual name context_<label>.parquet,
    or as the only file whose context column holds that label alone. None or several candidates are an error.

    Only names come to the driver, and of files that no rule named, the labels that they hold.
    """
    listed = [r.path for r in spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.parquet").select("path").collect()]
    by_name = {p.rsplit("/", 1)[1]: p for p in listed}
    out: dict[str, tuple[str, str]] = {}
    for c in contexts:
        if c in named:
            if named[c] not in by_name:
                raise ValueError(f"{c}: manifest file {named[c]!r} is not in the folder")
            out[c] = by_name[named[c]], "named by manifest"
        elif f"context_{c}.parquet" in by_name:
            out[c] = by_name[f"context_{c}.parquet"], "usual name"
    rest = [c for c in contexts if c not in out]
    if rest:
        taken = {p for p, _ in out.values()}
        seen = {p: {r[0] for r in spark.read.parquet(p).select(context_col).distinct().limit(2).collect()} for p in listed if p not in taken and context_col in spark.read.parquet(p).columns}
        for c in rest:
            found = [p for p, labels in seen.items() if labels == {c}]
            if len(found) != 1:
                raise ValueError(f"{c}: {len(found)} files hold this context alone")
            out[c] = found[0], "only file of the context"
    return out


def select_genes(rows: DataFrame, genes: list[str]) -> DataFrame:
    """The rows of these genes with `place`, their position in the list; a gene that the rows lack raises an error when they are read.

    The list is a selected axis; it meets the rows as a table.
    """
    axis = rows.sparkSession.createDataFrame(list(enumerate(genes)), "place int, gene string")
    there = rows.select("gene").distinct().withColumn("there", F.lit(True))
    checked = axis.join(there, "gene", "left")
    said = F.concat(F.lit("requested gene is absent: "), "gene")
    return rows.join(checked.withColumn("gene", _raise_where(F.col("there").isNull(), said, F.col("gene"))).drop("there"), "gene", "right")


def collapse_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """cell, gene, value with values summed over the features that share a symbol. symbols: feature, symbol."""
    return rows.join(symbols, "feature").groupBy("cell", F.col("symbol").alias("gene")).agg(F.sum("value").alias("value"))

