"""A Merkle manifest of a dataset: a digest of every row, a tree over each source and one over the sources, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ordered, positions, stored

FAN = 16
CLIMB = 2  # levels of an aligned block
STEP = "array<struct<index: int, siblings: string>>"
STEP_ARROW = pa.list_(pa.struct([("index", pa.int32()), ("siblings", pa.string())]))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as `-` if null, else its UTF-8 bytes after their number and a colon."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to: the digest takes its place among the siblings of each level."""

    def up(digest: Column, step: Column) -> Column:
        cut = step["index"] * 64
        run = F.concat(F.substring(step["siblings"], F.lit(1), cut), digest, F.substring(step["siblings"], cut + 1, F.length(step["siblings"])))
        return F.sha2(run, 256)

    return F.aggregate(proof, leaf, up)


def visit(digests: list[str], start: int, stop: int, level: int, steps: list[list[tuple[int, str]]] | None) -> str:
    """Digest of the subtree over digests[start:stop], children first; while unwinding, each child's leaves get their siblings."""
    if level == 0:
        return digests[start]
    width = FAN ** (level - 1)
    begins = range(start, stop, width)
    children = [visit(digests, a, min(a + width, stop), level - 1, steps) for a in begins]
    if steps is not None:
        for k, a in enumerate(begins):
            siblings = "".join(children[:k] + children[k + 1 :])
            for leaf in range(a, min(a + width, stop)):
                steps[leaf].append((k, siblings))
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _roots(group: pa.Table) -> pa.Table:
    rows = group.sort_by("pos")
    digests = rows["digest"].to_pylist()
    top = visit(digests, 0, len(digests), rows["levels"][0].as_py(), None)
    return rows.slice(0, 1).select(["tree"]).append_column("pos", rows["block"].slice(0, 1)).append_column("digest", pa.array([top]))


def _proofs(group: pa.Table) -> pa.Table:
    """Every node with the steps inside its block and then those of the block."""
    rows = group.sort_by("pos")
    digests = rows["digest"].to_pylist()
    steps: list[list[tuple[int, str]]] = [[] for _ in digests]
    visit(digests, 0, len(digests), rows["levels"][0].as_py(), steps)
    above = [(s["index"], s["siblings"]) for s in rows["above"][0].as_py()]
    proof = [[{"index": k, "siblings": x} for k, x in own + above] for own in steps]
    return rows.drop_columns(["pos", "digest", "levels", "block", "above"]).append_column("proof", pa.array(proof, STEP_ARROW))


def _blocked(nodes: DataFrame) -> DataFrame:
    """Adds the aligned block of each node and how many levels its tree still climbs there."""
    size = F.col("size")
    levels = sum((F.when(size > FAN**i, 1).otherwise(0) for i in range(CLIMB)), F.lit(0)).cast("int")
    return nodes.withColumns({"levels": levels, "block": F.floor(F.col("pos") / FAN**CLIMB).cast("bigint")})


def _grow(nodes: DataFrame, sizes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of nodes (tree, pos, digest) with the sizes of the trees, from the given nodes up to one node a tree.

    Each pass reads the nodes of the one below in blocks of FAN ** CLIMB and leaves one row a block. The number of passes follows
    from the largest tree.
    """
    kind = nodes.schema["tree"].dataType.simpleString()
    passes = [(nodes, sizes)]
    most = sizes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        below = _with_sizes(nodes, sizes)
        nodes = stored(_blocked(below).groupBy("tree", "block").applyInArrow(_roots, f"tree {kind}, pos bigint, digest string"))
        sizes = sizes.withColumn("size", F.ceil(F.col("size") / FAN**CLIMB))
        passes.append((nodes, sizes))
        most = -(-most // FAN**CLIMB)
    return passes


def _with_sizes(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    return nodes.join(sizes.withColumnRenamed("tree", "of"), nodes["tree"].eqNullSafe(F.col("of"))).drop("of")


def _descend(passes: list[tuple[DataFrame, DataFrame]], above: DataFrame) -> DataFrame:
    """The lowest nodes with `proof`; above: tree and the steps that follow its root, with whatever columns go down to its nodes."""
    carried = [c for c in above.columns if c not in ("tree", "above")]
    upper = above.withColumn("pos", F.lit(0).cast("bigint"))
    for k in range(len(passes) - 2, -1, -1):
        nodes, sizes = passes[k]
        blocks = _blocked(_with_sizes(nodes, sizes)).drop("size")
        top = upper.select(F.col("tree").alias("of"), F.col("pos").alias("on"), "above", *carried)
        met = blocks.join(top, blocks["tree"].eqNullSafe(F.col("of")) & (blocks["block"] == F.col("on"))).drop("of", "on")
        keep = [c for c in met.schema if c.name not in ("pos", "digest", "levels", "block", "above")]
        names = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in keep)
        whole = met.withColumn("place", F.col("pos")).groupBy("tree", "block").applyInArrow(_proofs, f"{names}, place bigint, proof {STEP}")
        if k == 0:
            return whole.withColumnRenamed("place", "pos")
        upper = stored(whole.select("tree", F.col("place").alias("pos"), F.col("proof").alias("above"), *carried))
    nodes, _ = passes[0]
    return nodes.join(upper.drop("pos").withColumnRenamed("tree", "of"), nodes["tree"].eqNullSafe(F.col("of"))).drop("of", "digest").withColumnRenamed("above", "proof")


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof, and the `extra` columns, expressions over the documents.

    A leaf is the digest of a row's fields. The leaves of a source, by ascending id, are the lowest level of its tree: runs of 16
    neighbours become the digest of their digests until one is left, the subroot. The subroots, by source, form the tree whose
    root stands for the table. `proof` has, from the leaf up, the index in the run and the siblings' digests joined in order;
    fold() leads a leaf and its proof to the root.

    1. One scan makes the leaves; only digests, ids and sources go on. Sampled ranges and a row of numbers for each source and
       range give every leaf its position, so a source that holds a third of the rows is one of many ranges.
    2. Aligned blocks of 256 nodes are visited in postorder, many at a time; their roots are the nodes of the next pass, up to the
       root. The passes number log256 of the largest source.
    3. Downwards, a block gets the steps of its root, is visited again, and appends siblings to the leaves it contains while
       unwinding. Proofs are never shuffled, except those of block roots, one for 256 nodes.

    Null ids come first within a source, null sources form the first tree, null fields are `-`. Equal ids are in the order of
    their leaves; equal rows have equal leaves and different places. A lone leaf is its subroot, a lone subroot the root; its
    proof is empty. An empty table gives an empty result.
    """
    more = extra or {}
    leaves = docs.select(
        F.col(source_col).alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(f"x_{n}") for n, c in more.items()]
    )
    numbered = stored(positions(ordered(leaves, ["tree", "doc_id", "digest"]), ["tree"]).withColumn("leaf", F.col("digest")).drop("at"))
    sizes = stored(numbered.groupBy("tree").agg(F.count(F.lit(1)).alias("size")))
    slim = numbered.select("tree", "pos", "digest")
    passes = _grow(slim, sizes)
    top = passes[-1][0].select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest")
    over = stored(positions(ordered(top, ["tree", "source"]), ["tree"]).drop("at"))
    upper = _grow(over.select("tree", "pos", "digest"), stored(over.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))))
    root = upper[-1][0].select("tree", F.col("digest").alias("root"), F.array().cast(STEP).alias("above"))
    paths = stored(_descend(upper, root).select("pos", "root", F.col("proof").alias("above")))
    named = over.select("pos", F.col("source").alias("tree"), F.col("digest").alias("subroot")).join(paths, "pos").drop("pos")
    passes[0] = (numbered, sizes)
    out = _descend(passes, stored(named))
    return out.select("doc_id", "leaf", "subroot", "root", "proof", *[F.col(f"x_{n}").alias(n) for n in more])
