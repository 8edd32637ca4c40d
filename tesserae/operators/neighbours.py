"""Exact nearest neighbours by cosine: clusters that can not hold one are not searched, and nothing is left to chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 256  # reference vectors, drawn by hash, around which the others gather; the driver and every task hold them
BLOCK = 2048  # vectors of a part of a cluster
ASKING = 4096  # queries that meet a part together
TOGETHER = 512  # rows that a task hands on at once
CELLS = 2**21  # cosines held at once
EXACT = 2**14  # candidates whose vectors are held at once
HELD_BYTES = 2**24  # bytes of the vectors of a block, where all vectors ask
SPREAD = 8  # blocks that there are at least if each still has BLOCK vectors, so that their pairs keep the cores busy


def _scaled(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _unit(rows: pd.Series) -> np.ndarray:
    return _scaled(np.array(rows.tolist(), dtype=float).reshape(len(rows), -1))


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of an Arrow column as rows of length one; those without length stay so."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return _scaled(flat.reshape(len(column), -1 if len(column) else 1))


def _angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centre.T, -1.0, 1.0))


def _closest(x: np.ndarray, names: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, ids and cosines: for each row of x the best k rows of y, whose ids ascend, itself left out; rounded cosines, equal ones by id.

    Single precision finds the candidates, with a margin for its error; their cosines are computed anew in double precision.
    """
    pieces, step, out = 16 * (k + 1), max(1, CELLS // len(ids)), []
    margin = 1.5 * 10.0**-digits + 2 * (y.shape[1] + 3) * 2.0**-24
    rough, turned = x.astype(np.float32), y.astype(np.float32).T
    for a in range(0, len(names), step):
        mine, cells = names[a : a + step], rough[a : a + step] @ turned
        whole = len(ids) // pieces * pieces
        if whole:  # k + 1 cosines at least are as large as the (k + 1)-th of the pieces' greatest
            most = cells[:, :whole].reshape(len(mine), -1, pieces).max(axis=1)
            least = np.partition(most, pieces - k - 1, axis=1)[:, [pieces - k - 1]]
            row, at = np.divmod(np.flatnonzero(cells >= least - margin), len(ids))  # faster than nonzero of a table
        else:
            row, at = np.indices(cells.shape).reshape(2, -1)
        other = ids[at] != mine[row]
        row, at = row[other], at[other]
        cos = np.empty(len(row))
        for c in range(0, len(row), EXACT):
            cos[c : c + EXACT] = np.einsum("ij,ij->i", x[a + row[c : c + EXACT]], y[at[c : c + EXACT]])
        order = np.lexsort((at, -np.round(cos, digits), row))  # equal ones by id
        row, at, cos = row[order], at[order], cos[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((mine[row[keep]], ids[at[keep]], cos[keep]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else (names[:0], ids[:0], np.zeros(0))


def _best(matches: DataFrame, k: int, digits: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cos", digits)), "ref_id")  # k rows a part
    return matches.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


class Search:
    """The state that tasks share: centres, the size and the greatest angle of each cluster."""

    def __init__(self, query: DataFrame, reference: DataFrame, k: int, digits: int, centres: int, block: int) -> None:
        self.k, self.slack, self.digits = k, 1.5 * 10.0**-digits, digits
        self.query, self.reference = query.select("id", "vec"), reference.select("id", "vec")
        self.kind = reference.schema["id"].dataType.simpleString()
        centres = min(centres, -(-4 * reference.count() // block))
        drawn = reference.orderBy(F.xxhash64("id"), "id").limit(centres).toPandas()
        self.centre = _unit(drawn["vec"]) if len(drawn) else np.zeros((0, 1))
        self.centre = self.centre[np.abs(self.centre).sum(axis=1) > 0]
        self.size, self.radius = {}, {}
        if len(drawn):
            sums = self._placed({}).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
            for r in sums.collect():  # one row a centre
                self.size[r.cluster], self.radius[r.cluster] = r.n, r.radius
        self.parts = {c: -(-n // block) for c, n in self.size.items()}
        self.turns = max(1, -(-query.count() // ASKING))

    def _placed(self, parts: dict[int, int]) -> DataFrame:
        """References with the cluster of their nearest centre (-1 for vectors without length), its angle, and their part of the cluster."""

        centre = self.centre

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _unit(b["vec"])
                if len(centre):
                    angle = _angles(x, centre)
                    cluster = np.where(np.abs(x).sum(axis=1) > 0, angle.argmin(axis=1), -1)
                    least = angle.min(axis=1)
                else:
                    cluster, least = np.full(len(b), -1), np.zeros(len(b))
                many = np.array([parts.get(c, 1) for c in cluster.tolist()], dtype=np.int64)
                yield pd.DataFrame({"id": b["id"], "vec": list(x), "cluster": cluster.astype(np.int32), "angle": least, "part": (b["h"].to_numpy() % many).astype(np.int32)})

        keyed = self.reference.withColumn("h", F.xxhash64("id"))
        return keyed.mapInPandas(place, f"id {self.kind}, vec array<double>, cluster int, angle double, part int")

    def asked(self, queries: DataFrame, first: bool) -> DataFrame:
        """id, vec, cluster, part, turn: the clusters nearest to each query that hold k + 1 vectors together; then all others that may
        hold a cosine as large as the k-th best so far (column `least`)."""
        clusters, centre, k, slack, parts = sorted(self.size), self.centre, self.k, self.slack, self.parts
        real = [c for c in clusters if c >= 0]
        radius, count = (np.array([of[c] for c in real]) for of in (self.radius, self.size))

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _unit(b["vec"])
                angle = _angles(x, centre)[:, real] if real else np.zeros((len(b), 0))
                best = np.cos(np.maximum(angle - radius, 0.0))
                best[np.abs(x).sum(axis=1) == 0] = 1.0
                order = np.argsort(angle, axis=1, kind="stable")
                turns, rows = b["turn"].to_numpy(), []
                for i in range(len(b)):
                    near = order[i][: int(np.searchsorted(np.cumsum(count[order[i]]), k + 1)) + 1]
                    if first:
                        take = [real[j] for j in near] + [c for c in clusters if c < 0]
                    else:
                        least = b["least"].iloc[i]
                        far = np.setdiff1d(np.arange(len(real)), near)
                        take = [real[j] for j in (far if pd.isna(least) else far[best[i][far] >= least - slack])]
                    for c in take:
                        for p in range(parts[c]):
                            rows.append((b["id"].iloc[i], x[i], c, p, turns[i]))
                            if len(rows) == TOGETHER:  # a query may ask every part, so a batch of them is not held
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

        columns = ["id", "vec", "cluster", "part", "turn"]
        dealt = queries.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(self.turns)).cast("int"))
        return dealt.mapInPandas(choose, f"id {self.kind}, vec array<double>, cluster int, part int, turn int")

    def matched(self, asked: DataFrame) -> DataFrame:
        """query_id, ref_id, cos: the best of each part for each query that asks it, itself left out."""
        k, digits = self.k, self.digits

        def match(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not (len(q) and len(r)):
                return pd.DataFrame({"query_id": q["id"].iloc[:0], "ref_id": r["id"].iloc[:0], "cos": np.zeros(0)})
            r = r.sort_values("id")
            found = _closest(np.array(q["vec"].tolist()), q["id"].to_numpy(), np.array(r["vec"].tolist()), r["id"].to_numpy(), k, digits)
            return pd.DataFrame(dict(zip(("query_id", "ref_id", "cos"), found, strict=True)))

        key = ["cluster", "part", "turn"]
        every = self._placed(self.parts).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.turns - 1))))
        both = asked.groupBy(*key).cogroup(every.select("id", "vec", *key).groupBy(*key))
        return both.applyInPandas(match, f"query_id {self.kind}, ref_id {self.kind}, cos double")

    def best(self, matches: DataFrame) -> DataFrame:
        return _best(matches, self.k, self.digits)

    def later(self, matches: DataFrame) -> DataFrame:
        """The queries with their k-th best cosine so far."""
        least = self.best(matches).groupBy("query_id").agg(F.min(F.when(F.col("position") == self.k, F.col("cos"))).alias("least"))
        return self.query.join(least, F.col("id") == F.col("query_id"), "left").select("id", "vec", "least")


def exact_nearest(query: DataFrame, reference: DataFrame, k: int, digits: int = 6, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """query_id, ref_id, cos, position: the k references (id, vec) with the largest cosine of each query, rounded to `digits`, ties by id.

    1. References gather around centres, as many as make a quarter part or more each, at most `centres`; each cluster knows its greatest angle. A cluster of any size is dealt over parts of about `block`.
    2. A query asks the nearest clusters that hold more than k vectors, and so learns a cosine that it must reach.
    3. By the triangle of angles, no vector of a cluster is nearer than the centre's angle less the greatest one. Only clusters that
       can reach the cosine are asked. The answer is that of comparing all pairs.

    A query that is a reference does not find itself. A vector without length has cosine 0 with all. Without references, no rows.
    """
    s = Search(query, reference, k, digits, centres, block)
    if not s.size:
        return query.sparkSession.createDataFrame([], f"query_id {s.kind}, ref_id {s.kind}, cos double, position int")
    one = s.matched(s.asked(s.query, True))
    two = s.matched(s.asked(s.later(one), False))
    return s.best(one.union(two))


def all_nearest(vectors: DataFrame, k: int, digits: int = 6, held: int = HELD_BYTES, spread: int = SPREAD) -> DataFrame:
    """query_id, ref_id, cos, position: `exact_nearest` where every vector (id, vec) asks all the others.

    Blocks of about `held` bytes, dealt by hash, meet in pairs: each two once, for the queries of both. A task holds two blocks and
    hands on k rows a vector; each vector is copied once a block. All pairs are compared, so time grows with their number.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    v = vectors.select("id", "vec").filter("id is not null")
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n * 8 * (width or 1) // held), min(spread, -(-n // BLOCK)))
    own, other = F.col("block"), F.col("other")
    dealt = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.select("id", "vec", "block", F.least(own, other).alias("a"), F.greatest(own, other).alias("b"))
    met = met.repartition(3 * blocks * (blocks + 1) // 2, "a", "b")  # pairs are few bytes for their work: Spark would put many in a task

    def match(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x, at = t["id"].to_numpy(), unit_rows(t["vec"]), t["block"].to_numpy()
        a, b = (np.flatnonzero(at == c.as_py()) for c in key)
        sides = [(q, r) for q, r in ([(a, b), (b, a)] if key[0] != key[1] else [(a, a)]) if len(q) and len(r)]
        found = [_closest(x[q], ids[q], x[r], ids[r], k, digits) for q, r in sides] or [(ids[:0], ids[:0], np.zeros(0))]
        query, ref, cos = (np.concatenate(part) for part in zip(*found, strict=True))
        kept = t.schema.field("id").type
        return pa.table({"query_id": pa.array(query, kept), "ref_id": pa.array(ref, kept), "cos": cos})

    return _best(met.groupBy("a", "b").applyInArrow(match, f"query_id {kind}, ref_id {kind}, cos double"), k, digits)


def searched(query: DataFrame, reference: DataFrame, k: int, digits: int = 6, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """query_id, searched, of: how many parts of clusters exact_nearest compares with each query, of how many there are."""
    s = Search(query, reference, k, digits, centres, block)
    first = s.asked(s.query, True)
    asked = first.union(s.asked(s.later(s.matched(first)), False))
    return asked.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("searched"), F.lit(sum(s.parts.values())).alias("of"))
