"""N-gram Jaccard self-join by signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, discard, id_and_text, shuffle_width, stored
from tesserae.llm.components import components
from tesserae.llm.shingles import batches_of_sets, digests, mix

WIDTH = 5
PERCENT = 80
TILE_DOCS = 256
TILE_SHINGLES = 2_000_000
FANOUT = 8
SAMPLE, SAMPLED_OFTEN = 0.01, 50  # keys that 50 of a hundredth of the rows have do not meet in one window
SEEN_SETS = 100_000  # sets whose keys a task remembers to have sent


class Classes:
    """Size classes of sets and, for each, how pairs are found whose larger set is in it.

    Sets of sizes a and b with Jaccard of percent / 100 or more differ in at most d = (a + b)(100 - percent) / (100 + percent)
    elements. So of any d + 1 segments of the hash range they agree on one, and sets that agree on a segment get the same key;
    `cuts` is the number of segments. They also have at least `common(n)` hashes in common, n the larger size, so the set of n loses n - common(n)
    at most, and the `together` least of the common hashes are among the first n - common(n) + together of each set.
    """

    def __init__(self, percent: int, largest: int):
        self.percent, lows = percent, [1]
        while lows[-1] <= largest * 100 // percent + 1:
            lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
        self.low = np.array(lows, dtype=np.int64)
        top = self.low[1:] - 1
        self.cuts = (self.apart(top, top) + 1) * 13 // 10 + 1
        lost = top - self.common(top)
        self.small = lost <= 3
        self.together = np.minimum(np.array([8, 8, 4, 3, 2])[np.minimum(lost, 4)], self.common(self.low[:-1]))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def common(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.percent // 100)


def routing_keys(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys such that any two different sets that link share one; and the set that each key belongs to.

    For every class that the larger set of a pair may be in, a set emits its first d + 1 segments that hold two hashes or more:
    of a pair, the set whose segments end first finds an agreement among its own. A set without so many is poor: it emits all such segments that
    it has, which serves for partners that are not poor, and for those that are the keys that small sets have: all choices of
    `together` among its least hashes. Segments with fewer hashes, which unrelated sets share, are no keys. A set that only
    equal ones could match emits nothing.
    """
    n = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    plan = Classes(percent, int(n.max()))
    doc = np.repeat(np.arange(len(n)), n)
    most = n * 100 // percent
    home = np.searchsorted(plan.low, n, side="right") - 1
    keys, owners = [], []
    step = 0
    while True:
        level = np.minimum(home + step, len(plan.cuts) - 1)
        d = plan.apart(n, np.minimum(most, plan.low[level + 1] - 1))
        use = (n > 0) & (d > 0) & (home + step < len(plan.cuts)) & ((step == 0) | (plan.low[level] <= most))
        if step and not use.any():
            break
        poor = use & plan.small[level]
        mine = (use & ~poor)[doc]
        h, owner = hashes[mine], doc[mine]
        if len(h):
            segment = ((h >> np.uint64(32)) * plan.cuts[level].astype(np.uint64)[owner]) >> np.uint64(32)
            new = np.ones(len(h), dtype=bool)
            new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            who = owner[first]
            name = mix(level[who].astype(np.uint64) << np.uint64(32) | segment[first], 31)
            key = mix(np.add.reduceat(mix(h, 32), first) + name, 33)
            full = size >= 2
            upto = np.concatenate(([0], np.cumsum(full)))
            begin = np.searchsorted(who, who, side="left")
            nth = upto[1:] - upto[begin]
            have = np.bincount(who, weights=full, minlength=len(n)).astype(np.int64)
            few = use & ~poor & (have < d + 1)
            take = full & ((nth <= d[who] + 1) | few[who])
            keys.append(key[take])
            owners.append(who[take])
            poor = poor | few
        if poor.any():
            for k, o in _choices(hashes, bounds, np.flatnonzero(poor), level, plan):
                keys.append(k)
                owners.append(o)
        step += 1
    return np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]).astype(np.int64)


def _choices(hashes: np.ndarray, bounds: np.ndarray, sets: np.ndarray, level: np.ndarray, plan: Classes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sets at a level: a key for every choice of `together` among the least hashes, and the sets these belong to."""
    n, at = np.diff(bounds)[sets], level[sets]
    together = plan.together[at]
    upto = n - plan.common(np.maximum(n, plan.low[at])) + together
    for length, k in np.unique(np.column_stack((upto, together)), axis=0).tolist():
        own = np.flatnonzero((upto == length) & (together == k))
        least = mix(hashes[bounds[:-1][sets[own]][:, None] + np.arange(length)], 34)
        pick = np.array(list(combinations(range(length), k)), dtype=np.int64)
        name = mix(at[own].astype(np.uint64), 35)[:, None]
        total = np.tile(name, (1, len(pick)))
        for c in pick.T:
            total += least[:, c]
        yield mix(total, 36).ravel(), np.repeat(sets[own], len(pick))


class SignatureTree:
    """Levels of nodes over sets; a node has the OR of its sets' token bitmaps, their range of sizes and the most tokens that
    any of them has beyond its distinct bits."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        self.order = np.lexsort(([s[0] for s in sets], n))
        bits = int(min(1 << 14, max(256, 1 << int(4 * np.median(n)).bit_length())))
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for row, i in enumerate(self.order.tolist()):
            b = sets[i] & np.uint64(bits - 1)
            np.bitwise_or.at(maps[row], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        size = n[self.order]
        spare = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, spare)]
        while len(self.levels[-1][0]) > FANOUT:
            m, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at))
            )

    def _possible(self, level: int, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        maps, lo, hi, spare = self.levels[level]
        ok = (100 * hi[u] >= percent * lo[v]) & (100 * hi[v] >= percent * lo[u])
        w = np.flatnonzero(ok)
        for a in range(0, len(w), 1 << 14):
            k = w[a : a + (1 << 14)]
            x, y = u[k], v[k]
            most = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            ok[k] = (100 + percent) * most >= percent * (lo[x] + lo[y])
        return ok

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that the dual traversal could not rule out, as input positions."""
        top = len(self.levels) - 1
        u, v = np.triu_indices(len(self.levels[top][0]))
        for level in range(top, -1, -1):
            keep = self._possible(level, u, v, percent)
            u, v = u[keep], v[keep]
            if level:
                k, below = np.arange(FANOUT), len(self.levels[level - 1][0])
                x = np.repeat(u[:, None] * FANOUT + k, FANOUT, axis=1).ravel()
                y = np.tile(v[:, None] * FANOUT + k, (1, FANOUT)).ravel()
                inside = (x < below) & (y < below) & (x <= y)
                u, v = x[inside], y[inside]
        pair = u < v
        return self.order[u[pair]], self.order[v[pair]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def join_tile(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """Labels after linking: sets with equal labels are linked directly or through others of the tile or before."""
    labels = labels.copy()
    u, v = SignatureTree(sets).candidates(percent)
    while len(u):
        apart = labels[u] != labels[v]
        u, v = u[apart], v[apart]
        for i, j in zip(u[:256].tolist(), v[:256].tolist(), strict=True):
            if labels[i] != labels[j] and linked(sets[i], sets[j], percent):
                labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
        u, v = u[256:], v[256:]
    return labels


def _router(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, z, hashes, bounds in batches_of_sets(batch["text"], width):
                one, two = digests(hashes, bounds)
                keys, owner = routing_keys(hashes, bounds, percent)
                # Equal sets have equal keys: a task sends those of a set once, as long as it remembers it.
                if len(seen) > SEEN_SETS:
                    seen.clear()
                fresh = np.zeros(z - a, dtype=bool)
                for i, name in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    fresh[i] = name not in seen
                    seen.add(name)
                keys, owner = keys[fresh[owner]], owner[fresh[owner]]
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(z - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, z - a), pa.array(np.diff(bounds), pa.int64()), pa.array(one), pa.array(two),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return run


def _tile_joiner(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, sets, labels = None, [], [], []

        def finish() -> list[tuple[int, int]]:
            if len(docs) < 2:
                return []
            known: dict[int, int] = {}
            start = np.array([known.setdefault(x, i) for i, x in enumerate(labels)])
            end = join_tile(sets, start, percent)
            return [(docs[r], docs[i]) for i, (s, r) in enumerate(zip(start.tolist(), end.tolist(), strict=True)) if s != r]

        for batch in batches:
            links: list[tuple[int, int]] = []
            tile = list(zip(*(batch[c].to_pylist() for c in ("center", "lo", "hi")), strict=True))
            ids, marks = batch["rep"].to_pylist(), batch["label"].to_pylist()
            want = list(zip(batch["d1"].to_pylist(), batch["d2"].to_pylist(), strict=True))
            for a, z, hashes, bounds in batches_of_sets(batch["text"], width):
                one, two = digests(hashes, bounds)
                for i in range(a, z):
                    if tile[i] != current:
                        links += finish()
                        current, docs, sets, labels = tile[i], [], [], []
                    if (one[i - a], two[i - a]) == want[i]:  # an id that several texts have brings all of them
                        docs.append(ids[i])
                        sets.append(hashes[bounds[i - a] : bounds[i - a + 1]].copy())
                        labels.append(marks[i])
            yield _links(links)
        yield _links(finish())

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
    tile_docs: int = TILE_DOCS, tile_shingles: int = TILE_SHINGLES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; two documents link when their sets of `width`-word shingles
    have a Jaccard similarity of percent / 100 or more, and component_id is the smallest id reachable by links.

    1. Each text becomes a set of 64-bit shingle hashes. Equal sets (128-bit digest) are one class from here on.
    2. Routing: keys by the pigeonhole rule (see routing_keys) bring any two different sets that link to a common centre, the
       least class that shares the key. No key brings out pairs: a class goes to its few centres.
    3. The classes of a centre form tiles of bounded size, over each of which a signature tree is built and traversed against
       itself; pairs that its bounds leave are compared in full unless they are connected already. The centre is in each of its
       tiles. Pairs of tiles of one centre are joined as well, where they hold classes outside the largest component.
    4. Components of the links, by contraction.

    Null and wordless texts have empty sets that link with nothing. Fewer than `width` words are one shingle. Repeated rows
    each get a row. Rows with a null id get a row and its class's component, but do not give a component its id; a class of null
    ids only links with nothing. An empty table gives an empty result.
    """
    parts = shuffle_width(docs)
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    keyed = stored(rows.mapInArrow(_router(width, percent), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    base = stored(keyed.drop("keys"))
    classes = base.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    routed = keyed.select(F.explode("keys").alias("key"), F.col("d1").alias("node"))
    edges = _to_centers(routed).distinct()
    members = edges.union(edges.select(F.col("center").alias("node"), "center")).distinct()
    members = cut(
        members.join(classes.filter("rep is not null"), F.col("node") == F.col("d1")).select(
            "center", (F.col("node") == F.col("center")).alias("is_center"), "rep", "d1", "d2", "n_shingles"
        )
    )
    discard(keyed)  # the keys are most of what is written, and no later step reads them
    need = F.ceil(F.greatest(F.count(F.lit(1)) / tile_docs, F.sum("n_shingles") / tile_shingles)).cast("int")
    # Only centres that fill several tiles are joined back, as rows of their own, so that Spark can split the join at one of them.
    several = cut(members.groupBy("center").agg(need.alias("tiles")).filter("tiles > 1"))
    placed = members.join(several, "center", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    spread = F.when(F.col("is_center"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    first = placed.withColumn("lo", F.explode(spread)).select("center", "lo", F.col("lo").alias("hi"), "rep", "d1", "d2", F.col("rep").alias("label"))
    links = cut(_join_tiles(rows, first, parts, width, percent))
    found = components(links)
    if not several.isEmpty():
        second = _tile_pairs(placed.filter("tiles > 1"), found)
        links = cut(links.union(_join_tiles(rows, second, parts, width, percent)))
        found = components(links)
    home = classes.join(found, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    own = base.select("doc_id", "n_shingles", "d1", "d2").join(home, ["d1", "d2", "n_shingles"], "left")
    return own.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _to_centers(routed: DataFrame) -> DataFrame:
    """node, center: every class and, for each of its keys, the least class with that key, where that is another one.

    The rows of a key meet in a window. Keys that a sample finds to be frequent go another way to the same result: their least classes
    come from an aggregation that combines before it shuffles, and join back as a table whose size Spark knows.
    """
    frequent = routed.sample(SAMPLE, 7).groupBy("key").count().filter(F.col("count") >= SAMPLED_OFTEN).select("key")
    frequent = stored(frequent)
    center = F.min("node").over(Window.partitionBy("key")).alias("center")
    if frequent.isEmpty():
        return routed.select("node", center).filter("node != center")
    few = routed.join(frequent, "key", "left_anti").select("node", center)
    many = routed.join(frequent, "key", "left_semi")
    least = stored(many.groupBy("key").agg(F.min("node").alias("center")))
    return few.union(many.join(least, "key").select("node", "center")).filter("node != center")


def _join_tiles(rows: DataFrame, placed: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """Links within tiles; texts come to them by document, once for each tile that needs them.

    Places are written first: with their size known, Spark need not move the texts of all documents to few of them.
    """
    placed = stored(placed)
    needed = stored(placed.select(F.col("rep").alias("doc_id")).distinct())
    texts = rows.join(needed, "doc_id", "left_semi").join(placed, F.col("doc_id") == F.col("rep")).select("center", "lo", "hi", "rep", "d1", "d2", "label", "text")
    dealt = texts.repartition(parts, "center", "lo", "hi").sortWithinPartitions("center", "lo", "hi", "rep")
    return dealt.mapInArrow(_tile_joiner(width, percent), "u bigint, v bigint")


def _tile_pairs(large: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of tiles of a centre of which either holds a class outside the centre's largest component."""
    rows = large.join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    sizes = rows.groupBy("center", "label").count()
    main = sizes.groupBy("center").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rows = rows.join(main, "center")
    odd = rows.filter("label != main").select("center", F.col("tile").alias("odd")).distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = odd.join(large.select("center", "tiles").distinct(), "center").select("center", "odd", other).filter("odd != other")
    pairs = pairs.select("center", F.least("odd", "other").alias("lo"), F.greatest("odd", "other").alias("hi")).distinct()
    sides = pairs.withColumn("tile", F.explode(F.array("lo", "hi")))
    return rows.join(sides, ["center", "tile"]).select("center", "lo", "hi", "rep", "d1", "d2", "label")
