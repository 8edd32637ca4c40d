"""Repair of conversation structure: distinct signatures are solved once, their audits are joined back and replayed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.llm.common import bound_batches, ordered, shuffle_width, stored

PIECE = 128  # rows of a signature
# What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States between rows: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
MOST_INSERTS = 2  # three in a row would do no more than one


def last_sign(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)


def solve(signature: str) -> list[tuple[int, int, int, str]]:
    """Cheapest edits of a piece for each state before and after it: entry, exit, cost, audit; ties go to the least audit.

    One sign a row: s, u, a or o (any other role), in upper case where the text is truncated, x for a row that must go.
    Inserted rows stand before a row of the piece; what closes a conversation comes after its last piece.
    """

    @lru_cache(maxsize=None)
    def best(i: int, state: int, exit_: int, inserts: int) -> tuple[int, str] | None:
        if i == len(signature):
            return (0, "") if state == exit_ and not inserts else None
        sign = signature[i]
        ways = [(DELETE, "D", state)]
        if sign != "x":
            extra = TRUNCATED if sign.isupper() else 0
            if (kept := AFTER.get((state, sign.lower()))) is not None:
                ways.append((extra, "K", kept))
            ways.append((REROLE + extra, "R", AFTER[state, WANTED[state]]))
        found = [(cost + rest[0], edit + rest[1]) for cost, edit, then in ways if (rest := best(i + 1, then, exit_, 0))]
        if inserts < MOST_INSERTS and (rest := best(i, AFTER[state, WANTED[state]], exit_, inserts + 1)):
            found.append((INSERT + rest[0], "I" + rest[1]))
        return min(found, default=None)

    return [(a, b, *found) for a in range(4) for b in range(4) if (found := best(0, a, b, 0))]


def join_pieces(tables: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cheapest whole audit from the tables of a conversation's pieces, in order."""
    reached = {NOTHING: (0, "")}
    for table in tables:
        then: dict[int, tuple[int, str]] = {}
        for a, b, cost, audit in table:
            if a in reached:
                way = (reached[a][0] + cost, reached[a][1] + audit)
                if b not in then or way < then[b]:
                    then[b] = way
        reached = then
    return min((cost + INSERT * len(CLOSING[s]), audit + CLOSING[s]) for s, (cost, audit) in reached.items())


WAYS = "array<struct<a: int, b: int, cost: int, audit: string>>"
WAYS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = [[dict(zip(("a", "b", "cost", "audit"), w, strict=True)) for w in solve(s)] for s in batch["signature"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["signature"], pa.array(ways, WAYS_ARROW)], names=["signature", "ways"])


class Replay:
    """One conversation at a time: the tables of its pieces, then its rows, which are edited as they pass by.

    One table a piece, the audit and a running digest are held; texts are not.
    """

    def __init__(self, conv) -> None:
        self.conv, self.tables, self.audit, self.cost = conv, [], None, 0
        self.at, self.state, self.last, self.illegal, self.written, self.digest = 0, NOTHING, None, 0, 0, hashlib.sha256()

    def begin(self) -> None:
        if self.audit is None:
            self.cost, self.audit = join_pieces([(w["a"], w["b"], w["cost"], w["audit"]) for w in t] for t in self.tables)

    def put(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.state = AFTER[self.state, role[:1]]
        self.written += 1
        return self.conv, self.written, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.put(NAMES[WANTED[self.state]], "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        self.begin()
        yield from self.inserted()
        if self.last is not None:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last, edit = role[:1], self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.put(NAMES[WANTED[self.state]] if edit == "R" else role, text, edit)

    def close(self) -> Iterator[tuple]:
        self.begin()
        yield from self.inserted()


def _replay(rows_wanted: bool, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Replay | None = None
        done: list[tuple] = []

        def finish() -> None:
            rows = list(now.close())
            done.extend(rows if rows_wanted else [(now.conv, now.illegal, now.cost, now.audit, now.digest.hexdigest())])

        for batch in batches:
            for conv, ways, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "ways", "role", "text")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        finish()
                    now = Replay(conv)
                if ways is not None:
                    now.tables.append(ways)
                    continue
                for r in now.row(role, text):
                    if rows_wanted:
                        done.append(r)
            yield _batch(done, out)
            done = []
        if now is not None:
            finish()
        yield _batch(done, out)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _faulted(table: DataFrame) -> DataFrame:
    """Adds the first fault of each row and its sign. Of rows with equal role and text, the first of a conversation is no duplicate:
    a sum of least numbers tells which, so that no group of equal rows meets in one task."""
    same = ["conv", "role", F.sha2("text", 256)]
    firsts = table.groupBy(*same).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    sign = last_sign(F.col("text"))
    slim = table.select("at", "conv", F.substring("role", 1, 1).alias("initial"), (sign == "").alias("blank"), (~sign.isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    rows = slim.join(firsts, "at", "left").select("at", "conv", initial.alias("initial"), fault.alias("fault"))
    shown = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return rows.select("at", "conv", "fault", shown.alias("sign"))


def _edited(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in order, the pieces with their counts, and what a replay reads: tables of pieces and rows by conversation."""
    bound_batches(rows.sparkSession)
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    keys = ["conv", "turn", "role", "text"]
    table = ordered(own, [*keys[:3], F.substring("text", 1, 48)], keys)
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in FAULTS]
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sign"))), lambda x: x["sign"]), "")
    pieces = stored(_faulted(table).groupBy("conv", F.floor(F.col("at") / PIECE).alias("piece")).agg(signs.alias("signature"), *counts))
    # The floor keeps a conversation's pieces in order; a signature has at most PIECE signs.
    spread = pieces.select("signature").distinct().repartition(shuffle_width(rows))  # few after the distinct, each dear
    solved = stored(spread.mapInArrow(_solve_all, f"signature string, ways {WAYS}"))
    heads = pieces.join(solved, "signature").select("conv", F.lit(0).alias("kind"), F.col("piece").alias("at"), "ways", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = table.select("conv", F.lit(1).alias("kind"), "at", F.lit(None).cast(WAYS).alias("ways"), "role", "text")
    dealt = heads.union(body).repartition(shuffle_width(rows), "conv").sortWithinPartitions("conv", "kind", "at")
    return table, pieces, dealt.select("conv", "ways", "role", "text")


def _schema(frame: DataFrame, rest: list[tuple[str, pa.DataType]]) -> pa.Schema:
    kind = to_arrow_type(frame.schema["conv"].dataType)
    return pa.schema([("conv", kind), *rest])


def audit_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn (nulls first), then role and text. A row's first fault counts: blank, duplicate of an earlier row, or
    truncated (no closing sign). The audit is the cheapest sequence of edits (Keep, Rerole, Delete, Insert) that makes the role
    initials `(s?(ua)+)?`, the least in ASCII of equally cheap ones.

    1. Sampled ranges put the rows in order; a conversation that holds a third of them is spread over many ranges.
    2. Each run of at most 128 rows becomes a signature, a sign for role and fault. Distinct signatures are solved once, by memoised
       recursion, for every state before and after, and joined back to the runs that have them.
    3. The tables of a conversation's runs and its rows stream through one task by conversation, since its digest is of one
       text from end to end: tables give the audit, rows are edited and digested as they pass, and no text is held.

    Null role or text is one space, null ids form one conversation, null turns count for nothing in gaps. Repeated rows are
    duplicates. An empty table gives an empty result; other columns are ignored.
    """
    table, pieces, stream = _edited(rows, conv_col, turn_col, role_col, text_col)
    kind = table.schema["conv"].dataType.simpleString()
    text = pa.string()
    schema = _schema(table, [("illegal", pa.int64()), ("cost", pa.int64()), ("audit", text), ("repaired_sha256", text)])
    audits = stream.mapInArrow(_replay(False, schema), f"conv {kind}, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint")
    turns = table.groupBy(F.col("conv").alias("conv_t")).agg(gaps.alias("gaps"))
    faults = pieces.groupBy(F.col("conv").alias("conv_p")).agg(*[F.sum(f).alias(f) for f in FAULTS])
    out = audits.join(turns, F.col("conv").eqNullSafe(F.col("conv_t"))).join(faults, F.col("conv").eqNullSafe(F.col("conv_p")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows of audit_conversations' edits: conv_id, nth (from 1), role, text, edit (K, R or I)."""
    table, _, stream = _edited(rows, conv_col, turn_col, role_col, text_col)
    kind = table.schema["conv"].dataType.simpleString()
    schema = _schema(table, [("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return stream.mapInArrow(_replay(True, schema), f"conv {kind}, nth bigint, role string, text string, edit string").withColumnRenamed("conv", "conv_id")
