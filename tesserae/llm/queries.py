"""Thin queries over the driver's tables, one for each corpus operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.block_dedup import substring_dedup
from tesserae.llm.conversations import audit_conversations
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.jaccard_join import jaccard_join
from tesserae.llm.language import fit_language_models, held_out, identify
from tesserae.llm.licenses import license_scan
from tesserae.llm.line_dedup import line_dedup
from tesserae.llm.merkle import fold, leaf_digest, merkle_manifest
from tesserae.llm.packing import pack
from tesserae.llm.suffix_dedup import suffix_dedup
from tesserae.llm.token_counts import token_counts
from tesserae.llm.token_files import read_token_files, write_token_files


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir), width=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir)).drop("removed")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(_read(spark, sf_dir))
    names = F.array_join("licenses", ",").alias("licenses")
    return out.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_known"), names, "permissive")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    found = identify(docs, fit_language_models(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_read(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir), _read(spark, sf_dir, "benchmark")).drop("hit_spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def damaged(rows: DataFrame) -> DataFrame:
    """One conversation row in twenty each dropped, emptied, stripped of its closing signs, repeated, or given to the user."""
    full = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return full.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    found = audit_conversations(damaged(rows)).withColumnRenamed("conv_id", "found")
    whole = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    out = merkle_manifest(docs, extra={"tampered": tampered}).withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    siblings = F.concat_ws("", F.transform("proof", lambda s: s["siblings"]))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_license_scan": op5_license_scan,
        "op7_language_id": op7_language_id,
        "op6_token_files": op6_token_files,
        "op8_pack": op8_pack,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_counts": op10_token_counts,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM w, unnest(range(greatest(1, len(w) - 3))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i AS pos, array_to_string(l[i + 1:i + 3], chr(10)) AS g FROM d, unnest(range(greatest(0, len(l) - 2))) t(i)),
later AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(pos, pos + 3)) t(p)),
lines AS (SELECT doc_id, i, l[i + 1] AS line FROM d, unnest(range(len(l))) t(i)),
kept AS (SELECT * FROM lines WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = lines.doc_id AND gone.p = lines.i)),
per AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept_text FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(per.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(per.kept_text, '')) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""


# Written by hand, and not from the operator's table: what a line of the tables says and which licence that is.
OP5_SQL = r"""
WITH named(line, license, nth, free) AS (VALUES
  ('licensed under the apache license, version 2.0', 'Apache-2.0', 1, true), ('released under the mit license', 'MIT', 2, true), ('licensed under the mit license', 'MIT', 2, true),
  ('this work is licensed under the gnu general public license, version 3', 'GPL-3.0-only', 3, false), ('licensed under cc by-nc 4.0', 'CC-BY-NC-4.0', 4, false),
  ('licensed under cc by-sa 4.0', 'CC-BY-SA-4.0', 5, false), ('licensed under cc by 4.0', 'CC-BY-4.0', 6, true), ('all rights reserved', 'LicenseRef-all-rights-reserved', 7, false)),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
parts AS (SELECT doc_id, trim(lower(unnest(regexp_split_to_array(line, '[.!?;:]+(\s+|$)')))) AS part FROM lines),
hits AS (SELECT doc_id, license, nth, free FROM parts JOIN named ON part = named.line),
sums AS (SELECT doc_id, count(*) AS n, bool_and(free) AS free FROM hits GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(license, ',' ORDER BY nth) AS licenses FROM (SELECT DISTINCT doc_id, license, nth FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(licenses, '') AS licenses, coalesce(free, false) AS permissive
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
sized AS (SELECT id, w, i, least(10, len(w)) AS k FROM words, unnest(range(greatest(1, len(w) - 9))) t(i) WHERE kind = 'b' AND len(w) > 0),
win AS (SELECT DISTINCT id AS item, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM sized),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT id, i, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM words, sizes, unnest(range(greatest(0, len(w) - k + 1))) t(i) WHERE kind = 'd'),
found AS (SELECT g.id, g.i, g.k, win.item FROM grams g JOIN win ON g.k = win.k AND g.g = win.g),
hit AS (SELECT id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + k)) t(p) GROUP BY id),
items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit ON hit.id = w.id LEFT JOIN items ON items.id = w.id WHERE w.kind = 'd'
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda x, b: {byte}), 4294967295)"


def _leaf_sql(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + "))"


OP13_SQL = f"""
WITH RECURSIVE docs AS (SELECT *, {_leaf_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
  {_leaf_sql("doc_id", "source", "lang", "n_chars", f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS tampered FROM documents),
leaves AS (SELECT doc_id, source, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
nodes AS (SELECT source, pos, leaf AS digest, 0 AS lvl FROM leaves
  UNION ALL SELECT source, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), lvl + 1
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) WHERE n > 1 GROUP BY source, pos // 16, lvl),
tops AS (SELECT source, max(lvl) AS height FROM nodes GROUP BY source),
subs AS (SELECT n.source, n.digest, row_number() OVER (ORDER BY n.source NULLS FIRST) - 1 AS pos
  FROM nodes n JOIN tops t ON n.source IS NOT DISTINCT FROM t.source AND n.lvl = t.height),
upper_nodes AS (SELECT pos, digest, 0 AS lvl FROM subs
  UNION ALL SELECT pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), lvl + 1
  FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY pos // 16, lvl),
peak AS (SELECT max(lvl) AS height FROM upper_nodes),
runs AS (SELECT source, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS d FROM nodes GROUP BY source, lvl, pos // 16),
upper_runs AS (SELECT lvl, pos // 16 AS run, list(digest ORDER BY pos) AS d FROM upper_nodes GROUP BY lvl, pos // 16),
steps AS (SELECT l.source, l.pos, r.lvl AS k, (l.pos // (16 ** r.lvl)::BIGINT) % 16 AS i, r.d
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
  JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND r.lvl < t.height AND r.run = l.pos // (16 ** (r.lvl + 1))::BIGINT
  UNION ALL SELECT l.source, l.pos, 1000 + r.lvl, (s.pos // (16 ** r.lvl)::BIGINT) % 16, r.d
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source, peak
  JOIN upper_runs r ON r.lvl < peak.height AND r.run = s.pos // (16 ** (r.lvl + 1))::BIGINT),
paths AS (SELECT source, pos, list({{'i': i, 'd': d}} ORDER BY k) AS path FROM steps GROUP BY source, pos),
folded AS (SELECT l.doc_id, l.source, l.leaf, p.path, l.tampered AS digest, 1 AS up
  FROM leaves l LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
  UNION ALL SELECT doc_id, source, leaf, path, sha256(array_to_string(list_concat(list_slice((path[up]).d, 1, (path[up]).i), list_value(digest), list_slice((path[up]).d, (path[up]).i + 2, 16)), '')), up + 1
  FROM folded WHERE up <= len(path))
SELECT f.doc_id, f.leaf, s.digest AS subroot, u.digest AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: array_to_string(list_concat(list_slice(x.d, 1, x.i), list_slice(x.d, x.i + 2, 16)), '')), ''), '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = u.digest AS verified
FROM folded f JOIN subs s ON s.source IS NOT DISTINCT FROM f.source, upper_nodes u, peak
WHERE u.lvl = peak.height AND f.up = coalesce(len(f.path), 0) + 1
"""


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) t(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS r,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS sign FROM n),
g AS (SELECT *, CASE WHEN sign = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN sign NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'r': r, 'f': fault, 'role': role, 'text': text}} ORDER BY i) AS all_rows FROM g GROUP BY conv_id),
best(conv_id, all_rows, i, state, cost, audit, body) AS (
  SELECT conv_id, all_rows, 1, '', 0, '', '' FROM sums
  UNION ALL
  SELECT b.conv_id, b.all_rows, b.i + 1, w.state, min(b.cost + w.cost), arg_min(b.audit || w.edit, {{'c': b.cost + w.cost, 'a': b.audit || w.edit}}),
    arg_min(b.body || w.body, {{'c': b.cost + w.cost, 'a': b.audit || w.edit}})
  FROM best b, LATERAL (
    WITH x AS (SELECT (b.all_rows[b.i]).r AS r, (b.all_rows[b.i]).f AS f, (b.all_rows[b.i]).text AS t, (b.all_rows[b.i]).role AS role, chr(10) AS nl),
    ins AS (SELECT unnest([0, 1, 2]) AS k),
    p AS (SELECT k, CASE WHEN k = 0 THEN b.state WHEN (k = 1) = (b.state <> 'u') THEN 'u' ELSE 'a' END AS s,
      CASE WHEN k = 0 THEN '' WHEN b.state <> 'u' THEN 'user:' || chr(10) || CASE k WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END
        ELSE 'assistant:' || chr(10) || CASE k WHEN 2 THEN 'user:' || chr(10) ELSE '' END END AS added FROM ins)
    SELECT s AS state, 3 * k + 4 AS cost, repeat('I', k) || 'D' AS edit, added AS body FROM p, x
    UNION ALL SELECT CASE WHEN s = 'u' THEN 'a' ELSE 'u' END, 3 * k + 3 + CASE f WHEN 'truncated' THEN 3 ELSE 0 END, repeat('I', k) || 'R',
      added || CASE WHEN s = 'u' THEN 'assistant' ELSE 'user' END || ':' || t || nl FROM p, x WHERE f IN ('', 'truncated')
    UNION ALL SELECT r, 3 * k + CASE f WHEN 'truncated' THEN 3 ELSE 0 END, repeat('I', k) || 'K', added || role || ':' || t || nl
      FROM p, x WHERE f IN ('', 'truncated') AND (s || r IN ('s', 'u', 'su', 'ua', 'au'))
  ) w WHERE b.i <= len(b.all_rows) GROUP BY b.conv_id, b.all_rows, b.i, w.state),
ends AS (SELECT conv_id, cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost,
  audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
  body || CASE state WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS body
  FROM best WHERE i = len(all_rows) + 1),
picked AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(body, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN picked p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS g FROM w, unnest(range(greatest(0, len(w) - 34))) t(i)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(i, i + 35)) t(p)),
places AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, list_filter(range(len(w.w)), lambda i: places IS NULL OR NOT list_contains(places, i)) AS k FROM w LEFT JOIN places p ON p.doc_id = w.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - len(k.k))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(k.k, lambda i: w.w[i + 1]), ' '), '')) AS kept_sha256
FROM w JOIN kept k ON k.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_license_scan": OP5_SQL, "op9_decontaminate": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
