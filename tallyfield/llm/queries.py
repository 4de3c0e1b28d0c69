"""The registered queries of the text operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tallyfield.llm.chat_format import rotate
from tallyfield.llm.common import read, stash
from tallyfield.llm.html_extraction import extract_pages
from tallyfield.llm.line_dedup import dedup_lines
from tallyfield.llm.mixing import mix_sources, words
from tallyfield.llm.ngram_join import jaccard_components
from tallyfield.llm.packing import pack_documents
from tallyfield.llm.prefix_trie import prefix_trie
from tallyfield.llm.quality_classifier import classify_quality
from tallyfield.llm.quality_rules import quality_rules
from tallyfield.llm.spotsigs import neighbour_fingerprints
from tallyfield.llm.structure_repair import repair
from tallyfield.llm.substring_dedup import dedup_substrings
from tallyfield.llm.toxicity import score_toxicity
from tallyfield.llm.turns import hashed


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs.select("doc_id", "source", words(F.col("text")).alias("size"))).drop("copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text left, and the byte spans cut out of it."""
    return dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(read(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", mask)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), corpus_pipeline.tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is left, of each document (null text: empty)."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that op13 is given to mend; nulls are one space in role and text."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every original conversation; one that the damage left without rows has zeros."""
    convs = read(spark, sf_dir, "conversations")
    rows = damaged(convs)
    report, turns = repair(rows)
    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    mended = hashed(lines, ["conv_id"], ["place"], "line", "\n")
    # distinct turns first, so that a long conversation's are counted by many tasks
    numbers = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = convs.select(F.col("conv_id").alias("of")).distinct()
    for part in (stash(report), numbers, mended):
        out = out.join(part, F.col("of").eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def crc_sql(text: str) -> str:
    """crc32 of an ASCII string in DuckDB, which has no such function."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda t: CAST(ascii(t) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {letters}), lambda c, b: {byte}), 4294967295)"


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_mixing, op4_substring_dedup, op5_ngram_join, op6_chat_format, op7_quality_rules, op8_html_extraction, op9_packing, op10_quality_classifier, op11_line_dedup, op12_prefix_trie, op13_structure_repair)} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op6_chat_format": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text,
                  coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS segment, row_number() OVER () AS n FROM conversations),
p AS (SELECT DISTINCT conv_id AS of, role AS participant FROM r WHERE role <> 'system'),
x AS (SELECT r.*, participant,
             CASE WHEN role = 'system' THEN '<|system|>' WHEN role = participant THEN '<|assistant|>'
                  ELSE '<|user:' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') || '|>' END || chr(10) AS head
      FROM r JOIN p ON conv_id IS NOT DISTINCT FROM of),
y AS (SELECT *, length(head) + length(text) + 8 AS size FROM x),
z AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, segment, participant
                                ORDER BY turn NULLS FIRST, role, text, n ROWS UNBOUNDED PRECEDING) AS upto FROM y),
g AS (SELECT conv_id, segment, participant,
             string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text, n) AS text,
             coalesce(string_agg(CASE WHEN role = participant THEN CAST(CAST(upto - size + length(head) AS BIGINT) AS VARCHAR)
                      || '-' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role, text, n), '') AS mask,
             count(*) AS n_turns,
             CAST(sum(CASE WHEN role = participant THEN size - length(head) - 1 ELSE 0 END) AS BIGINT) AS n_masked
      FROM z GROUP BY conv_id, segment, participant)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY segment
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g
""",
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
""",
    "op12_prefix_trie": rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM k),
n AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM o GROUP BY conv_id),
c AS (SELECT n.*, least(n.h, coalesce(f.own, 0)) AS taken FROM n LEFT JOIN n f ON f.conv_id = n.base),
t AS (SELECT c.conv_id, pos, key, words FROM c JOIN o ON o.conv_id = base AND pos <= taken
      UNION ALL SELECT conv_id, pos - h + taken, key, words FROM o JOIN c USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, pos AS depth, words, string_agg(key, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM t
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
      FROM p JOIN e USING (conv_id) GROUP BY path, depth),
u AS (SELECT left(path, greatest(length(path) - 32, 0)) AS up, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
v AS (SELECT g.*, coalesce(u.n, 0) AS n_children FROM g LEFT JOIN u ON u.up = g.path),
s AS (SELECT a.path, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
      FROM v b JOIN p q ON q.conv_id = b.conv_id AND q.depth <= b.depth JOIN v a ON a.path = q.path GROUP BY a.path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, w.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN v w ON v.depth > 0 AND w.path = left(v.path, length(v.path) - 32)
""",
    # forward through the rows: of the ways to a role state the cheapest, then the first by audit, goes on
    "op13_structure_repair": rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fault FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, generate_series(1, 2) t(copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
k AS (SELECT *, md5(length(role) || ':' || role || text) AS key, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM k),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, key ORDER BY pos) > 1 THEN 'duplicate'
             WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
edges(q, edit, r, new, to_q, cost) AS (VALUES (0, 'K', 's', '', 1, 0), (0, 'K', 'u', '', 2, 0), (1, 'K', 'u', '', 2, 0), (2, 'K', 'a', '', 3, 0), (3, 'K', 'u', '', 2, 0),
             (0, 'R', '', 'user', 2, 2), (1, 'R', '', 'user', 2, 2), (2, 'R', '', 'assistant', 3, 2), (3, 'R', '', 'user', 2, 2),
             (0, 'D', '', '', 0, 3), (1, 'D', '', '', 1, 3), (2, 'D', '', '', 2, 3), (3, 'D', '', '', 3, 3)),
moves AS (SELECT q, edit AS edits, edit, r, '' AS added, new, to_q, cost FROM edges
          UNION ALL SELECT i.q, 'I' || e.edit, e.edit, e.r, i.new || ':' || chr(10), e.new, e.to_q, e.cost + 2 FROM edges i JOIN edges e ON i.edit = 'R' AND e.q = i.to_q),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS told FROM f
      UNION ALL
      SELECT conv_id, pos, q, best.cost, best.audit, best.told FROM (
        SELECT f.conv_id, f.pos, to_q AS q, min(struct_pack(cost := w.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END, audit := w.audit || m.edits,
               told := w.told || m.added || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE m.new || ':' || f.text || chr(10) END)) AS best
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
        JOIN moves m ON m.q = w.q AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.r = f.r)) GROUP BY ALL) x),
z AS (SELECT w.conv_id, min(struct_pack(cost := cost + CASE WHEN q = 2 THEN 2 ELSE 0 END, audit := audit || CASE WHEN q = 2 THEN 'I' ELSE '' END,
             told := told || CASE WHEN q = 2 THEN 'assistant:' || chr(10) ELSE '' END)) AS best
      FROM w JOIN (SELECT conv_id, max(pos) AS pos FROM f GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.pos WHERE q <> 1 GROUP BY w.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.told, length(best.told) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
