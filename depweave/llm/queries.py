"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import contamination, dialogues, languages, media, near_duplicates, packing, pieces, quality, ranking, repair, secret_scan, url_rules, wrappers
from depweave.llm.common import held_out, small_batches, table, trainable


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs.where(trainable(F.col("doc_id"))))
    return languages.predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogues.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("targets", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("targets", F.array_join(spans, ","))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    words = pieces.vocabulary(spark)
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    return pieces.decode(coded, words).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.ruled(pages))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(trainable(F.col("doc_id"))))
    return quality.score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("is_first", F.col("doc_id") == F.col("class_id"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ranking.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT item_id, least(len(w), 13) AS k,
         unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda p: array_to_string(w[p:p + least(len(w), 13) - 1], ' '))) AS win
  FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM wins),
grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT g.doc_id, g.p, g.k, x.item_id FROM grams g JOIN wins x ON g.k = x.k AND g.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, md5(text)) - 1 AS seat,
             replace(replace(text, '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>') AS said,
             translate(replace(replace(role, '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>'), chr(10) || chr(13), '  ') AS name FROM t),
w AS (SELECT DISTINCT conv_id AS of, role AS perspective FROM t WHERE role NOT IN ('', 'system')),
y AS (SELECT conv_id AS of_system, '<|im_start|>system' || chr(10) || min_by(said, seat) || '<|im_end|>' || chr(10) AS system FROM o WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT conv_id, perspective, CAST(floor(seat / 256) AS BIGINT) AS part, seat, said, role = perspective AS own, CASE WHEN seat >= 256 THEN coalesce(system, '') ELSE '' END AS context,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' WHEN role = '' THEN 'user'
                               ELSE 'user name=' || name END || chr(10) AS head
      FROM o JOIN w ON o.conv_id IS NOT DISTINCT FROM w.of LEFT JOIN y ON o.conv_id IS NOT DISTINCT FROM y.of_system),
s AS (SELECT *, length(context) + sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY seat ROWS UNBOUNDED PRECEDING) AS stop FROM r)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(length(max(context)) AS BIGINT) AS context,
       max(context) || string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY seat) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(stop - 11 - length(said) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY seat), '') AS targets
FROM s GROUP BY conv_id, perspective, part
"""

#: crc32 as a fold: the register over the bytes, and over the bits of each.
_CRC = """xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE
raw AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_CRC.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS twice
        FROM raw WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM dam),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
             CASE WHEN said = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM num),
ins(s, t, w, letters, added) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
         (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(s, t, w, letter, initial, shown) AS (
  VALUES (0, 0, 2, 'D', NULL, NULL), (1, 1, 2, 'D', NULL, NULL), (2, 2, 2, 'D', NULL, NULL), (3, 3, 2, 'D', NULL, NULL),
         (0, 2, 1, 'R', NULL, 'user'), (1, 2, 1, 'R', NULL, 'user'), (2, 3, 1, 'R', NULL, 'assistant'), (3, 2, 1, 'R', NULL, 'user'),
         (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL)),
way(conv_id, i, s, cost, audit, said) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM conversations
  UNION ALL
  SELECT conv_id, i, t, min(cost), arg_min(audit, (cost, audit)), arg_min(said, (cost, audit)) FROM (
    SELECT way.conv_id, f.i, e.t, way.cost + n.w + e.w + CASE WHEN f.fault = 3 AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost, way.audit || n.letters || e.letter AS audit,
           way.said || n.added || CASE WHEN e.letter = 'D' THEN '' ELSE chr(10) || coalesce(e.shown, f.role) || ':' || f.text END AS said
    FROM way JOIN f ON f.conv_id IS NOT DISTINCT FROM way.conv_id AND f.i = way.i + 1 JOIN ins n ON n.s = way.s JOIN edit e ON e.s = n.t
    WHERE (e.letter = 'D' OR f.fault IN (0, 3)) AND (e.initial IS NULL OR e.initial = f.initial)) GROUP BY conv_id, i, t),
stats AS (SELECT conv_id AS of, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
                 count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ends AS (SELECT w.conv_id, min(w.cost + n.w) AS cost, arg_min(w.audit || n.letters, (w.cost + n.w, w.audit || n.letters)) AS audit, arg_min(w.said || n.added, (w.cost + n.w, w.audit || n.letters)) AS said
         FROM way w JOIN ins n ON n.s = w.s AND n.t IN (0, 3) LEFT JOIN stats x ON x.of IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(x.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, CAST(coalesce(x.gaps, 0) AS BIGINT) AS gaps, coalesce(x.blank, 0) AS blank, coalesce(x.duplicate, 0) AS duplicate, coalesce(x.truncated, 0) AS truncated, coalesce(x.illegal, 0) AS illegal,
       CAST(e.cost AS BIGINT) AS cost, e.audit, sha256(substr(e.said, 2)) AS repaired_sha256
FROM ends e LEFT JOIN stats x ON x.of IS NOT DISTINCT FROM e.conv_id
"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
sums AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT doc_id, row, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, row, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, n_docs),
s AS (SELECT q.item_id, tf.doc_id, tf.row, CAST(sum(q.times * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * tf.n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), sums GROUP BY q.item_id, tf.doc_id, tf.row),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

QUERIES = {
    f.__name__: f for f in (
        op1_language_id, op2_perspectives, op3_pieces, op4_media, op5_decontamination, op6_main_text, op7_url_filter, op8_quality, op9_secrets, op10_near_duplicates,
        op11_packing, op12_conversation_repair, op13_ranked_search,
    )
}
ORACLES = {"op2_perspectives": OP2_SQL, "op5_decontamination": OP5_SQL, "op12_conversation_repair": OP12_SQL, "op13_ranked_search": OP13_SQL}
