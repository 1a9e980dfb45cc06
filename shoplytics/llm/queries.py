"""The queries of this folder: one per operator, and the pipeline."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from shoplytics.session import ship_package
from shoplytics.sources.tables import table
from shoplytics.llm import (chat, fingerprints, language, lexical, mixing, neardup, neighbours, packing, pages, periodic,
                            pii, tokens, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run
    return deco


_EXTRA = r"""
SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role,
       '<|im_end|><|im_start|>assistant ok' AS text
FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)"""


@query("op1_chat_format", sql=r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL """ + _EXTRA + r""")),
near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + CASE WHEN before IS DISTINCT FROM role THEN 13 + length(role) ELSE 10 END
    + CASE WHEN after IS DISTINCT FROM role THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, and what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_conversations(rows.unionByName(spark.sql(_EXTRA))))


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"), whole=True)


@query("op4_mixing", sql=r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || doc_id) AS h FROM documents),
s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source),
w AS (SELECT *, CAST(sid % 3 + 1 AS DOUBLE) AS weight, 3 * size AS cap FROM s),
lv AS (
  SELECT a.sid, a.cap / a.weight AS ratio,
    ((SELECT sum(size) FROM w) - coalesce(sum(b.cap) FILTER (WHERE (b.cap / b.weight, b.sid) < (a.cap / a.weight, a.sid)), 0))
    / ((SELECT sum(weight) FROM w) - coalesce(sum(b.weight) FILTER (WHERE (b.cap / b.weight, b.sid) < (a.cap / a.weight, a.sid)), 0)) AS level
  FROM w a, w b GROUP BY a.sid, a.cap, a.weight),
t AS (
  SELECT source, size AS source_size, least(cap, weight * (SELECT max(level) FROM lv WHERE level <= ratio)) AS target FROM w),
p AS (
  SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(sum(greatest(0, least(a + e * source_size + size, floor(target)) - (a + e * source_size))) AS BIGINT) AS taken
FROM p, (VALUES (0), (1), (2)) AS v(e) GROUP BY ALL""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    return language.predict_languages(table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with the scores of the spans by checksum and context."""
    return pii.find_pii(table(spark, sf_dir, "documents")).withColumn("scores", F.col("found.score")).drop("found")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_near_duplicates", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 4)


@query("op11_ranked_search", sql=r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM w WHERE len(w) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM w)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM tf JOIN df USING (term) JOIN it USING (term), a GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents, of all, for every benchmark item."""
    return lexical.ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("op12_token_codes")
def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in files of directly addressable codes, read back."""
    import public_tokenizers
    folder = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.TOKENIZER))
    return tokens.read_documents(spark, folder)


# crc32 of the decimal digits of doc_id: for every digit, its code is added and eight bits are shifted out.
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_resize([-1::BIGINT], 8, -1::BIGINT))))),
  lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END))"""


@query("op13_periodic_runs", sql=r"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + _CRC + r""" AS h FROM documents),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM h),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
    w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM c),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS i FROM d)),
often AS (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1),
few AS (SELECT * FROM grams SEMI JOIN often USING (doc_id, gram)),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
pair AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 AS common FROM stretch GROUP BY doc_id, q, k HAVING count(*) + 4 >= 3 * q),
run2 AS (SELECT doc_id, start, q + common AS length, min(q) AS period FROM pair GROUP BY doc_id, start, q + common),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS r FROM run2),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run2 GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run2),
left_ AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(left_.text, '')) AS collapsed_sha256,
  d.n AS n_words, coalesce(n_kept, 0) AS n_kept
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN left_ USING (doc_id) LEFT JOIN (SELECT * FROM top WHERE r = 1) USING (doc_id)""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, every tenth of them stretched periodically first."""
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic.stretched)


@query("pipeline", sql=corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
