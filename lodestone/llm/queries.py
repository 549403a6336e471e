"""The queries op1 to op13, each an operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import ball_tree, conversation_repair, decontaminate, hilbert, lang_id, mixing, ngram_join, oracles, permutation_index, secret_scan, units, variants, wrappers
from lodestone.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.repeated_units(read(spark, sf_dir, "documents")).drop("tie")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read(spark, sf_dir, "documents"))


def op6_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(read(spark, sf_dir, "embeddings"))


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.repeated_windows(read(spark, sf_dir, "documents")).drop("tie")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.word_counts(read(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    return conversation_repair.summary(conversation_repair.repair(conversation_repair.damaged(given)), given)


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_wrappers, op3_substring_dedup, op4_hilbert_shards, op5_language_id, op6_ball_tree_top_k, op7_line_windows, op8_ngram_jaccard, op9_decontaminate, op10_secret_scan, op11_spelling_variants, op12_conversation_repair, op13_permutation_index)}


#: SQL of the queries that SQL can express. The others hold a trained model, a dynamic programme, hashes that DuckDB lacks, or edit distances.
ORACLES = {
    "op3_substring_dedup": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS place FROM l),
 c AS (SELECT doc_id, i, line, place, string_split(regexp_replace(line, '([.!?])([\x20\t])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM o),
 s AS (SELECT doc_id, i, line, place, unnest(ss) AS piece, generate_subscripts(ss, 1) AS j FROM c WHERE len(ss) > 1),
 t AS (SELECT doc_id, i, line, j, piece, place + sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(piece) AS place FROM s),
 p AS (SELECT doc_id, i, 0 AS j, place, line AS piece FROM o UNION ALL SELECT doc_id, i, j, place, piece FROM t WHERE trim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))),
 b AS (SELECT doc_id, i, j, place + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS s, place + length(rtrim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS e,
  lower(regexp_replace(trim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS w FROM p),
 u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS unit FROM b WHERE w <> ''),
 r AS (SELECT *, row_number() OVER g AS k, first_value(doc_id) OVER g AS kept_doc_id, first_value(unit) OVER g AS kept_unit FROM u WINDOW g AS (PARTITION BY w ORDER BY doc_id, unit))
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", kept_doc_id, CAST(kept_unit AS INTEGER) AS kept_unit FROM r WHERE k > 1""",
    "op6_ball_tree_top_k": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_line_windows": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l),
 c AS (SELECT doc_id, pos, trim(ls[pos + 1]) || chr(10) || trim(ls[pos + 2]) || chr(10) || trim(ls[pos + 3]) AS c,
  length(array_to_string(ls[1:pos], chr(10))) + CASE WHEN pos > 0 THEN 1 ELSE 0 END AS s, length(array_to_string(ls[1:pos + 3], chr(10))) AS e FROM w),
 q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, pos) AS k FROM c WHERE c <> chr(10) || chr(10)),
 i AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 3 >= pos THEN 0 ELSE 1 END AS new FROM q WHERE k > 1),
 z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM i)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_line, CAST(max(pos) + 2 AS INTEGER) AS last_line, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM z GROUP BY doc_id, run""",
    "op8_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
 p AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS s FROM g),
 l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
 r AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT y, root FROM r JOIN l ON x = node)
SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, min(root) AS component_id FROM g JOIN r ON node = doc_id GROUP BY 1, 2""",
    "op11_spelling_variants": oracles.VARIANTS,
    "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
