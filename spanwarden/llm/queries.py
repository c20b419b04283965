"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_workers
from . import chat, exact_dedup, iblt, line_dedup, lm_score, mixing, near_dedup, packing, quality, warc


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.windows(spark, turns))


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 4 AS cost,
    row_number() OVER o - 1 AS at_, (sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 4) OVER o)::BIGINT AS stop
  FROM given WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS UNBOUNDED PRECEDING)
), sized AS (
  SELECT *, stop - cost AS start, length(role) + length(text) + 20 + len(regexp_extract_all(role, rx)) + len(regexp_extract_all(text, rx)) AS shown,
    coalesce(max(CASE WHEN at_ = 0 AND role = 'system' THEN cost END) OVER (PARTITION BY conv_id), 0) AS sys
  FROM t, (SELECT '[<\[]\\*(?:/?s>|<SYS>>|</SYS>>|/?INST\])' AS rx)
), wide AS (
  SELECT *, greatest(256, (2048 - 256 - sys) // 2) AS width FROM sized
), cells AS (
  SELECT *, start // width AS cell, cost > width AS large FROM wide
), runs AS (
  SELECT *, 2 * sum(large::INT) OVER (PARTITION BY conv_id, cell ORDER BY at_) - large::INT AS run FROM cells
), placed AS (
  SELECT *, min(at_) OVER w AS win, min(start) OVER w AS w_start FROM runs WINDOW w AS (PARTITION BY conv_id, cell, run)
), again AS (
  SELECT h.conv_id, p.shown FROM placed h JOIN placed p ON h.conv_id = p.conv_id AND p.win < h.win AND p.start >= h.w_start - least(256, h.width) AND NOT (h.sys > 0 AND p.at_ = 0) WHERE h.at_ = h.win
  UNION ALL SELECT h.conv_id, p.shown FROM placed h JOIN placed p ON h.conv_id = p.conv_id AND p.at_ = 0 AND h.sys > 0 WHERE h.at_ = h.win AND h.win > 0
), more AS (
  SELECT conv_id, sum(shown) AS chars FROM again GROUP BY conv_id
)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY at_)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY at_), '')) AS loss_sha256,
  (sum(shown) + coalesce(any_value(chars), 0))::BIGINT AS formatted_chars
FROM placed p LEFT JOIN more m ON p.conv_id = m.conv_id GROUP BY p.conv_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_decisions(spark, _table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(spark, _table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] END)) AS s FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id != y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents")).drop("runs")


OP4_SQL = r"""
WITH said AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS said, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(said, '[^\x20\x09-\x0D]+')) AS words FROM said
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS hi, sum(words) OVER (PARTITION BY doc_id ORDER BY line) - words AS lo FROM counted WHERE words > 0
), spans AS (
  SELECT doc_id, line AS first, max(line) OVER f AS last, sum(words) OVER f AS n, list(said) OVER f AS content FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY lo RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(line) OVER b AS first, line AS last, sum(words) OVER b AS n, list(said) OVER b AS content FROM placed
  WINDOW b AS (PARTITION BY doc_id ORDER BY hi RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), origins AS (
  SELECT content, min((doc_id, first, last)) AS origin FROM spans WHERE n >= 50 GROUP BY content HAVING count(*) > 1
), later AS (
  SELECT DISTINCT s.doc_id, s.first, s.last FROM spans s JOIN origins o USING (content)
  WHERE s.n >= 50 AND (s.doc_id != o.origin[1] OR s.first > o.origin[3])
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM later
)
SELECT s.doc_id, count(*) AS n_lines, count(g.line) AS removed_lines, coalesce(string_agg(CASE WHEN g.line IS NULL THEN s.said END, chr(10) ORDER BY s.line), '') AS text
FROM said s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.line = g.line GROUP BY s.doc_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM t
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id != top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id != top THEN top END AS refers_to
FROM g
"""


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.edited_pairs(spark, _table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(spark, docs, quality.fit(spark, docs, _table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(spark, _table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(spark, _table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_warc": op5_warc,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_mixing": op8_mixing,
        "op9_lm_score": op9_lm_score,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_exact_dedup": OP2_SQL,
        "op3_near_dedup": OP3_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_warc": OP5_SQL,
    }
