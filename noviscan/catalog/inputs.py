"""Views of the given tables in the shape of the data model.

Every expression below is valid in Spark SQL and in the checking engine, so both sides read the same
derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.catalog.base import table

# Notes of a knowledge base, one per document.
STEM = "CASE WHEN doc_id % 5 = 0 THEN 'Shared' || CAST(doc_id % 11 AS STRING) ELSE 'doc' || CAST(doc_id AS STRING) END"
FOLDER = "source || '/' || CAST(CAST(floor(doc_id / 200) AS BIGINT) AS STRING)"
PATH = f"{FOLDER} || '/' || {STEM} || '.md'"
TAGS = ["'topic' || CAST(doc_id % 10 AS STRING)", "'lang/' || lang"]
ALIAS = "CASE WHEN doc_id % 3 = 0 THEN 'Alias ' || CAST(doc_id % 400 AS STRING) ELSE '' END"
# Links by kind of target: plain name, shared (ambiguous) name, alias with anchor, path in other case, unknown.
LINK_A = "'doc' || CAST((doc_id * 7 + 3) % 1000 AS STRING)"
LINK_B = (
    "CASE doc_id % 4 WHEN 0 THEN 'Shared' || CAST(doc_id % 11 AS STRING) "
    "WHEN 1 THEN 'alias ' || CAST(doc_id % 400 AS STRING) || '#Part' "
    f"WHEN 2 THEN upper({FOLDER}) || '/DOC' || CAST(doc_id AS STRING) || '.md' "
    "ELSE 'missing ' || CAST(doc_id AS STRING) END"
)
EMBED = "'doc' || CAST((doc_id * 3 + 1) % 500 AS STRING)"
TITLE = "'Note ' || CAST(doc_id AS STRING)"
RAW = (
    f"'---' || chr(10) || 'title: \"' || {TITLE} || '\"' || chr(10) || 'tags: [' || {TAGS[0]} || ', \"' || {TAGS[1]} || '\"]' || chr(10) "
    f"|| 'aliases: [\"' || {ALIAS} || '\"]' || chr(10) || 'related: \"[[' || {LINK_B} || ']]\"' || chr(10) || '---' || chr(10) "
    f"|| text || chr(10) || chr(10) || 'See [[' || {LINK_A} || '|shown]] and ![[' || {EMBED} || ']] #inline/t' || CAST(doc_id % 3 AS STRING) || chr(10)"
)
CONTENT = f"text || chr(10) || chr(10) || 'See [[' || {LINK_A} || '|shown]] and ![[' || {EMBED} || ']] #inline/t' || CAST(doc_id % 3 AS STRING)"
MTIME = "make_date(2024, 1, CAST(1 + doc_id % 28 AS INT))"

# Documents as markdown: a heading before every third line, blank lines between the others.
MARKDOWN = (
    "CASE doc_id % 3 WHEN 0 THEN '# Top ' || CAST(doc_id AS STRING) || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10)) "
    "WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END"
)

NOTES_SQL = f"""SELECT doc_id, {PATH} AS note_path, {STEM} AS title, {CONTENT} AS content, text,
  {ALIAS} AS alias, {TAGS[0]} AS tag1, {TAGS[1]} AS tag2, 'inline/t' || CAST(doc_id % 3 AS STRING) AS tag3,
  {LINK_A} AS link_a, {EMBED} AS embed, {LINK_B} AS link_b, {MTIME} AS mtime FROM documents"""

# Links of a note in order: body link, body embed, header link (repeats removed).
LINKS_SQL = """SELECT note_path, 0 AS pos, link_a AS link FROM notes
  UNION ALL SELECT note_path, 1, embed FROM notes WHERE embed <> link_a
  UNION ALL SELECT note_path, 2, link_b FROM notes WHERE link_b <> link_a AND link_b <> embed"""


def raw_notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{PATH} AS note_path", f"{RAW} AS raw", f"{MTIME} AS mtime")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes in table form (as a parser would deliver them)."""
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", f"{PATH} AS note_path", f"{STEM} AS title", f"{CONTENT} AS content",
        f"filter(array({ALIAS}), a -> a <> '') AS aliases", f"array({TAGS[0]}, {TAGS[1]}, 'inline/t' || CAST(doc_id % 3 AS STRING)) AS tags",
        f"array_distinct(array({LINK_A}, {EMBED}, {LINK_B})) AS wikilinks", f"{MTIME} AS mtime",
    )
    return rows


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id AS source_id", f"{MARKDOWN} AS text", "lang", "source")


# Vectors: every row is both an indexed chunk and a query chunk; a chunk never matches itself.
INDEX = {
    "chunk_id": "vec_id",
    "note_path": "'notes/n' || CAST(label AS STRING) || '.md'",
    "note_title": "'n' || CAST(label AS STRING)",
    "heading": "CASE WHEN vec_id % 2 = 0 THEN 'Part ' || CAST(vec_id % 4 AS STRING) ELSE ' ' END",
    "tag": "'topic' || CAST(label % 5 AS STRING)",
    "text": "'chunk ' || CAST(vec_id AS STRING) || ' of ' || CAST(label AS STRING) || CASE WHEN vec_id % 3 = 0 THEN ' not ' ELSE ' ' END || CAST(2000 + vec_id % 20 AS STRING)",
}
ASKED = {
    "query_id": "vec_id",
    "source_id": "CAST(floor(vec_id / 10) AS BIGINT)",
    "segment_index": "CAST(floor((vec_id % 10) / 2) AS BIGINT)",
    "query_pos": "vec_id",
    "query_tag": "'topic' || CAST(vec_id % 5 AS STRING)",
}
NOVEL, KNOWN = 0.39, 0.43


def index_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.selectExpr(*[f"{v} AS {k}" for k, v in INDEX.items() if k != "tag"], f"array({INDEX['tag']}) AS tags", "embedding", "vec_id AS same")


def asked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.selectExpr(
        *[f"{v} AS {k}" for k, v in ASKED.items() if k != "query_tag"], f"array({ASKED['query_tag']}) AS query_tags",
        f"{INDEX['text']} AS text", "embedding", "vec_id AS same",
    )


def matches_sql(k: int) -> str:
    """CTEs e, asked, matches (k raw nearest, boosted and re-ranked)."""
    index = ", ".join(f"{v} AS {n}" for n, v in INDEX.items())
    asked = ", ".join(f"{v} AS {n}" for n, v in ASKED.items())
    return f"""WITH e AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 idx AS (SELECT {index}, v FROM e), asked AS (SELECT {asked}, {INDEX['text']} AS asked_text, v FROM e),
 pairs AS (SELECT a.query_id, b.chunk_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS base
   FROM asked a, idx b WHERE a.query_id <> b.chunk_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, chunk_id) AS raw_rank FROM pairs QUALIFY raw_rank <= {k}),
 sims AS (SELECT n.*, i.note_path, i.note_title, i.heading, i.tag, i.text, a.source_id, a.segment_index, a.query_pos, a.query_tag, a.asked_text,
   least(1.0, n.base + CASE WHEN i.tag = a.query_tag THEN 0.06 ELSE 0 END) AS sim
   FROM near n JOIN idx i USING (chunk_id) JOIN asked a USING (query_id)),
 matches AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, raw_rank) AS rank FROM sims)
"""


SCORES_SQL = f"""scores AS (SELECT query_id, source_id, segment_index, query_pos, chunk_id, note_path, base AS best,
   base < {NOVEL} AS is_novel, (CASE WHEN base < {NOVEL} THEN base ELSE sim END) >= {KNOWN} AS is_known FROM matches WHERE rank = 1)
"""


def boosted(spark: SparkSession, sf: str, k: int, cfg):
    from noviscan.operators.novelty import boosted_matches
    from noviscan.operators.similarity import top_k

    asked, index = asked_chunks(spark, sf), index_chunks(spark, sf)
    near = top_k(asked, index, k, cfg=cfg, differ_on="same")
    fields = index.select("chunk_id", "note_path", "note_title", "heading", "text", "tags")
    tags = asked.select("query_id", "query_tags")
    return boosted_matches(near.join(fields, "chunk_id").join(tags, "query_id"), cfg)


def run_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Model calls: one per event, ordered inside each user's run."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("failed"), F.floor(F.col("value") * 100).cast("long").alias("prompt_chars"),
    )


CALLS_SQL = (
    "SELECT user_id AS run_id, event_id AS seq, event_type = 'error' AS failed, CAST(floor(value * 100) AS BIGINT) AS prompt_chars FROM events"
)
