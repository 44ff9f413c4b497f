"""Similarity, classification, roll-ups, calibration."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import ASKED, INDEX, KNOWN, NOVEL, SCORES_SQL, asked_chunks, boosted, index_chunks, matches_sql
from noviscan.config import DEFAULTS
from noviscan.functions import text as X
from noviscan.functions import vectors as V
from noviscan.operators import dedupe as D
from noviscan.operators import novelty as N
from noviscan.operators import relevance as R
from noviscan.operators import search as S
from noviscan.operators import similarity as K
from noviscan.session import cut_lineage

CFG = DEFAULTS.replace(novel_threshold=NOVEL, known_threshold=KNOWN, append_margin=0.01)
TOPK_SQL = matches_sql(3) + "SELECT query_id, chunk_id, round(base, 6) AS base_similarity, raw_rank FROM near"


def _topk(strategy):
    def run(spark, sf):
        near = K.top_k(asked_chunks(spark, sf), index_chunks(spark, sf), 3, cfg=CFG, differ_on="same", strategy=strategy)
        return near.select("query_id", "chunk_id", F.round("base_similarity", 6).alias("base_similarity"), F.col("raw_rank").cast("long").alias("raw_rank"))

    return run


query("join1_topk_similarity_broadcast", TOPK_SQL)(_topk("broadcast"))
query("join1_topk_similarity_cells", TOPK_SQL)(_topk("cells"))


@query("join1_topk_similarity_probe")
def probe(spark, sf):
    return _topk("probe")(spark, sf)


def _scores(spark, sf):
    asked = asked_chunks(spark, sf).drop("embedding", "text", "same")
    return asked, N.chunk_scores(asked, boosted(spark, sf, 3, CFG), CFG)


@query(
    "win1_boosted_rerank",
    matches_sql(3) + "SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM matches",
)
def rerank(spark, sf):
    return boosted(spark, sf, 3, CFG).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(
    "flt7_chunk_classification",
    matches_sql(3) + ", " + SCORES_SQL + "SELECT query_id, chunk_id, round(best, 6) AS best_similarity, is_novel, is_known FROM scores",
)
def classification(spark, sf):
    return _scores(spark, sf)[1].select("query_id", "chunk_id", F.round("best_similarity", 6).alias("best_similarity"), "is_novel", "is_known")


VERDICT_SQL = """CASE WHEN count(*) = 0 THEN 'Novel' WHEN count(*) FILTER (is_known) / count(*) >= 0.8 THEN 'Already known'
 WHEN count(*) FILTER (is_novel) / count(*) >= 0.6 THEN 'Novel' ELSE 'Partially new' END"""


@query(
    "agg1_verdict_per_source",
    matches_sql(3) + ", " + SCORES_SQL + f"""SELECT source_id, {VERDICT_SQL} AS verdict, round(avg(1 - best), 3) AS novelty_score,
  count(*) AS chunks, count(*) FILTER (is_novel) AS novel_chunks, count(*) FILTER (is_known) AS known_chunks FROM scores GROUP BY source_id""",
)
def verdicts(spark, sf):
    return N.source_verdicts(_scores(spark, sf)[1])


@query(
    "agg2_novelty_score_with_empty_sources",
    matches_sql(3) + ", " + SCORES_SQL + """, s AS (SELECT DISTINCT CAST(floor(doc_id / 10) AS BIGINT) AS source_id FROM documents)
SELECT s.source_id, round(coalesce(avg(1 - best), 1.0), 3) AS novelty_score FROM s LEFT JOIN scores USING (source_id) GROUP BY s.source_id""",
)
def novelty_scores(spark, sf):
    sources = table(spark, sf, "documents").selectExpr("CAST(floor(doc_id / 10) AS BIGINT) AS source_id").distinct()
    return N.source_verdicts(_scores(spark, sf)[1], sources).select("source_id", "novelty_score")


@query(
    "agg4_segment_rollup",
    matches_sql(3) + ", " + SCORES_SQL + """SELECT source_id, segment_index, round(coalesce(min(CASE WHEN query_id % 7 <> 0 THEN best END), 0), 6) AS best_similarity,
  coalesce(bool_or(CASE WHEN query_id % 7 <> 0 THEN is_novel END), false) AS is_novel, count(*) FILTER (query_id % 7 <> 0) = 0 AS is_unknown
  FROM scores GROUP BY source_id, segment_index""",
)
def segment_rollup(spark, sf):
    # Every seventh chunk counts as unscored, as after a rate limit.
    scores = _scores(spark, sf)[1]
    rolled = N.segment_scores(scores, unknown=F.col("query_id") % 7 == 0)
    return rolled.withColumn("best_similarity", F.round("best_similarity", 6))


OVERLAP_SQL = """, best AS (SELECT *, row_number() OVER (PARTITION BY source_id, note_path ORDER BY sim DESC, query_pos, rank) AS o FROM matches),
 ov AS (SELECT source_id, note_path, note_title, sim AS max_similarity, substr(text, 1, 300) AS sample_text, tag, nullif(trim(heading), '') AS sample_heading FROM best WHERE o = 1)
"""


def _overlaps(spark, sf):
    return N.overlaps(boosted(spark, sf, 3, CFG), asked_chunks(spark, sf))


@query(
    "agg5_overlapping_notes",
    matches_sql(3) + OVERLAP_SQL + "SELECT source_id, note_path, note_title, round(max_similarity, 6) AS max_similarity, sample_text, tag, sample_heading FROM ov",
)
def overlapping(spark, sf):
    return _overlaps(spark, sf).select(
        "source_id", "note_path", "note_title", F.round("max_similarity", 6).alias("max_similarity"), "sample_text",
        listed(F.col("tags")).alias("tag"), "sample_heading",
    )


@query("agg7_overlap_tags", matches_sql(3) + OVERLAP_SQL + "SELECT DISTINCT source_id, tag FROM ov")
def overlap_tags(spark, sf):
    return N.overlap_tags(_overlaps(spark, sf))


@query(
    "agg3_source_analysis",
    matches_sql(3) + ", " + SCORES_SQL + OVERLAP_SQL + f""", v AS (SELECT source_id, {VERDICT_SQL} AS verdict FROM scores GROUP BY source_id),
 o AS (SELECT source_id, count(*) AS overlapping FROM ov GROUP BY source_id),
 g AS (SELECT source_id, count(DISTINCT segment_index) FILTER (is_novel) AS novel_segments FROM scores GROUP BY source_id)
SELECT source_id, verdict, overlapping, novel_segments FROM v JOIN o USING (source_id) JOIN g USING (source_id)""",
)
def source_analysis(spark, sf):
    matches = cut_lineage(boosted(spark, sf, 3, CFG))  # three rows a query, read by all three parts
    scores = N.chunk_scores(asked_chunks(spark, sf).drop("embedding", "text", "same"), matches, CFG)
    segments = N.segment_scores(scores).groupBy("source_id").agg(F.count_if("is_novel").alias("novel_segments"))
    overlapping_notes = N.overlaps(matches, asked_chunks(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("overlapping"))
    return N.source_verdicts(scores).select("source_id", "verdict").join(overlapping_notes, "source_id").join(segments, "source_id")


@query(
    "join2_semantic_search",
    matches_sql(5) + "SELECT query_id, raw_rank AS rank, chunk_id, note_path, round(base, 3) AS score, substr(text, 1, 240) AS snippet FROM sims",
)
def semantic(spark, sf):
    near = K.top_k(asked_chunks(spark, sf), index_chunks(spark, sf), 5, cfg=CFG, differ_on="same")
    chunks = index_chunks(spark, sf)
    return near.join(chunks, "chunk_id").select(
        "query_id", F.col("raw_rank").cast("long").alias("rank"), "chunk_id", "note_path",
        F.round("base_similarity", 3).alias("score"), F.substring("text", 1, 240).alias("snippet"),
    )


@query(
    "join12_sibling_links",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS base
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, chunk_id) AS raw_rank FROM p)
SELECT query_id, chunk_id, raw_rank, round(base, 6) AS base_similarity FROM r WHERE raw_rank <= 3 AND base >= 0.25""",
)
def siblings(spark, sf):
    e = table(spark, sf, "embeddings")
    near = K.top_k(e, e, DEFAULTS.sibling_links, query_id="vec_id", chunk_id="vec_id", group="label", differ_on="vec_id")
    return near.filter("base_similarity >= 0.25").select(
        "query_id", "chunk_id", F.col("raw_rank").cast("long").alias("raw_rank"), F.round("base_similarity", 6).alias("base_similarity")
    )


@query(
    "flt8_similarity_floor",
    matches_sql(5) + f"SELECT query_id, count(*) AS kept FROM sims WHERE base >= {NOVEL} GROUP BY query_id",
)
def floor(spark, sf):
    return boosted(spark, sf, 5, CFG).filter(F.col("base_similarity") >= NOVEL).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "win2_runner_up_margin",
    matches_sql(2) + """SELECT query_id, round(base - lead(base) OVER (PARTITION BY query_id ORDER BY rank), 6) AS margin FROM matches QUALIFY rank = 1""",
)
def margin(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    rows = boosted(spark, sf, 2, CFG).withColumn("margin", F.round(F.col("base_similarity") - F.lead("base_similarity").over(w), 6))
    return rows.filter("rank = 1").select("query_id", "margin")


@query(
    "flt9_append_target_gate",
    matches_sql(2) + f""", two AS (SELECT query_id, max(CASE WHEN rank = 1 THEN base END) AS b1, max(CASE WHEN rank = 2 THEN base END) AS b2,
   max(CASE WHEN rank = 1 THEN note_path END) AS p1, max(CASE WHEN rank = 2 THEN note_path END) AS p2,
   max(CASE WHEN rank = 1 THEN heading END) AS h1, max(CASE WHEN rank = 1 THEN tag END) AS t1, max(query_tag) AS qt FROM matches GROUP BY query_id)
SELECT query_id, p1 AS append_target, round(b1, 3) AS overlap_similarity, h1 AS append_heading FROM two
WHERE b1 >= {KNOWN} AND (p1 = p2 OR round(b1 - b2, 9) >= 0.01) AND t1 = qt""",
)
def gate(spark, sf):
    return N.append_targets(boosted(spark, sf, 2, CFG), CFG)


@query(
    "join13_context_retrieval",
    matches_sql(3) + f""", u AS (SELECT *, row_number() OVER (PARTITION BY query_id, note_path ORDER BY rank) AS d FROM matches WHERE base >= {NOVEL})
SELECT query_id, note_path, CAST(rank AS BIGINT) AS rank, text AS excerpt, round(base, 3) AS similarity FROM u WHERE d = 1""",
)
def context(spark, sf):
    return N.context_rows(boosted(spark, sf, 3, CFG), CFG).select("query_id", "note_path", F.col("rank").cast("long").alias("rank"), "excerpt", "similarity")


@query(
    "join14_related_links",
    matches_sql(5) + OVERLAP_SQL + f""", l AS (SELECT query_id, '[[' || replace(note_path, '.md', '') || ']]' AS link, min(rank) AS rank FROM matches WHERE base >= {NOVEL} GROUP BY ALL),
 g AS (SELECT query_id, string_agg(link, '|' ORDER BY rank) AS links FROM l GROUP BY query_id),
 f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY max_similarity DESC, note_path) AS r FROM ov),
 fb AS (SELECT source_id, string_agg('[[' || replace(note_path, '.md', '') || ']]', '|' ORDER BY r) AS fb FROM f WHERE r <= 5 GROUP BY source_id)
SELECT a.query_id, CASE WHEN a.query_id % 9 = 0 THEN coalesce(fb, '') ELSE coalesce(links, '') END AS links FROM asked a LEFT JOIN g USING (query_id) LEFT JOIN fb USING (source_id)""",
)
def related(spark, sf):
    # Every ninth topic has no text and takes the source-level list.
    matches = boosted(spark, sf, 5, CFG)
    fallback = N.source_links(N.overlaps(matches, asked_chunks(spark, sf)), CFG)
    topics = asked_chunks(spark, sf).select("query_id", "source_id", F.when(F.col("query_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"))
    return N.related_links(topics, matches, fallback, True, CFG).select("query_id", listed(F.col("links")).alias("links"))


@query(
    "join15_question_answering",
    matches_sql(3) + """SELECT query_id, 'Closest passages: ' ||
  string_agg('[' || rank || '] ' || note_title, '; ' ORDER BY rank) || '.' AS answer,
  string_agg('[' || rank || '] ' || note_path || CASE WHEN heading <> '' THEN ' > ' || heading ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM matches GROUP BY query_id""",
)
def answering(spark, sf):
    return S.answers(boosted(spark, sf, 3, CFG))[0]


@query(
    "join19_nearest_passage_update_check",
    matches_sql(1) + """, j AS (SELECT query_id, note_path, base, regexp_matches(asked_text, '\\bnot\\b') AS a, regexp_matches(text, '\\bnot\\b') AS b,
  regexp_extract(asked_text, '(20[0-9][0-9])$', 1) AS y, regexp_extract(text, '(20[0-9][0-9])$', 1) AS z FROM matches)
SELECT query_id, note_path, CASE WHEN base < 0.35 THEN NULL WHEN a <> b THEN 'contradiction' ELSE 'update' END AS update_type
FROM j WHERE base >= 0.35 AND (a <> b OR y <> z)""",
)
def update_check(spark, sf):
    # The data has no pair above 0.5, so similarities are shifted by 0.15 before the test.
    matches = boosted(spark, sf, 1, CFG).join(asked_chunks(spark, sf).select("query_id", F.col("text").alias("asked")), "query_id")
    strip_id = lambda c: F.regexp_replace(c, r"chunk \d+ of \d+", "chunk")
    verdict = R.update_type(strip_id(F.col("asked")), strip_id(F.col("text")), F.round(F.col("base_similarity") + 0.15, 9))
    return matches.withColumn("u", verdict).filter(F.col("u.update_type").isNotNull()).select("query_id", "note_path", "u.update_type")


@query(
    "join20_tag_inference",
    matches_sql(3) + OVERLAP_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY max_similarity DESC, note_path) AS r FROM ov),
 t AS (SELECT query_id, 0 AS tier, 0 AS r, 'source-import' AS tag FROM asked UNION ALL SELECT query_id, 1, f.r, f.tag FROM asked JOIN f USING (source_id) WHERE f.r <= 3
   UNION ALL SELECT query_id, 2, rank, tag FROM matches),
 m AS (SELECT query_id, tag, min(tier * 1000 + r) AS first_at FROM t GROUP BY query_id, tag)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS tag_pos, tag FROM m QUALIFY tag_pos <= 8""",
)
def tags(spark, sf):
    matches = boosted(spark, sf, 3, CFG)
    rows = N.inferred_tags(asked_chunks(spark, sf).select("query_id", "source_id"), N.overlaps(matches, asked_chunks(spark, sf)), matches, CFG)
    return rows.withColumn("tag_pos", F.col("tag_pos").cast("long"))


@query(
    "agg10_threshold_calibration",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT a.vec_id AS q, a.label = b.label AS same, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS s, b.vec_id AS c FROM e a, e b),
 n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM p QUALIFY r <= 3),
 t AS (SELECT count(*) FILTER (same) AS same_note_samples, count(*) FILTER (NOT same) AS cross_note_samples, median(s) FILTER (same) AS sm, median(s) FILTER (NOT same) AS cm,
  quantile_cont(s, 0.6) FILTER (NOT same) AS p60, quantile_cont(s, 0.25) FILTER (same) AS q25 FROM n),
 k AS (SELECT *, least(0.98, greatest(greatest(p60 + 0.05, q25), p60 + 0.05)) AS known FROM t)
SELECT (SELECT count(*) FROM e) AS sample_size, round(greatest(0.05, least(p60, known - 0.05)), 3) AS recommended_novel_threshold, round(known, 3) AS recommended_known_threshold,
 same_note_samples, cross_note_samples, round(sm, 3) AS same_note_median, round(cm, 3) AS cross_note_median FROM k""",
)
def calibration(spark, sf):
    # The whole index is the sample; a chunk also matches itself here.
    index = index_chunks(spark, sf)
    near = K.top_k(index.withColumn("query_id", F.col("chunk_id")), index, 3, cfg=CFG).join(index.select("chunk_id", "note_path"), "chunk_id")
    samples = index.select(F.col("chunk_id").alias("query_id"), F.col("note_path").alias("sample_path"))
    return N.threshold_calibration(samples, near, (0.55, 0.75)).select(
        "sample_size", "recommended_novel_threshold", "recommended_known_threshold", "same_note_samples", "cross_note_samples", "same_note_median", "cross_note_median"
    )


@query(
    "agg11_index_sample",
    "SELECT vec_id AS chunk_id, 'notes/n' || CAST(label AS STRING) || '.md' AS note_path FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 200",
)
def sample(spark, sf):
    return N.sample_chunks(index_chunks(spark, sf).select("chunk_id", "note_path"), DEFAULTS.calibration_samples)


@query("agg26_chunk_count", "SELECT count(*) AS chunk_count FROM embeddings")
def chunk_count(spark, sf):
    return index_chunks(spark, sf).agg(F.count(F.lit(1)).alias("chunk_count"))


MODELS = """CASE doc_id % 6 WHEN 0 THEN 'sentence-transformers/all-MiniLM-L6-v2' WHEN 1 THEN 'all-mpnet-base-v2' WHEN 2 THEN 'BAAI/bge-small-en-v1.5'
 WHEN 3 THEN 'bge-small-en' WHEN 4 THEN 'custom-' || lang ELSE '' END"""
PROVIDERS = "CASE WHEN doc_id % 5 = 0 THEN 'gemini' WHEN doc_id % 5 = 1 THEN 'other' ELSE 'local' END"
RECOMMENDED_SQL = f"""WITH m AS (SELECT doc_id, {MODELS} AS model, {PROVIDERS} AS provider, n_chars FROM documents),
 r AS (SELECT *, CASE WHEN provider = 'local' AND lower(model) LIKE '%all-minilm-l%-v2%' THEN 0.55 WHEN provider = 'local' AND lower(model) LIKE '%all-mpnet-base-v2%' THEN 0.58
  WHEN provider = 'local' AND lower(model) LIKE '%bge-small-en%' THEN 0.60 WHEN provider = 'gemini' THEN 0.65 ELSE 0.55 END AS novel,
  CASE WHEN provider = 'local' AND lower(model) LIKE '%all-minilm-l%-v2%' THEN 0.75 WHEN provider = 'local' AND lower(model) LIKE '%all-mpnet-base-v2%' THEN 0.78
  WHEN provider = 'local' AND lower(model) LIKE '%bge-small-en%' THEN 0.80 WHEN provider = 'gemini' THEN 0.82 ELSE 0.75 END AS known FROM m)
"""


def _models(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{MODELS} AS model", f"{PROVIDERS} AS provider", "n_chars")


@query("join22_recommended_thresholds", RECOMMENDED_SQL + "SELECT doc_id, novel, known FROM r")
def recommended(spark, sf):
    return _models(spark, sf).withColumn("r", N.recommended_thresholds(F.col("provider"), F.col("model"))).select("doc_id", "r.novel", "r.known")


@query(
    "agg12_threshold_mismatch_warning",
    RECOMMENDED_SQL + "SELECT doc_id FROM r WHERE round(abs(0.45 - novel), 9) >= 0.15 OR round(abs(0.70 - known), 9) >= 0.15",
)
def mismatch(spark, sf):
    return _models(spark, sf).filter(N.threshold_warning(F.col("provider"), F.col("model"), F.lit(0.45), F.lit(0.70))).select("doc_id")


@query(
    "flt15_embed_eligibility",
    RECOMMENDED_SQL + """, w AS (SELECT doc_id, n_chars, CASE WHEN provider = 'local' AND lower(model) = 'sentence-transformers/all-minilm-l6-v2' THEN 1024
 WHEN provider = 'local' AND lower(model) = 'all-mpnet-base-v2' THEN 1536 WHEN provider = 'local' AND lower(model) IN ('baai/bge-small-en-v1.5', 'bge-small-en') THEN 2048 END AS win FROM r)
SELECT doc_id, CAST(win AS BIGINT) AS input_window, coalesce(n_chars <= win, true) AS fits FROM w""",
)
def eligibility(spark, sf):
    window = N.input_window(F.col("provider"), F.col("model"))
    return _models(spark, sf).select("doc_id", window.cast("long").alias("input_window"), F.coalesce(F.col("n_chars") <= window, F.lit(True)).alias("fits"))


@query(
    "fn1_cosine_and_normalize",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine,
 round(a.v[1] / sqrt(list_dot_product(a.v, a.v)), 6) AS first_value FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"),
        F.round(V.normalize(F.col("embedding"))[0], 6).alias("first_value"),
    )


TAG_ARRAYS = ("array('T' || CAST(doc_id % 4 AS STRING), lang, 'x')", "array('t' || CAST(doc_id % 3 AS STRING), upper(lang), 'y')")
TAG_SQL = """WITH d AS (SELECT doc_id, (doc_id % 101) / 100.0 AS base, (CASE WHEN doc_id % 4 = doc_id % 3 THEN 1 ELSE 0 END) + 1 AS n FROM documents),
 b AS (SELECT *, least(0.15, n * 0.06) AS boost FROM d)
"""


def _tag_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "(doc_id % 101) / 100.0D AS base", f"{TAG_ARRAYS[0]} AS a", f"{TAG_ARRAYS[1]} AS b")


@query("fn2_tag_boost", TAG_SQL + "SELECT doc_id, round(boost, 6) AS boost FROM b")
def tag_boost(spark, sf):
    return _tag_rows(spark, sf).select("doc_id", F.round(V.tag_boost(F.col("a"), F.col("b"), DEFAULTS), 6).alias("boost"))


@query("fn3_adjusted_similarity", TAG_SQL + "SELECT doc_id, round(least(1.0, base + boost), 6) AS adjusted FROM b")
def adjusted(spark, sf):
    return _tag_rows(spark, sf).select("doc_id", F.round(V.adjusted(F.col("base"), F.col("a"), F.col("b"), DEFAULTS), 6).alias("adjusted"))


@query("fn4_classification_similarity", TAG_SQL + "SELECT doc_id, round(CASE WHEN base < 0.55 THEN base ELSE least(1.0, base + boost) END, 6) AS effective FROM b")
def effective(spark, sf):
    return _tag_rows(spark, sf).select("doc_id", F.round(V.for_verdict(F.col("base"), F.col("a"), F.col("b"), DEFAULTS), 6).alias("effective"))


@query(
    "set4_tag_intersection",
    "SELECT doc_id, CASE WHEN doc_id % 4 = doc_id % 3 THEN lang || '|t' || CAST(doc_id % 4 AS STRING) ELSE lang END AS shared FROM documents",
)
def shared(spark, sf):
    return _tag_rows(spark, sf).select("doc_id", joined(V.shared_tags(F.col("a"), F.col("b"))).alias("shared"))


@query(
    "set7_near_duplicate_claiming",
    """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT a.vec_id, b.vec_id AS earlier, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS s FROM e a JOIN e b ON a.label = b.label AND b.vec_id < a.vec_id),
 nb AS (SELECT vec_id, list(earlier) AS near FROM p WHERE s >= 0.25 GROUP BY vec_id),
 o AS (SELECT e.vec_id, label, row_number() OVER (PARTITION BY label ORDER BY e.vec_id) AS rn, coalesce(near, []) AS near FROM e LEFT JOIN nb USING (vec_id)),
 r AS (SELECT label, rn, vec_id, [vec_id] AS kept, CAST(NULL AS BIGINT) AS owner FROM o WHERE rn = 1 UNION ALL
  SELECT o.label, o.rn, o.vec_id, CASE WHEN list_has_any(r.kept, o.near) THEN r.kept ELSE list_append(r.kept, o.vec_id) END,
   CASE WHEN list_has_any(r.kept, o.near) THEN list_min(list_intersect(r.kept, o.near)) END FROM r JOIN o ON o.label = r.label AND o.rn = r.rn + 1)
SELECT r.vec_id AS item_id, owner AS duplicate_of, round(p.s, 3) AS similarity FROM r JOIN p ON p.vec_id = r.vec_id AND p.earlier = r.owner""",
)
def claiming(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("source_id"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("pos"), "embedding"
    )
    return D.claim_duplicates(e, DEFAULTS.replace(duplicate_threshold=0.25))
