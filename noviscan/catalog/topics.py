"""Topics, titles, plans."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import markdown
from noviscan.catalog.sources import MD_SQL, WS, longs
from noviscan.catalog.text import COMPOSE_SQL, HEADLINES, words_sql
from noviscan.config import DEFAULTS
from noviscan.functions import text as X
from noviscan.operators import titles as N
from noviscan.operators import topics as T
from noviscan.operators.chunking import planning_segments
from noviscan.operators.ordering import dense_index
from noviscan.sources import segments as S


def _segments(spark, sf):
    return longs(S.text_segments(markdown(spark, sf), ["source_id"]), "segment_index").select("source_id", "segment_index", "text", "line_start", "line_end")


@query(
    "win3_dense_reindex",
    MD_SQL + " SELECT source_id, line_start, row_number() OVER (PARTITION BY source_id ORDER BY line_start) - 1 AS segment_index FROM md",
)
def reindex(spark, sf):
    kept = longs(_segments(spark, sf).drop("segment_index"), "line_start")
    return dense_index(kept, ["source_id"], "line_start", "segment_index").select("source_id", "line_start", "segment_index")


@query("prj7_topic_split")
def topic_split(spark, sf):
    """Heading parts, oversized ones cut, before any title is made."""
    rows = _segments(spark, sf).select("source_id", "segment_index", F.posexplode(T.heading_parts(F.col("text"))).alias("part", "p"))
    cut = rows.select("source_id", "segment_index", "part", F.col("p.hint").alias("hint"), F.posexplode(T.split_oversized(F.col("p.body"), DEFAULTS)).alias("piece", "text"))
    return cut


@query(
    "prj7_topic_split_by_heading",
    MD_SQL + f""", hp AS (SELECT *, string_split(regexp_replace(text, '(?m)^#{{1,3}}\\s+(.+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM md),
 p AS (SELECT source_id, segment_index, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM hp),
 b AS (SELECT *, CASE WHEN i > 1 THEN trim(split_part(p, chr(2), 1), {WS}) ELSE '' END AS hint, trim(CASE WHEN i > 1 THEN split_part(p, chr(2), 2) ELSE p END, {WS}) AS body FROM p),
 k AS (SELECT source_id, segment_index, hint, body FROM b WHERE body <> '')
SELECT source_id, segment_index, hint, md5(body) AS body_md5 FROM k UNION ALL
SELECT source_id, segment_index, '', md5(trim(text, {WS})) FROM md WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source_id = md.source_id AND k.segment_index = md.segment_index)""",
)
def split_by_heading(spark, sf):
    rows = _segments(spark, sf).select("source_id", "segment_index", F.inline(T.heading_parts(F.col("text"))))
    return rows.select("source_id", "segment_index", "hint", F.md5("body").alias("body_md5"))


@query("srt9_concept_title_choice")
def concept_titles(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "text", f"{HEADLINES} AS hint")
    return N.unstage(N.refine_title(N.stage_body(d, "text"), "text", "hint", "title")).select("doc_id", "title")


@query("prj21_ground_planned_title")
def planned_titles(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "text", f"{HEADLINES} AS planned", "text AS summary")
    return N.planned_title(d, "planned", "summary", "text", "title").select("doc_id", "title")


@query(
    "win4_title_disambiguation",
    f"""WITH c AS ({COMPOSE_SQL}), b AS (SELECT doc_id % 20 AS source_id, doc_id AS pos, trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'Shared Name' WHEN doc_id % 6 IN (1, 5) THEN 'Other name' ELSE title END, '(?i)\\s*\\((?:part\\s*)?\\d+\\)\\s*$', ''), {WS}) AS bare FROM c),
 n AS (SELECT *, count(*) OVER (PARTITION BY source_id, lower(bare)) AS n, row_number() OVER (PARTITION BY source_id, lower(bare) ORDER BY pos) AS k FROM b)
SELECT source_id, pos, CASE WHEN n = 1 THEN bare ELSE bare || ' (part ' || k || ')' END AS title FROM n""",
)
def disambiguation(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id % 20 AS source_id", "doc_id AS pos", f"{HEADLINES} AS h", "doc_id")
    named = d.withColumn("t", F.when(F.col("doc_id") % 3 == 0, "Shared Name").when((F.col("doc_id") % 6).isin(1, 5), "Other name").otherwise(X.compose_title(F.col("h"))))
    return N.disambiguate(named, "source_id", "pos", "t", "title", composed=True).select("source_id", "pos", "title")


# Topic rows: one per segment, titled by rule, so that repeats occur.
TOPIC_SQL = MD_SQL + f""", topics AS (SELECT source_id, segment_index AS topic_pos, CAST(floor(segment_index / 2) AS BIGINT) AS segment_index, CASE WHEN (source_id + segment_index) % 4 = 0 THEN 'References' WHEN segment_index % 2 = 0 THEN 'Topic A' ELSE 'topic a' END AS title,
  text, (source_id + segment_index) % 3 = 0 AS is_novel FROM md)"""


def _topics(spark, sf):
    return _segments(spark, sf).selectExpr(
        "source_id", "segment_index AS topic_pos", "CAST(floor(segment_index / 2) AS BIGINT) AS segment_index",
        "CASE WHEN (source_id + segment_index) % 4 = 0 THEN 'References' WHEN segment_index % 2 = 0 THEN 'Topic A' ELSE 'topic a' END AS title",
        "text", "(source_id + segment_index) % 3 = 0 AS is_novel",
    )


@query(
    "win6_topic_dedupe",
    TOPIC_SQL + " SELECT source_id, min(topic_pos) AS topic_pos FROM topics GROUP BY source_id, lower(title), segment_index",
)
def topic_dedupe(spark, sf):
    return T.dedupe_topics(_topics(spark, sf)).select("source_id", "topic_pos")


@query(
    "srt6_novel_first_cap",
    TOPIC_SQL + " SELECT source_id, topic_pos, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN is_novel THEN 0 ELSE 1 END, topic_pos) AS rank FROM topics QUALIFY rank <= 4",
)
def novel_first(spark, sf):
    return longs(T.cap_topics(_topics(spark, sf), DEFAULTS.replace(max_notes_per_source=4)).select("source_id", "topic_pos", "rank"), "rank")


@query(
    "flt5_keep_relevant_topics",
    TOPIC_SQL + " SELECT source_id, topic_pos FROM topics QUALIFY title <> 'References' OR bool_and(title = 'References') OVER (PARTITION BY source_id)",
)
def relevant_topics(spark, sf):
    # Only titles decide here; the text test has its own query.
    from noviscan.operators.relevance import boilerplate_title, keep_relevant

    return keep_relevant(_topics(spark, sf), boilerplate_title(F.col("title"))).select("source_id", "topic_pos")


# A plan: pairs of neighbouring segments, every third pair left out, some indices unknown.
PLAN_SQL = MD_SQL + """, segs AS (SELECT source_id, segment_index, text FROM md),
 plan AS (SELECT source_id, CAST(floor(segment_index / 2) AS BIGINT) AS plan_pos, list(segment_index ORDER BY segment_index) AS ix FROM segs WHERE CAST(floor(segment_index / 2) AS BIGINT) % 3 <> 2 GROUP BY ALL)"""


def _plan(spark, sf):
    pairs = _segments(spark, sf).withColumn("plan_pos", F.floor(F.col("segment_index") / 2).cast("long")).filter("plan_pos % 3 <> 2")
    rows = pairs.groupBy("source_id", "plan_pos").agg(F.sort_array(F.collect_list("segment_index")).alias("ix"))
    return rows.select(
        "source_id", "plan_pos", F.concat(F.lit("Plan "), "plan_pos", F.lit(" text")).alias("title"), F.when(F.col("plan_pos") % 2 == 0, "kept summary").otherwise("").alias("summary"),
        F.when(F.col("plan_pos") % 4 == 0, F.concat("ix", F.array(F.lit(99999).cast("long")))).otherwise(F.col("ix")).alias("segment_indices"),
    )


@query(
    "join23_planned_topic_segments",
    PLAN_SQL + """, t AS (SELECT p.source_id, plan_pos, string_agg(text, chr(10) || chr(10) ORDER BY segment_index) AS text, string_agg(CAST(segment_index AS VARCHAR), '|' ORDER BY segment_index) AS indices
  FROM plan p JOIN segs s ON s.source_id = p.source_id AND list_contains(p.ix, s.segment_index) GROUP BY ALL)
SELECT source_id, plan_pos, indices, CASE WHEN plan_pos % 2 = 0 THEN 'kept summary' WHEN length(text) <= 500 THEN text ELSE rtrim(substr(text, 1, 497), """ + WS + """) || '...' END AS summary FROM t""",
)
def planned(spark, sf):
    rows = T.planned_topics(_plan(spark, sf), _segments(spark, sf))
    return rows.select("source_id", "plan_pos", F.array_join(F.col("segment_indices").cast("array<string>"), "|").alias("indices"), "summary")


@query(
    "join18_uncovered_segments",
    PLAN_SQL + " SELECT source_id, segment_index FROM segs WHERE CAST(floor(segment_index / 2) AS BIGINT) % 3 = 2",
)
def uncovered(spark, sf):
    return T.uncovered_segments(_segments(spark, sf), T.planned_topics(_plan(spark, sf), _segments(spark, sf))).select("source_id", "segment_index")


@query(
    "agg18_minimum_topic_count",
    MD_SQL + """ SELECT source_id, CASE WHEN count(*) <= 2 THEN 1 ELSE greatest(2, least(count(*) FILTER (segment_index % 2 = 0), greatest(CAST(floor(count(*) / 3) AS BIGINT), 3))) END AS needed FROM md GROUP BY source_id""",
)
def minimum(spark, sf):
    counts = _segments(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("segment_index") % 2 == 0).alias("s"))
    return counts.select("source_id", T.minimum_topics(F.col("n"), F.col("s")).alias("needed"))


@query(
    "set5_plan_union",
    PLAN_SQL + """, n AS (SELECT source_id, count(*) AS segments FROM segs GROUP BY source_id), pc AS (SELECT source_id, count(*) AS planned FROM plan GROUP BY source_id),
 fc AS (SELECT source_id, count(*) AS fill FROM segs WHERE CAST(floor(segment_index / 2) AS BIGINT) % 3 = 2 GROUP BY source_id),
 u AS (SELECT n.source_id, coalesce(planned, 0) > 0 AND coalesce(planned, 0) + coalesce(fill, 0) >= CASE WHEN segments <= 2 THEN 1 ELSE greatest(2, least(segments, greatest(floor(segments / 3), 3))) END AS use_plan
   FROM n LEFT JOIN pc USING (source_id) LEFT JOIN fc USING (source_id))
SELECT source_id, 'plan' AS origin, ix[1] AS first_segment FROM plan JOIN u USING (source_id) WHERE use_plan
UNION ALL SELECT source_id, 'fill', segment_index FROM segs JOIN u USING (source_id) WHERE use_plan AND CAST(floor(segment_index / 2) AS BIGINT) % 3 = 2
UNION ALL SELECT source_id, 'structural', segment_index FROM segs JOIN u USING (source_id) WHERE NOT use_plan""",
)
def plan_union(spark, sf):
    segs = _segments(spark, sf)
    structural = segs.select("source_id", F.col("segment_index").alias("topic_pos"), "segment_index", F.lit("t").alias("title"), "text", F.lit("s").alias("summary"))
    merged = T.reconcile(T.planned_topics(_plan(spark, sf), segs), structural, segs)
    return merged.select("source_id", "origin", F.array_min("segment_indices").alias("first_segment"))


@query(
    "srt7_topics_by_earliest_segment",
    PLAN_SQL + " SELECT source_id, plan_pos, row_number() OVER (PARTITION BY source_id ORDER BY list_min(ix)) - 1 AS topic_pos FROM plan",
)
def earliest(spark, sf):
    rows = _plan(spark, sf).withColumn("first", F.array_min("segment_indices"))
    return dense_index(rows, ["source_id"], "first", "topic_pos").select("source_id", "plan_pos", "topic_pos")


@query(
    "agg17_topic_novelty",
    PLAN_SQL + """, sg AS (SELECT source_id, segment_index, (source_id + segment_index) % 3 = 0 AS nv, (source_id + segment_index) % 5 = 0 AS un FROM segs)
SELECT p.source_id, plan_pos AS topic_pos, coalesce(bool_or(CASE WHEN NOT un THEN nv END), false) AS is_novel FROM plan p JOIN sg s ON s.source_id = p.source_id AND list_contains(p.ix, s.segment_index) GROUP BY ALL""",
)
def topic_novelty(spark, sf):
    scores = _segments(spark, sf).selectExpr("source_id", "segment_index", "(source_id + segment_index) % 3 = 0 AS is_novel", "(source_id + segment_index) % 5 = 0 AS is_unknown")
    topics = _plan(spark, sf).withColumnRenamed("plan_pos", "topic_pos")
    return T.topic_novelty(topics, scores).select("source_id", "topic_pos", "is_novel")


@query(
    "agg16_merged_location",
    PLAN_SQL + """ SELECT p.source_id, plan_pos, min(line_start) AS line_start, max(line_end) AS line_end, min(line_start) + 1 AS page, max(CASE WHEN md.segment_index % 2 = 0 THEN line_end ELSE line_start + 1 END) AS page_end
 FROM plan p JOIN md ON md.source_id = p.source_id AND list_contains(p.ix, md.segment_index) GROUP BY ALL""",
)
def merged_location(spark, sf):
    segs = longs(_segments(spark, sf), "line_start", "line_end")
    none = F.lit(None).cast("long")
    located = segs.select(
        "source_id", "segment_index", "line_start", "line_end", (F.col("line_start") + 1).alias("page"),
        F.when(F.col("segment_index") % 2 == 0, F.col("line_end")).otherwise(F.lit(0)).alias("page_end"),
        none.alias("chapter"), none.alias("chapter_end"), none.alias("ts_start"), none.alias("ts_end"),
    )
    keyed = _plan(spark, sf).select("source_id", "plan_pos", F.explode("segment_indices").alias("segment_index"))
    return T.merged_locations(keyed.join(located, ["source_id", "segment_index"]), ["source_id", "plan_pos"]).select(
        "source_id", "plan_pos", "line_start", "line_end", "page", "page_end"
    )


@query(
    "join17_plan_reuse",
    PLAN_SQL + " SELECT source_id, NOT bool_or(plan_pos % 4 = 0) AS plan_valid FROM plan GROUP BY source_id",
)
def plan_reuse(spark, sf):
    return T.saved_plan_is_valid(_plan(spark, sf), _segments(spark, sf))


def _saved(spark, sf):
    """Saved notes: every plan row but those of odd position, plus one orphan per source."""
    plan = _plan(spark, sf)
    kept = plan.filter("plan_pos % 2 = 0").select("source_id", F.reverse("segment_indices").alias("segment_indices"), F.upper("title").alias("title"))
    orphans = plan.filter("plan_pos = 0").select("source_id", F.array(F.lit(7).cast("long")).alias("segment_indices"), F.lit("orphan").alias("title"))
    return kept.unionByName(orphans)


@query(
    "join16_resume_match",
    PLAN_SQL + """ SELECT 'reused' AS part, source_id, plan_pos FROM plan WHERE plan_pos % 2 = 0 UNION ALL SELECT 'to_draft', source_id, plan_pos FROM plan WHERE plan_pos % 2 = 1
 UNION ALL SELECT 'orphan', source_id, -1 FROM plan WHERE plan_pos = 0""",
)
def resume(spark, sf):
    reused, todo, orphans = T.resume_split(_plan(spark, sf), _saved(spark, sf))
    return (
        reused.select(F.lit("reused").alias("part"), "source_id", "plan_pos")
        .unionByName(todo.select(F.lit("to_draft").alias("part"), "source_id", "plan_pos"))
        .unionByName(orphans.select(F.lit("orphan").alias("part"), "source_id", F.lit(-1).cast("long").alias("plan_pos")))
    )


@query(
    "set6_recovered_union",
    PLAN_SQL + """ SELECT source_id, count(*) FILTER (plan_pos % 2 = 1) + count(*) FILTER (plan_pos % 2 = 0) + count(*) FILTER (plan_pos = 0) AS proposals FROM plan GROUP BY source_id""",
)
def recovered_union(spark, sf):
    reused, todo, orphans = T.resume_split(_plan(spark, sf), _saved(spark, sf))
    rows = reused.select("source_id", "segment_indices", "title").unionByName(todo.select("source_id", "segment_indices", "title")).unionByName(orphans)
    unique = rows.withColumn("id", T.note_identity(F.col("segment_indices"), F.col("title"))).dropDuplicates(["source_id", "id"])
    return unique.groupBy("source_id").agg(F.count(F.lit(1)).alias("proposals"))


@query(
    "win8_planning_windows",
    MD_SQL + " SELECT source_id, segment_index, CAST(floor(segment_index / 3) AS BIGINT) AS window_index FROM md",
)
def planning_windows(spark, sf):
    return T.planning_windows(_segments(spark, sf), DEFAULTS.replace(planning_max_segments=3, planning_total_chars=10**9)).select("source_id", "segment_index", "window_index")


@query(
    "win8_planning_windows_by_characters",
    MD_SQL.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, sz AS (SELECT source_id, segment_index, least(length(text), 1600) AS ch FROM md),
 r AS (SELECT source_id, segment_index, 0 AS w, 1 AS n, ch AS used FROM sz WHERE segment_index = 0 UNION ALL
  SELECT sz.source_id, sz.segment_index, CASE WHEN r.n >= 400 OR r.used + sz.ch > 3000 THEN r.w + 1 ELSE r.w END, CASE WHEN r.n >= 400 OR r.used + sz.ch > 3000 THEN 1 ELSE r.n + 1 END,
   CASE WHEN r.n >= 400 OR r.used + sz.ch > 3000 THEN sz.ch ELSE r.used + sz.ch END FROM r JOIN sz ON sz.source_id = r.source_id AND sz.segment_index = r.segment_index + 1)
SELECT source_id, segment_index, CAST(w AS BIGINT) AS window_index FROM r""",
)
def planning_windows_chars(spark, sf):
    return T.planning_windows(_segments(spark, sf), DEFAULTS.replace(planning_total_chars=3000)).select("source_id", "segment_index", "window_index")


@query("prj22_plan_topics")
def plan_topics(spark, sf):
    segs = _segments(spark, sf)
    scores = segs.selectExpr("source_id", "segment_index", "(source_id + segment_index) % 3 = 0 AS is_novel", "false AS is_unknown")
    sources = table(spark, sf, "documents").selectExpr("doc_id AS source_id", "'Source ' || CAST(doc_id AS STRING) AS title")
    return T.plan_topics(sources, segs.select("source_id", "segment_index", "text"), scores).select("source_id", "topic_pos", "title", "is_novel", "rank")
