"""Proposals, replies, merging, reports."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import PATH, markdown, notes, raw_notes
from noviscan.catalog.sources import WS, longs
from noviscan.config import DEFAULTS
from noviscan.functions import links as L
from noviscan.functions import locations as P
from noviscan.functions import text as X
from noviscan.operators import evidence as E
from noviscan.operators import merge as M
from noviscan.operators import prompts as Q
from noviscan.operators import proposals as O
from noviscan.operators import reports as R
from noviscan.sources import segments as S

SLUG_SQL = "coalesce(nullif(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}} _-]', '_', 'g'), '_'), ''), 'concept')"


@query(
    "prj8_note_output_path",
    f"SELECT doc_id, 'sources/' || {SLUG_SQL.format(c='substr(text, 1, 20)')} || '/' || {SLUG_SQL.format(c='substr(text, 10, 30)')} || '.md' AS nested, 'sources/2024-03-05-' || source || '.md' AS dated FROM documents",
)
def output_path(spark, sf):
    d = table(spark, sf, "documents")
    moment = F.to_timestamp(F.lit("2024-03-05 10:00:00"))
    args = (F.expr("substr(text, 1, 20)"), F.expr("substr(text, 10, 30)"), F.lit("text"), moment)
    dated = L.output_path(F.col("source"), F.col("lang"), F.lit("text"), moment, "sources", "nested", "{date}-{source_title}")
    return d.select("doc_id", L.output_path(*args, "sources", "nested").alias("nested"), dated.alias("dated"))


KINDS = "CASE doc_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'pdf' WHEN 2 THEN 'web' WHEN 3 THEN 'epub' ELSE 'text' END"


@query(
    "prj10_source_section",
    f"""SELECT doc_id, '## Source' || chr(10) || chr(10) || CASE doc_id % 5 WHEN 0 THEN '- Video: ref' || doc_id || chr(10) || '- Timestamp: w (`t=' || doc_id || '`)' WHEN 1 THEN '- Document: `ref' || doc_id || '`' || chr(10) || '- Location: w'
 WHEN 2 THEN '- Article: ref' || doc_id || chr(10) || '- Location: w (in extracted article text)' WHEN 3 THEN '- Book: `ref' || doc_id || '`' || chr(10) || '- Location: w' ELSE '- File: `ref' || doc_id || '`' || chr(10) || '- Location: w' END || chr(10) AS section FROM documents""",
)
def source_section(spark, sf):
    d = table(spark, sf, "documents")
    ref = F.concat(F.lit("ref"), "doc_id")
    return d.select("doc_id", O.source_section(F.expr(KINDS), ref, F.lit("w"), F.col("doc_id") + 0.7).alias("section"))


@query(
    "prj9_proposal_header",
    """SELECT doc_id, '---' || chr(10) || 'concept: Note ' || doc_id || chr(10) || 'source_type: text' || chr(10) || 'source_ref: ' || source || '/' || doc_id || '.md' || chr(10) || 'source: ' || source || '/' || doc_id || '.md' || chr(10) ||
 'source_location: lines 3-' || (5 + doc_id) || chr(10) || 'created: ''2024-01-01T00:00:00+00:00''' || chr(10) || 'type: atomic' || chr(10) || 'status: draft' || chr(10) || 'tags:' || chr(10) || '- source-import' || chr(10) || '- lang/' || lang || chr(10) ||
 'source_line_start: 3' || chr(10) || 'source_line_end: ' || (5 + doc_id) || chr(10) || '---' || chr(10) AS header FROM documents""",
)
def header(spark, sf):
    at = {n: F.lit(None).cast(t) for n, t in S.LOCATION_FIELDS.items()}
    at["line_start"], at["line_end"] = F.lit(3), (F.col("doc_id") + 5).cast("int")
    head = O.header(
        F.concat(F.lit("Note "), "doc_id"), F.lit("text"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")), P.display(at),
        F.lit("2024-01-01T00:00:00+00:00"), F.array(F.lit("source-import"), F.concat(F.lit("lang/"), "lang")), at,
    )
    return table(spark, sf, "documents").select("doc_id", head.alias("header"))


@query(
    "prj13_prompt_rows",
    """SELECT doc_id, starts_with(text, 'x') OR true AS fenced, length(regexp_replace(text || ' <<< UNTRUSTED_SOURCE >>> <<<end_untrusted_source>>>', '(?i)<<<\\s*(?:/?UNTRUSTED_SOURCE|END_UNTRUSTED_SOURCE)\\s*>>>', '[untrusted-marker-redacted]', 'g'))
 + length('<<<UNTRUSTED_SOURCE>>> source evidence' || chr(10)) + length(chr(10) || '<<<END_UNTRUSTED_SOURCE>>>') AS fenced_chars FROM documents""",
)
def prompt_rows(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", F.concat("text", F.lit(" <<< UNTRUSTED_SOURCE >>> <<<end_untrusted_source>>>")))
    prompt = Q.draft_prompt(F.col("lang"), F.col("source"), F.lit("text"), F.lit("line 1"), F.col("t"), F.array(F.lit("[[a]]")), F.lit(""))
    block = Q.fenced("source evidence", F.col("t"))
    return d.select("doc_id", prompt.contains(Q.fenced("source evidence", X.strip(F.col("t")))).alias("fenced"), F.length(block).cast("long").alias("fenced_chars"))


@query("prj13_planning_prompts")
def planning_prompts(spark, sf):
    from noviscan.operators.topics import planning_windows

    segs = longs(S.text_segments(markdown(spark, sf), ["source_id"]), "segment_index")
    windows = planning_windows(segs).join(segs.select("source_id", "segment_index", "text", F.concat(F.lit("line "), "line_start").alias("where")), ["source_id", "segment_index"])
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"), F.lit("text").alias("source_type"), F.lit("Novel").alias("verdict"))
    targets = segs.groupBy("source_id").agg(F.count(F.lit(1)).alias("target_notes"))
    return Q.planning_prompts(windows, sources, targets).select("source_id", "window_index", "prompt_chars")


# Replies: note blocks made of document text, every fourth one fenced, with a repeated id and an empty block.
REPLY = (
    "'preface' || chr(10) || '===NOTE 0===' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '```markdown' || chr(10) || text || chr(10) || '```' ELSE text END || chr(10) || '== note: 1 ==' || chr(10) || ' ' || chr(10) "
    "|| '===NOTE 1===' || chr(10) || 'second ' || lang || chr(10) || '===NOTE 0===' || chr(10) || 'late'"
)


@query(
    "prj14_delimited_replies",
    f"SELECT doc_id AS reply_id, '0' AS note_id, trim(text, {WS}) AS body FROM documents WHERE trim(text, {WS}) <> '' UNION ALL SELECT doc_id, '1', 'second ' || lang FROM documents",
)
def delimited(spark, sf):
    return Q.delimited_notes(table(spark, sf, "documents").selectExpr("doc_id AS reply_id", f"{REPLY} AS reply"))


# JSON replies in five states: clean, fenced, wrapped, trailing comma with smart quotes, cut off.
JSON_REPLY = (
    "CASE doc_id % 5 WHEN 0 THEN '[{\"title\": \"T' || CAST(doc_id AS STRING) || '\", \"body\": \"b\"}]' WHEN 1 THEN '```json' || chr(10) || '[{\"title\": \"T' || CAST(doc_id AS STRING) || '\", \"body\": \"line' || chr(10) || 'two\"}]' || chr(10) || '```' "
    "WHEN 2 THEN 'Sure! {\"notes\": [{\"title\": \"T' || CAST(doc_id AS STRING) || '\", \"body\": \"b\"}]} done' WHEN 3 THEN '[{“title”: “T' || CAST(doc_id AS STRING) || '”, \"body\": \"b\",},]' "
    "ELSE '[{\"title\": \"T' || CAST(doc_id AS STRING) || '\", \"body\": \"b\"}, {\"title\": \"cut' END"
)


@query("prj15_json_array_recovery", "SELECT doc_id AS reply_id, 'T' || doc_id AS title, CASE WHEN doc_id % 5 = 1 THEN 'line' || chr(10) || 'two' ELSE 'b' END AS body FROM documents")
def json_recovery(spark, sf):
    replies = table(spark, sf, "documents").selectExpr("doc_id AS reply_id", f"{JSON_REPLY} AS reply")
    return Q.reply_items(replies).select("reply_id", "title", "body")


CLAIM_REPLY = "CASE doc_id % 3 WHEN 0 THEN '```json {\"claims\": [\"' || lang || ' claim\", \" \"], \"terms\": [\"' || repeat(source, 60) || '\"]} ```' WHEN 1 THEN '{\"claims\": [], \"caveats\": []}' ELSE 'no json' END"


@query(
    "prj16_claims_objects",
    "SELECT doc_id, lang || ' claim' AS claims, substr(repeat(source, 60), 1, 200) AS terms, '' AS caveats FROM documents WHERE doc_id % 3 = 0",
)
def claims(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{CLAIM_REPLY} AS reply").withColumn("c", Q.claims(F.col("reply"))).filter("c IS NOT NULL")
    return d.select("doc_id", listed(F.col("c.claims")).alias("claims"), listed(F.col("c.terms")).alias("terms"), listed(F.col("c.caveats")).alias("caveats"))


@query(
    "join21_reply_to_topic_matching",
    """SELECT doc_id % 20 AS run_id, CAST(floor(doc_id / 100) AS BIGINT) AS batch, doc_id AS slot, CASE doc_id % 4 WHEN 0 THEN 'by id ' || doc_id WHEN 1 THEN 'by title ' || doc_id END AS body FROM documents""",
)
def reply_matching(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "doc_id % 20 AS run_id", "CAST(floor(doc_id / 100) AS BIGINT) AS batch", "doc_id AS slot", "'topic no ' || CAST(doc_id AS STRING) || ' x' AS title")
    by_id = d.filter("doc_id % 4 = 0").selectExpr("run_id", "batch", "0 AS at", "CAST(slot AS STRING) AS note_id", "'' AS title", "'by id ' || CAST(doc_id AS STRING) AS body")
    late = by_id.withColumn("at", F.lit(1)).withColumn("body", F.lit("late"))
    by_title = d.filter("doc_id % 4 = 1").selectExpr("run_id", "batch", "2 AS at", "CAST(NULL AS STRING) AS note_id", "upper(title) AS title", "'by title ' || CAST(doc_id AS STRING) AS body")
    return Q.match_replies(d.drop("doc_id"), by_id.unionByName(late).unionByName(by_title)).select("run_id", "batch", "slot", "body")


@query("prj17_draft_body")
def draft_body(spark, sf):
    packs = E.evidence_packs(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return packs.select("doc_id", O.draft_body(F.concat(F.lit("About "), "lang"), F.col("l3"), F.col("l2"), F.col("l1")).alias("body"))


BODY = (
    "'# Old' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || chr(10) || '* ONE' || chr(10) || text || chr(10) || '## Part' || chr(10) || '- one' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' || chr(10) "
    "|| '## Related notes' || chr(10) || chr(10) || '- [[x]]' || chr(10) || '- none' || chr(10) || chr(10) || '## Source' || chr(10) || '- gone'"
)


@query("fn18_refine_note_body")
def refine(spark, sf):
    return table(spark, sf, "documents").select("doc_id", O.refine_body(F.expr(BODY)).alias("body"))


@query(
    "fn18_concept_heading",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# Note ' || doc_id || chr(10) || rtrim(text, {WS}) ELSE '# Note ' || doc_id || chr(10) || chr(10) || trim(text, {WS}) END || chr(10) AS body FROM documents WHERE trim(text, {WS}) <> ''",
)
def concept_heading(spark, sf):
    body = F.expr("CASE WHEN doc_id % 2 = 0 THEN '# Old title' || chr(10) || text ELSE chr(10) || text END")
    return table(spark, sf, "documents").filter(~X.is_blank(F.col("text"))).select("doc_id", O.with_heading(body, F.concat(F.lit("Note "), "doc_id")).alias("body"))


@query("prj18_proposal_content")
def content(spark, sf):
    d = table(spark, sf, "documents")
    text = O.assemble(
        F.expr(BODY), F.concat(F.lit("Note "), "doc_id"), F.lit(None).cast("string"), F.array(F.lit("[[a]]")),
        O.source_section(F.lit("text"), F.col("source"), F.lit("line 1"), F.lit(None).cast("double")), F.lit("---\nconcept: x\n---\n"),
    )
    return d.select("doc_id", text.alias("content"))


@query(
    "set8_related_link_merge",
    f"""SELECT doc_id, 'Body ' || lang || chr(10) || chr(10) || '## Related notes' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- [[x]]' || chr(10) || '- [[' || source || ']]' || chr(10) ELSE '- [[' || source || ']]' || chr(10) END || chr(10) || '## Source' AS content FROM documents""",
)
def related_merge(spark, sf):
    body = F.expr("'Body ' || lang || chr(10) || chr(10) || '## Related notes' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- [[x]]' ELSE '- none' END || chr(10) || chr(10) || '## Source'")
    extra = F.array(F.concat(F.lit("[["), "source", F.lit("]]")), F.when(F.col("doc_id") % 2 == 0, "[[x]]").otherwise(F.concat(F.lit("[["), "source", F.lit("]]"))))
    return table(spark, sf, "documents").select("doc_id", O.add_related_links(body, F.array_distinct(extra)).alias("content"))


@query(
    "prj19_template_expansion",
    "SELECT doc_id, '# Note ' || doc_id || ' on 2024-03-05' || chr(10) || text || chr(10) || lang || ' {{unknown}} 2024-03-05 10:20' AS content FROM documents",
)
def template(spark, sf):
    moment = F.to_timestamp(F.lit("2024-03-05 10:20:00"))
    text = "# {{title}} on <% tp.date.now(\"YYYY\") %>\n{{body}}\n<% tp.frontmatter.lang %> {{unknown}} {{datetime}}"
    values = {"title": F.concat(F.lit("Note "), "doc_id"), "body": F.col("text"), "lang": F.col("lang")}
    return table(spark, sf, "documents").select("doc_id", O.expand_template(text, values, moment).alias("content"))


@query(
    "prj20_write_mode_decision",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'gate/' || source || '.md' END AS g, CASE WHEN doc_id % 4 = 0 THEN 'update' END AS u, CASE WHEN doc_id % 6 = 0 THEN 'gate/' || source || '.md' ELSE 'x.md' END AS a, source FROM documents),
 t AS (SELECT *, coalesce(g, CASE WHEN u IS NOT NULL THEN 'near.md' END) AS target FROM d)
SELECT doc_id AS query_id, CASE WHEN target = a THEN a ELSE 'p.md' END AS note_path, CASE WHEN (u IS NOT NULL AND target IS NOT NULL) OR target = a THEN 'append' ELSE 'write' END AS write_mode, target AS append_target,
 CASE WHEN g IS NOT NULL THEN 'G' WHEN u IS NOT NULL THEN 'N' END AS append_heading, CASE WHEN u IS NOT NULL THEN 'near.md' END AS update_target FROM t""",
)
def write_mode(spark, sf):
    d = table(spark, sf, "documents")
    proposals = d.selectExpr("doc_id AS query_id", "'p.md' AS note_path", "CASE WHEN doc_id % 6 = 0 THEN './Gate/' || source || '.md' ELSE 'x.md' END AS analysed_path")
    proposals = proposals.withColumn("analysed_path", F.lower("analysed_path"))
    targets = d.filter("doc_id % 3 = 0").selectExpr("doc_id AS query_id", "'gate/' || source || '.md' AS append_target", "'G' AS append_heading", "0.9D AS overlap_similarity")
    nearest = d.selectExpr("doc_id AS query_id", "'near.md' AS near_path", "'N' AS near_heading", "0.8D AS near_similarity", "CASE WHEN doc_id % 4 = 0 THEN 'update' END AS update_type", "'r' AS update_reason")
    return O.write_decisions(proposals, targets, nearest).select("query_id", "note_path", "write_mode", "append_target", "append_heading", "update_target")


@query(
    "prj23_result_projection",
    "SELECT doc_id, round((doc_id % 977) / 977.0, 3) AS best_similarity, substr(text, 1, 240) AS text_preview FROM documents",
)
def result_projection(spark, sf):
    from noviscan.plans.analysis import result_rows

    d = table(spark, sf, "documents")
    scores = d.selectExpr("doc_id AS query_id", "doc_id % 20 AS source_id", "(doc_id % 977) / 977.0D AS best_similarity")
    verdicts = d.selectExpr("doc_id % 20 AS source_id").distinct().selectExpr("source_id", "'Novel' AS verdict", "1.0D AS novelty_score")
    return result_rows(verdicts, scores, d.selectExpr("doc_id AS query_id", "text")).select(F.col("query_id").alias("doc_id"), "best_similarity", "text_preview")


@query(
    "win5_output_path_decollision",
    """WITH p AS (SELECT doc_id % 20 AS source_id, doc_id AS pos, lang || '/n' || (doc_id % 7) || '.md' AS note_path FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source_id, note_path ORDER BY pos) AS k FROM p)
SELECT source_id, pos, CASE WHEN k = 1 THEN note_path ELSE replace(note_path, '.md', '') || '-' || k || '.md' END AS free_path FROM n""",
)
def decollision(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id % 20 AS source_id", "doc_id AS pos", "lang || '/n' || CAST(doc_id % 7 AS STRING) || '.md' AS note_path")
    return O.free_paths(rows).select("source_id", "pos", "free_path")


@query(
    "agg27_map_of_content",
    """WITH p AS (SELECT CAST(floor(doc_id / 3) AS BIGINT) AS source_id, doc_id AS pos, source || '/' || lang || '.md' AS note_path FROM documents),
 l AS (SELECT source_id, note_path, min(pos) AS pos FROM p GROUP BY ALL), c AS (SELECT source_id, count(*) AS n FROM p GROUP BY source_id HAVING count(*) >= 2)
SELECT source_id, 'sources/S' || source_id || '/index.md' AS note_path, '# S' || source_id || ' — notes' || chr(10) || chr(10) || 'Index of ' || any_value(n) || ' note(s) imported from this source.' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) ||
 string_agg('- [[' || replace(l.note_path, '.md', '') || ']]', chr(10) ORDER BY pos) || chr(10) AS content FROM l JOIN c USING (source_id) GROUP BY source_id""",
)
def content_map(spark, sf):
    p = table(spark, sf, "documents").selectExpr("CAST(floor(doc_id / 3) AS BIGINT) AS source_id", "doc_id AS pos", "source || '/' || lang || '.md' AS note_path")
    sources = p.select("source_id").distinct().withColumn("title", F.concat(F.lit("S"), "source_id"))
    return O.content_maps(p, sources).select("source_id", "note_path", "content")


NOTE = (
    "CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) ELSE '' END || '# Note ' || CAST(doc_id % 3 AS STRING) || chr(10) || chr(10) || 'p' || regexp_replace(coalesce(text, ''), '[^A-Za-z]', 'x') || chr(10) || chr(10) "
    "|| repeat('- bullet of text' || chr(10), CAST(doc_id % 15 AS INT)) || CASE doc_id % 3 WHEN 0 THEN '## Related notes' || chr(10) || '- [[a]]' || chr(10) WHEN 1 THEN '## Related notes' || chr(10) || '- none [[b]]' || chr(10) ELSE '' END"
)


@query(
    "agg23_note_quality",
    f"""WITH n AS (SELECT doc_id, 1 + length(coalesce(text, '')) BETWEEN 40 AND 400 AS defined FROM documents),
 f AS (SELECT doc_id, defined, doc_id % 2 = 0 AS headed, doc_id % 3 = 1 AS titled, CAST(doc_id % 15 AS INT) + CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS bullets,
  (CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END) + 2 + CAST(doc_id % 15 AS INT) + (CASE WHEN doc_id % 3 < 2 THEN 2 ELSE 0 END) AS lines FROM n)
SELECT doc_id, round(((CASE WHEN headed THEN 1 ELSE 0 END) + (CASE WHEN titled THEN 1 ELSE 0 END) + (CASE WHEN defined THEN 1 ELSE 0 END) + (CASE WHEN bullets BETWEEN 2 AND 12 THEN 1 ELSE 0 END) + (CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0 END) + (CASE WHEN lines >= 8 THEN 1 ELSE 0 END)) / 6.0, 3) AS quality_score FROM f""",
)
def quality(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", O.quality(F.lit("note 1"), F.expr(NOTE))["quality_score"].alias("quality_score"))


@query("agg23_note_quality_flags")
def quality_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", listed(O.quality(F.lit("note 1"), F.expr(NOTE))["quality_flags"]).alias("flags"))


PROPOSED = ["doc_id AS pos", "CASE WHEN doc_id % 6 = 0 THEN '../bad.md' WHEN doc_id % 2 = 0 THEN {path} ELSE 'new/' || CAST(doc_id AS STRING) || '.md' END AS note_path".format(path=PATH),
            "'draft ' || lang AS content", "CASE WHEN doc_id % 4 < 2 THEN 'append' ELSE 'write' END AS mode", "doc_id % 8 = 2 AS overwrite", "CAST(NULL AS STRING) AS append_heading"]


@query(
    "snk6_merge_proposals_status",
    f"""SELECT doc_id AS pos, CASE WHEN doc_id % 6 = 0 THEN 'error' WHEN doc_id % 2 = 1 THEN 'written' WHEN doc_id % 4 = 0 THEN 'appended' WHEN doc_id % 8 = 2 THEN 'written' ELSE 'skipped_exists' END AS status,
 doc_id % 6 <> 0 AND doc_id % 8 = 2 AS overwritten FROM documents""",
)
def merge_status(spark, sf):
    p = table(spark, sf, "documents").selectExpr(*PROPOSED)
    return M.apply_proposals(p, raw_notes(spark, sf))[0].select("pos", "status", "overwritten")


@query(
    "snk6_same_path_in_order",
    """SELECT source || '.md' AS note_path, md5('base' || chr(10) || chr(10) || string_agg('## Update' || chr(10) || chr(10) || 'd' || doc_id, chr(10) || chr(10) ORDER BY doc_id) || chr(10)) AS text_md5 FROM documents GROUP BY source""",
)
def same_path(spark, sf):
    # Every document is appended to the note of its source.
    d = table(spark, sf, "documents")
    existing = d.selectExpr("source || '.md' AS note_path", "'base' AS raw").distinct()
    p = d.selectExpr("doc_id AS pos", "source || '.md' AS note_path", "'d' || CAST(doc_id AS STRING) AS content", "'append' AS mode", "false AS overwrite", "CAST(NULL AS STRING) AS append_heading")
    return M.apply_proposals(p, existing)[1].select("note_path", F.md5("raw").alias("text_md5"))


@query(
    "snk7_append_under_heading",
    f"""SELECT doc_id, '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || 'intro' || chr(10) || '## One' || chr(10) || trim(x, {WS}) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Update' || chr(10) || chr(10) || 'new ' || lang ELSE '' END || chr(10) || chr(10) ||
 '## Two' || chr(10) || 'tail' || CASE WHEN doc_id % 2 = 1 THEN chr(10) || chr(10) || '## Update' || chr(10) || chr(10) || 'new ' || lang ELSE '' END || chr(10) AS content FROM (SELECT *, source || ' text' AS x FROM documents)""",
)
def append_under(spark, sf):
    existing = F.expr("'---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || 'intro' || chr(10) || '# One' || chr(10) || source || ' text' || chr(10) || chr(10) || '### Two' || chr(10) || 'tail' || chr(10)")
    heading = F.when(F.col("doc_id") % 2 == 0, "  one ").otherwise("TWO")
    draft = F.concat(F.lit("---\nt: x\n---\nnew "), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", M.merged_content(existing, draft, heading).alias("content"))


@query(
    "snk10_markdown_report",
    """SELECT doc_id AS source_id, '# Novelty report' || chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || '- **Title:** ' || lang || chr(10) || '- **Type:** text' || chr(10) || '- **Reference:** ' || source || chr(10) || chr(10) ||
 '## Novelty' || chr(10) || chr(10) || '- **Verdict:** Novel' || chr(10) || '- **Novelty score:** 0.5' || chr(10) || '- **Novel chunks:** ' || (doc_id % 4) || chr(10) || '- **Known chunks:** 0' || chr(10) || chr(10) ||
 '## Overlaps' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- **O' || doc_id || ':** {"note_path":"p.md","max_similarity":0.5}' ELSE '- **Summary:** None reported' END || chr(10) || chr(10) ||
 '## Suggestions' || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '- **C' || doc_id || ':** {"note_path":"n.md","quality_score":0.75}' || chr(10) || '- **Quality:** 0.75' ELSE '- **Quality:** Not provided' END || chr(10) || '- **Duplicates:** None reported' || chr(10) AS report FROM documents""",
)
def markdown_report(spark, sf):
    return R.markdown_reports(_report_rows(spark, sf))


def _report_rows(spark, sf):
    d = table(spark, sf, "documents")
    sources = d.selectExpr("doc_id AS source_id", "lang AS title", "'text' AS source_type", "source AS source_ref")
    verdicts = d.selectExpr("doc_id AS source_id", "'Novel' AS verdict", "0.5D AS novelty_score", "doc_id % 4 AS novel_chunks", "0 AS known_chunks")
    overlap = d.filter("doc_id % 2 = 0").selectExpr("doc_id AS source_id", "0 AS pos", "'p.md' AS note_path", "'O' || CAST(doc_id AS STRING) AS note_title", "0.5D AS max_similarity")
    made = d.filter("doc_id % 3 = 0").selectExpr("doc_id AS source_id", "0 AS pos", "'C' || CAST(doc_id AS STRING) AS concept_title", "'n.md' AS note_path", "0.75D AS quality_score", "CAST(NULL AS STRING) AS duplicate_of")
    return R.report_rows(sources, verdicts, overlap, made)


def _dt(label: str, value: str) -> str:
    return f"'<dt>' || {label} || '</dt><dd>' || {value} || '</dd>'"


JSON_OF = "'{{&quot;note_path&quot;:&quot;{0}&quot;,&quot;{1}&quot;:{2}}}'"


@query(
    "snk10_html_report",
    f"""SELECT doc_id AS source_id, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Novelty report</title></head><body><h1>Novelty report</h1>' ||
 '<section><h2>Source</h2><dl>' || {_dt("'Title'", "lang")} || {_dt("'Type'", "'text'")} || {_dt("'Reference'", "source")} || '</dl></section>' ||
 '<section><h2>Novelty</h2><dl>' || {_dt("'Verdict'", "'Novel'")} || {_dt("'Novelty score'", "'0.5'")} || {_dt("'Novel chunks'", "(doc_id % 4)")} || {_dt("'Known chunks'", "'0'")} || '</dl></section>' ||
 '<section><h2>Overlaps</h2><dl>' || CASE WHEN doc_id % 2 = 0 THEN {_dt("'O' || doc_id", JSON_OF.format("p.md", "max_similarity", "0.5"))} ELSE {_dt("'Summary'", "'None reported'")} END || '</dl></section>' ||
 '<section><h2>Suggestions</h2><dl>' || CASE WHEN doc_id % 3 = 0 THEN {_dt("'C' || doc_id", JSON_OF.format("n.md", "quality_score", "0.75"))} || {_dt("'Quality'", "'0.75'")} ELSE {_dt("'Quality'", "'Not provided'")} END ||
 {_dt("'Duplicates'", "'None reported'")} || '</dl></section></body></html>' AS report FROM documents""",
)
def html_report(spark, sf):
    return R.html_reports(_report_rows(spark, sf))


@query(
    "snk10_html_escaping",
    "SELECT doc_id, replace(replace(replace(replace(replace(text || '<b>\"q\"&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents",
)
def escaping(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.html_escape(F.concat("text", F.lit("<b>\"q\"&'"))).alias("escaped"))


@query(
    "snk13_analysis_state_round_trip",
    "SELECT doc_id AS source_id, 'Novel' AS verdict, (doc_id % 100) / 100.0 AS novelty_score, lang AS tags FROM documents",
)
def state_round_trip(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id AS source_id", "'Novel' AS verdict", "(doc_id % 100) / 100.0D AS novelty_score", "array(lang) AS tags")
    stored = d.select(F.to_json(F.struct(*d.columns)).alias("state"))
    back = stored.select(F.from_json("state", "source_id long, verdict string, novelty_score double, tags array<string>").alias("s")).select("s.*")
    return back.withColumn("tags", listed(F.col("tags")))


@query("udf3_completion_provider", "SELECT doc_id, upper(lang) || ' ' || length(text) AS reply FROM documents")
def completion(spark, sf):
    from noviscan.udfs import complete

    def provider(batches):
        for pdf in batches:
            yield pdf.assign(reply=pdf["lang"].str.upper() + " " + pdf["text"].str.len().astype(str), error=None, input_tokens=1, output_tokens=1)

    return complete(table(spark, sf, "documents").select("doc_id", "lang", "text"), provider).select("doc_id", "reply")


@query(
    "udf5_rule_packs",
    "SELECT lang AS domain, string_agg('- ' || 'rule ' || source, chr(10) ORDER BY source) AS rules FROM (SELECT DISTINCT lang, source FROM documents) WHERE lang = 'fr' GROUP BY lang",
)
def rule_packs(spark, sf):
    rules = table(spark, sf, "documents").selectExpr("lang AS domain", "source").distinct().selectExpr("domain", "source AS pos", "'rule ' || source AS rule")
    return Q.rule_lines(rules, " FR ").select(F.lit("fr").alias("domain"), "rules")
