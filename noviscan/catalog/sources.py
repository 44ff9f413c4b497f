"""Segmenting, page and transcript ingest, source identities."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import MARKDOWN, PATH, RAW, markdown, raw_notes
from noviscan.config import DEFAULTS
from noviscan.functions import identity as D
from noviscan.functions import text as X
from noviscan.operators import chunking as C
from noviscan.operators import relevance as R
from noviscan.sources import notes as N
from noviscan.sources import segments as S
from noviscan.sources import transcripts as T
from noviscan.sources import web as W
from noviscan.sources.html import NOISE

WS = "' ' || chr(9) || chr(10) || chr(13)"
LINES_SQL = f"""WITH m AS (SELECT doc_id AS source_id, {MARKDOWN} AS text FROM documents),
 l0 AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM m),
 l AS (SELECT source_id, line, n FROM l0 WHERE NOT (line = '' AND n = total))"""
MD_SQL = LINES_SQL + f""",
 h AS (SELECT *, sum(CASE WHEN n = 1 OR regexp_matches(trim(line, {WS}), '^#{{1,3}}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY n) AS sec FROM l),
 g AS (SELECT *, floor((row_number() OVER (PARTITION BY source_id, sec ORDER BY n) - 1) / 25) AS part FROM h),
 s AS (SELECT source_id, min(n) AS line_start, max(n) AS line_end, trim(string_agg(line, chr(10) ORDER BY n), {WS}) AS text FROM g GROUP BY source_id, sec, part),
 md AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line_start) - 1 AS segment_index, line_start, line_end, text FROM s WHERE text <> '')"""


def longs(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


@query("src4_markdown_segments", MD_SQL + " SELECT source_id, segment_index, line_start, line_end, text FROM md")
def markdown_segments(spark, sf):
    return longs(S.text_segments(markdown(spark, sf), ["source_id"]), "segment_index", "line_start", "line_end")


@query(
    "src5_plain_segments",
    LINES_SQL + f""", b AS (SELECT *, CASE WHEN trim(line, {WS}) = '' THEN 1 ELSE 0 END AS blank FROM l),
 r AS (SELECT *, sum(blank) OVER (PARTITION BY source_id ORDER BY n) AS run FROM b),
 g AS (SELECT *, floor((row_number() OVER (PARTITION BY source_id, run ORDER BY n) - 1) / 25) AS part FROM r WHERE blank = 0)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY min(n)) - 1 AS segment_index, min(n) AS line_start, max(n) AS line_end,
 trim(string_agg(line, chr(10) ORDER BY n), {WS}) AS text FROM g GROUP BY source_id, run, part""",
)
def plain_segments(spark, sf):
    return longs(S.text_segments(markdown(spark, sf), ["source_id"], markdown=False), "segment_index", "line_start", "line_end")


CORPUS = f"{PATH.removesuffix(' ' + chr(39) + '.md' + chr(39))} CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END"


@query(
    "src6_text_corpus_load",
    f"""WITH f AS (SELECT doc_id, lang, {CORPUS} AS path, text, {RAW} AS raw FROM documents)
SELECT path AS source_ref, CASE WHEN doc_id % 2 = 0 THEN 'Note ' || doc_id WHEN doc_id % 5 = 0 THEN 'Shared' || (doc_id % 11) ELSE 'doc' || doc_id END AS title,
 CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'text' END AS source_type,
 CASE WHEN doc_id % 2 = 0 THEN 'inline/t' || (doc_id % 3) || '|lang/' || lang || '|topic' || (doc_id % 10) ELSE '' END AS tags,
 md5(CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(raw, '(?s)^---.*?\\n---\\n', ''), {WS}) ELSE trim(raw, {WS}) END) AS text_md5 FROM f""",
)
def corpus(spark, sf):
    files = table(spark, sf, "documents").selectExpr(f"{CORPUS} AS path", f"{RAW} AS raw")
    good, _ = N.text_corpus(files)
    return good.select("source_ref", "title", "source_type", joined(F.col("tags")).alias("tags"), F.md5("text").alias("text_md5"))


# What the SQL below takes out and decodes; the given pages hold nothing beyond these.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def _page_sql():
    c = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in NOISE:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    c = f"""regexp_replace({c}, '(?is)<div class="(?:ad|ads|advert|banner|cookie|sidebar)">.*?</div>', ' ', 'g')"""

    def plain(x):
        for entity, char in ENTITIES:
            x = "replace(%s, '%s', '%s')" % (x, entity, char.replace("'", "''"))
        return x

    steps = [
        ("\\s+", "' '"), ("(?i)<h1\\b[^>]*>", "chr(10) || chr(10) || '# '"), ("(?i)<h2\\b[^>]*>", "chr(10) || chr(10) || '## '"),
        ("(?i)<h[3-6]\\b[^>]*>", "chr(10) || chr(10) || '### '"), ("(?i)<li\\b[^>]*>", "chr(10) || '- '"), ("(?i)<br\\s*/?>", "chr(10)"),
        ("(?i)</?(?:p|div|section|table|tr|ul|ol|blockquote|h[1-6])\\b[^>]*>", "chr(10) || chr(10)"), ("<[^>]*>", "''"),
    ]
    body = "region"
    for pattern, to in steps:
        body = f"regexp_replace({body}, '{pattern}', {to}, 'g')"
    body = f"regexp_replace({plain(body)}, ' *\\n *', chr(10), 'g')"
    body = f"trim(regexp_replace({body}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"
    title = plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    title = f"trim(regexp_replace({title}, '\\s+', ' ', 'g'))"
    return f"""WITH c AS (SELECT page_id, url, html, {c} AS c FROM pages),
 r AS (SELECT *, coalesce(nullif(regexp_extract(c, '(?is)<article\\b[^>]*>(.*)</article>', 1), ''), nullif(regexp_extract(c, '(?is)<main\\b[^>]*>(.*)</main>', 1), ''),
  nullif(regexp_extract(c, '(?is)<body\\b[^>]*>(.*)</body>', 1), ''), c) AS region FROM c)
SELECT page_id, coalesce(nullif({title}, ''), url) AS title, {body} AS text FROM r"""


@query("src7_web_page_load", _page_sql())
def web_pages(spark, sf):
    return W.web_sources(table(spark, sf, "pages")).select("page_id", "title", "text")


@query(
    "src8_cue_windows",
    """WITH c AS (SELECT conv_id AS video_id, turn, 7 + (conv_id % 3) * 10 AS dur, floor(turn / [5, 3, 2][conv_id % 3 + 1]) AS w, text FROM conversations)
SELECT video_id, CAST(w AS BIGINT) AS window_index, trim(string_agg(text, ' ' ORDER BY turn)) AS text, CAST(min(turn) * 7 AS DOUBLE) AS ts_start, CAST(max(turn) * 7 + max(dur) AS DOUBLE) AS ts_end FROM c GROUP BY video_id, w""",
)
def windows(spark, sf):
    cues = table(spark, sf, "conversations").selectExpr(
        "conv_id AS video_id", "turn AS pos", "turn * 7.0D AS start", "7.0D + (conv_id % 3) * 10 AS duration", "text"
    )
    return longs(T.cue_windows(cues), "window_index")


VTT = (
    "'WEBVTT' || chr(10) || chr(10) || array_join(transform(split(text, '\\n'), (l, i) -> CAST(i + 1 AS STRING) || chr(10) || "
    "'00:' || lpad(CAST(floor(i * 5 / 60) AS STRING), 2, '0') || ':' || lpad(CAST(i * 5 % 60 AS STRING), 2, '0') || '.000 --> 01:00:00.500' || chr(10) || '<i>' || l || '</i>' || chr(10)), chr(10))"
)


@query(
    "src9_webvtt_cues",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i * 5 AS DOUBLE) AS start, greatest(0.0, 3600.5 - i * 5) AS duration, trim(regexp_replace(line, '\\s+', ' ', 'g'), {WS}) AS text FROM l WHERE trim(line, {WS}) <> ''""",
)
def vtt(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{VTT} AS content")
    return rows.select("doc_id", F.inline(T.vtt_cues(F.col("content"))))


PAGED = "CASE WHEN (conv_id + turn) % 5 = 0 THEN ' ' ELSE text END"


@query(
    "src10_extracted_page_ingest",
    f"""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, {PAGED} AS text FROM conversations)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS segment_index, trim(text, {WS}) AS text FROM p WHERE page <= 5 AND trim(text, {WS}) <> ''""",
)
def page_ingest(spark, sf):
    pages = table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn + 1 AS page", f"{PAGED} AS text")
    return S.page_segments(pages, DEFAULTS.replace(max_pages=5))[0]


@query(
    "src10_page_limit_warnings",
    """SELECT conv_id AS doc_id, 'pages: ' || count(*) || ' given, 5 kept' AS warning FROM conversations GROUP BY conv_id HAVING count(*) > 5""",
)
def page_warnings(spark, sf):
    pages = table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn + 1 AS page", "text")
    return S.page_segments(pages, DEFAULTS.replace(max_pages=5))[1]


def unreliable_sql(c: str) -> str:
    words = f"regexp_extract_all({c}, '[A-Za-z'']+')"
    good = f"list_filter({words}, lambda w: length(trim(lower(w), '''')) >= 3 AND regexp_matches(lower(w), '[aeiouy]'))"
    return f"(length({c}) < 80 OR len({words}) < 10 OR len({good}) / len({words}) < 0.55)"


@query(
    "src11_best_extraction_per_page",
    f"""WITH p AS (SELECT doc_id, trim(CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '[aeiouy]', 'q', 'g') ELSE text END, {WS}) AS a, trim(CASE WHEN doc_id % 3 = 0 THEN 'page ' || text ELSE text END, {WS}) AS b FROM documents),
 u AS (SELECT *, {unreliable_sql('a')} AND b <> '' AND (NOT {unreliable_sql('b')} OR length(b) > length(a)) AS used FROM p)
SELECT doc_id, CASE WHEN used THEN b ELSE a END AS text, used AS used_alternative FROM u""",
)
def best_page(spark, sf):
    d = table(spark, sf, "documents")
    first = d.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '[aeiouy]', 'q') ELSE text END AS text")
    other = d.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'page ' || text ELSE text END AS text")
    return S.best_page_text(first, other, ["doc_id"])


@query(
    "src12_chapter_ingest",
    MD_SQL + """ SELECT CAST(floor(source_id / 10) AS BIGINT) AS book_id, source_id % 10 + 1 AS chapter, line_start, line_end,
 row_number() OVER (PARTITION BY CAST(floor(source_id / 10) AS BIGINT) ORDER BY source_id % 10, segment_index) - 1 AS segment_index, md5(text) AS text_md5 FROM md""",
)
def chapters(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("CAST(floor(doc_id / 10) AS BIGINT) AS book_id", "doc_id % 10 + 1 AS chapter", f"{MARKDOWN} AS text")
    return longs(S.chapter_segments(rows), "line_start", "line_end").select("book_id", "chapter", "line_start", "line_end", "segment_index", F.md5("text").alias("text_md5"))


@query(
    "src13_timed_segments",
    f"""SELECT conv_id AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment_index, trim({PAGED}, {WS}) AS text,
 CAST(turn * 7 AS DOUBLE) AS ts_start, 'language/' || CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'fr' END AS tag FROM conversations WHERE trim({PAGED}, {WS}) <> ''""",
)
def timed(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr(
        "conv_id AS source_id", "turn", f"{PAGED} AS text", "turn * 7.0D AS ts_start", "CASE WHEN conv_id % 2 = 0 THEN ' en ' ELSE 'fr' END AS language"
    )
    return S.timed_segments(rows, "source_id", "turn").select(
        "source_id", "segment_index", "text", "ts_start", F.element_at(S.language_tags(F.col("language")), 1).alias("tag")
    )


REFS = """CASE doc_id % 9 WHEN 0 THEN 'a/b' || CAST(doc_id AS STRING) || '.MD' WHEN 1 THEN 'x.pdf' WHEN 2 THEN 'https://youtu.be/v' || CAST(doc_id AS STRING)
 WHEN 3 THEN ' https://www.youtube.com/watch?v=k' || CAST(doc_id AS STRING) || '&t=3 ' WHEN 4 THEN 'https://Ex.org/p/' || CAST(doc_id AS STRING) || '/?utm_source=q&b=1#f' WHEN 5 THEN 'c.epub'
 WHEN 6 THEN 'talk.mp3' WHEN 7 THEN 'notes.txt' ELSE 'bin.exe' END"""


def _refs(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{REFS} AS ref")


@query(
    "src14_source_routing",
    "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'youtube' WHEN 3 THEN 'youtube' WHEN 4 THEN 'web' WHEN 5 THEN 'epub' WHEN 6 THEN 'audio_video' WHEN 7 THEN 'text' END AS source_type FROM documents",
)
def routing(spark, sf):
    return _refs(spark, sf).select("doc_id", S.source_type(F.col("ref")).alias("source_type"))


@query(
    "src15_segment_defaulting",
    MD_SQL + f""" SELECT source_id, segment_index, text FROM md WHERE source_id % 4 <> 0
 UNION ALL SELECT source_id, 0, trim(text, {WS}) FROM m WHERE source_id % 4 = 0 AND trim(text, {WS}) <> ''""",
)
def defaulting(spark, sf):
    sources = markdown(spark, sf)
    segments = S.text_segments(sources, ["source_id"]).filter("source_id % 4 <> 0")
    return longs(S.default_segments(sources, segments), "segment_index")


@query(
    "src15_text_defaulting",
    MD_SQL + """, j AS (SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY segment_index) AS t FROM md GROUP BY source_id)
 SELECT m.source_id, md5(CASE WHEN m.source_id % 4 = 0 THEN coalesce(t, '') ELSE m.text END) AS text_md5 FROM m LEFT JOIN j USING (source_id)""",
)
def text_defaulting(spark, sf):
    sources = markdown(spark, sf)
    segments = S.text_segments(sources, ["source_id"])
    emptied = sources.withColumn("text", F.when(F.col("source_id") % 4 == 0, "").otherwise(F.col("text")))
    return S.default_texts(emptied, segments).select("source_id", F.md5("text").alias("text_md5"))


@query(
    "src16_cumulative_character_cap",
    MD_SQL + """, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM md)
 SELECT source_id, segment_index, substr(text, 1, CAST(500 - before AS INT)) AS text FROM b WHERE before < 500""",
)
def cap(spark, sf):
    segments = S.text_segments(markdown(spark, sf), ["source_id"]).select("source_id", "segment_index", "text")
    return longs(S.cap_characters(segments, 500), "segment_index")


@query(
    "src17_index_export",
    """SELECT vec_id AS chunk_id, 'notes/n' || label || '.md' AS note_path, (SELECT count(*) FROM embeddings) > 400 AS truncated FROM embeddings ORDER BY vec_id LIMIT 400""",
)
def export(spark, sf):
    from noviscan.catalog.inputs import index_chunks
    from noviscan.operators.index import export_chunks

    return export_chunks(index_chunks(spark, sf), 400).select("chunk_id", "note_path", "truncated")


CANONICAL_SQL = """lower(regexp_extract(u, '^([^:/?#]+):', 1)) || '://' || lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)) ||
 CASE WHEN p = '/' THEN p ELSE rtrim(p, '/') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END"""


@query(
    "fn9_canonical_web_url",
    """WITH p AS (SELECT page_id, url AS u, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p,
  list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_\\w+|fbclid|gclid|yclid|mc_cid|mc_eid|ref)=')) AS q FROM pages)
SELECT page_id, """ + CANONICAL_SQL + " AS canonical FROM p",
)
def canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", D.canonical_url(F.col("url")).alias("canonical"))


@query(
    "fn10_video_id",
    "SELECT doc_id, CASE doc_id % 9 WHEN 2 THEN 'v' || doc_id WHEN 3 THEN 'k' || doc_id END AS video_id FROM documents",
)
def video(spark, sf):
    return _refs(spark, sf).select("doc_id", D.video_id(F.col("ref")).alias("video_id"))


@query(
    "fn11_source_key",
    f"""SELECT doc_id, CASE doc_id % 9 WHEN 2 THEN 'youtube:v' || doc_id WHEN 3 THEN 'youtube:k' || doc_id WHEN 4 THEN 'web:https://ex.org/p/' || doc_id || '?b=1' ELSE trim({REFS}) END AS source_key,
 'upload:sha256:' || sha256(text) || ':f_' || doc_id AS upload_key FROM documents""",
)
def keys(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{REFS} AS ref", "text", "'up/f:' || CAST(doc_id AS STRING) AS filename")
    return d.select("doc_id", D.source_key(F.lit(None).cast("string"), F.col("ref")).alias("source_key"), D.upload_key(F.col("filename"), F.col("text")).alias("upload_key"))


@query("fn13_analysis_fingerprint", f"SELECT doc_id, sha256(text || chr(0) || '{DEFAULTS.analysis_settings_json()}') AS fingerprint FROM documents WHERE true")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.analysis_fingerprint(F.col("text"), DEFAULTS).alias("fingerprint"))


@query(
    "fn14_vault_token_and_space",
    "SELECT doc_id, substr(sha256('/vault/' || source), 1, 12) AS token, 'local_' || regexp_replace('org/' || lang || ' v' || doc_id, '[^a-zA-Z0-9_-]+', '_', 'g') AS space FROM documents",
)
def token(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", D.vault_token(F.concat(F.lit("/vault/"), "source")).alias("token"),
        D.space_suffix(F.lit("local"), F.concat(F.lit("org/"), "lang", F.lit(" v"), "doc_id")).alias("space"),
    )


@query(
    "flt6_unreliable_page_text",
    f"WITH t AS (SELECT doc_id, trim(text, {WS}) AS text FROM documents) SELECT doc_id, {unreliable_sql('text')} AS unreliable FROM t",
)
def unreliable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.unreliable_page(F.col("text")).alias("unreliable"))


@query(
    "agg14_extraction_quality",
    f"""WITH p AS (SELECT conv_id AS doc_id, trim(CASE WHEN conv_id % 4 = 0 THEN 'zz tq ' || text ELSE text END, {WS}) AS text FROM conversations
  UNION ALL SELECT conv_id, '' FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, '' FROM conversations WHERE conv_id % 3 = 0),
 w AS (SELECT *, regexp_extract_all(text, '[A-Za-z'']+') AS ws FROM p),
 s AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (text <> '') AS pages_with_text, sum(CASE WHEN text <> '' THEN length(text) + 2 ELSE 0 END) - 2 AS chars, sum(len(ws)) AS words,
  sum(len(list_filter(ws, lambda w: length(trim(lower(w), '''')) >= 3 AND regexp_matches(lower(w), '[aeiouy]')))) AS readable FROM w GROUP BY doc_id)
SELECT doc_id, page_count, pages_with_text, CAST(CASE WHEN pages_with_text = 0 THEN 0 ELSE (CASE WHEN page_count >= 2 AND pages_with_text / page_count < 0.4 THEN 1 ELSE 0 END)
 + (CASE WHEN page_count >= 2 AND pages_with_text >= 2 AND chars / page_count < 80 THEN 1 ELSE 0 END) + (CASE WHEN words >= 20 AND readable / words < 0.55 THEN 1 ELSE 0 END) END AS BIGINT) AS warnings FROM s""",
)
def extraction_quality(spark, sf):
    """All turns as pages; every third conversation has two blank pages more for each turn."""
    turns = table(spark, sf, "conversations")
    pages = turns.selectExpr("conv_id AS doc_id", "CASE WHEN conv_id % 4 = 0 THEN 'zz tq ' || text ELSE text END AS text")
    blank = turns.filter("conv_id % 3 = 0").selectExpr("conv_id AS doc_id", "' ' AS text")
    return R.extraction_quality(pages.unionByName(blank).unionByName(blank)).select("doc_id", "page_count", "pages_with_text", F.size("warnings").cast("long").alias("warnings"))


@query("prj1_heading_aware_chunker")
def chunker(spark, sf):
    return longs(C.explode_chunks(markdown(spark, sf), ["source_id"], "text"), "chunk_index")


@query("prj3_planning_segment_splitter")
def splitter(spark, sf):
    return C.planning_segments(S.text_segments(markdown(spark, sf), ["source_id"]), DEFAULTS.segment_target_chars)


@query("prj6_chunks_for_scoring")
def scoring(spark, sf):
    segments = C.planning_segments(S.text_segments(markdown(spark, sf), ["source_id"]), DEFAULTS.segment_target_chars)
    return longs(C.scoring_chunks(segments), "chunk_index")


SENTENCE_SQL = "list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, " + WS + ")), lambda s: s <> '')"


@query(
    "prj2_sentence_split",
    "WITH s AS (SELECT doc_id, " + SENTENCE_SQL.format(c="text") + """ AS s FROM documents),
 u AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM s),
 j AS (SELECT *, coalesce(regexp_matches(lag(sentence) OVER (PARTITION BY doc_id ORDER BY n), '(?i)(?:^|[^\\p{L}\\p{N}_])(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\\.g|i\\.e|[A-Z])\\.$'), false) AS glue FROM u),
 g AS (SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM j)
SELECT doc_id, k - 1 AS pos, string_agg(sentence, ' ' ORDER BY n) AS sentence FROM g GROUP BY doc_id, k""",
)
def sentence_split(spark, sf):
    return longs(
        table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences_keeping_abbreviations(F.col("text"))).alias("pos", "sentence")), "pos"
    )


@query("udf4_source_loaders", "SELECT 'd' || doc_id AS source_id, 'text' AS source_type FROM documents UNION ALL SELECT 'p' || page_id, 'web' FROM pages")
def loaders(spark, sf):
    from noviscan.udfs import load_sources

    return load_sources(
        [
            lambda s, d: table(s, d, "documents").selectExpr("'d' || doc_id AS source_id", "'text' AS source_type"),
            lambda s, d: table(s, d, "pages").selectExpr("'p' || page_id AS source_id", "'web' AS source_type"),
        ],
        spark, sf,
    )
