"""Filters, sentence scoring, text functions, media."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import MARKDOWN, PATH, markdown
from noviscan.catalog.sources import LINES_SQL, MD_SQL, SENTENCE_SQL, WS, longs
from noviscan.config import DEFAULTS
from noviscan.functions import links as L
from noviscan.functions import locations as P
from noviscan.functions import text as X
from noviscan.operators import evidence as E
from noviscan.operators import media as M
from noviscan.operators import merge as G
from noviscan.operators import proposals as O
from noviscan.operators import relevance as R
from noviscan.operators import titles as T
from noviscan.operators.ordering import settle
from noviscan.session import cut_lineage
from noviscan.sources import segments as S

# --- filters --------------------------------------------------------------------------------------

# Documents dressed with section names, tables of contents, link lists and legal lines.
DRESSED = (
    "CASE doc_id % 12 WHEN 0 THEN '## Chapter 3: Summary' || chr(10) || text WHEN 1 THEN 'References' || chr(10) || text "
    "WHEN 2 THEN 'Intro ..... 4' || chr(10) || 'Basics ..... 9' || chr(10) || 'More ..... 12' || chr(10) || 'End  iv' "
    "WHEN 3 THEN text || ' All Rights Reserved.' WHEN 4 THEN 'see http://a.b/' || CAST(doc_id AS STRING) || ' https://c.d www.e.f 12 34' "
    "WHEN 5 THEN 'For permissions write us. ' || text WHEN 6 THEN '[1] [2] [3] [4] [5] x' WHEN 7 THEN '### 1.2 Summary of gradient descent' || chr(10) || text ELSE text END"
)
# Titles lifted from documents.
TITLED = (
    "CASE doc_id % 8 WHEN 0 THEN 'Acknowledgements' WHEN 1 THEN '## 2. Further reading:' WHEN 2 THEN 'Chapter IV - FAQ' WHEN 3 THEN 'Overview ...... 7' "
    "WHEN 4 THEN 'Part 2: ' || substr(text, 1, 30) WHEN 5 THEN substr(text, 1, 70) || '  12' ELSE substr(text, 1, 40) END"
)

TOKENS = "list_filter(string_split_regex(trim({c}, " + WS + "), '\\s+'), lambda t: t <> '')"


def prose_sql(c: str) -> str:
    edge = "'[](){}.,;:!?\"''–-'"
    core = f"trim(t, {edge})"
    letters = f"length(regexp_replace({core}, '[^\\p{{L}}]', '', 'g'))"
    wordish = f"NOT regexp_matches(t, '^(?i)(?:https?://|www\\.)\\S+') AND length({core}) >= 2 AND {letters} >= 2 AND {letters} / length({core}) >= 0.6"
    tokens = TOKENS.format(c=c)
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE len(list_filter({tokens}, lambda t: {wordish})) / len({tokens}) END"


def any_of(c: str, phrases) -> str:
    return "(" + " OR ".join("contains(%s, '%s')" % (c, p.replace("'", "''")) for p in phrases) + ")"


def _sql_regex(p: str) -> str:
    return p.replace("'", "''").replace("(?U)", "")


DOT = _sql_regex(X.DOT_LEADER)
TOC = _sql_regex(R.TOC_LINE)
LOW_SQL = f"""(t = '' OR (len(regexp_extract_all(t, '(?i)(?:https?://|www\\.)\\S+')) >= 3 AND prose < 0.55) OR (len(regexp_extract_all(t, '\\[\\d{{1,4}}\\]')) >= 5 AND prose < 0.6)
 OR (length(t) >= 200 AND prose < 0.35) OR ({any_of('lower(t)', R.WATERMARKS)} AND prose < 0.5))"""
LABEL_LINES = f"list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(ltrim(trim(s, {WS}), '#'), {WS})), lambda s: s <> '')"


def label_sql(c: str) -> str:
    first = f"coalesce({LABEL_LINES.replace('(x,', '(' + c + ',')}[1], '')"
    bare = f"regexp_replace(regexp_replace({first}, '{_sql_regex(R.NUMBERING)}', ''), '{_sql_regex(R.ENUMERATION)}', '')"
    return f"trim(trim({bare}, ' :.-–' || chr(9)), {WS})"


TITLE_RULE = _sql_regex(R.BOILERPLATE_TITLE)
TOC_SQL = f"""(t <> '' AND (len(regexp_extract_all(t, '{DOT}')) >= 3 OR (len(ls) >= 4 AND len(list_filter(ls, lambda s: regexp_matches(s, '{TOC}'))) >= greatest(4, floor((len(ls) + 1) / 2)))))"""
LINES_OF = f"list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, {WS})), lambda s: s <> '')"
DRESSED_SQL = f"""WITH d0 AS (SELECT doc_id, trim({DRESSED}, {WS}) AS t FROM documents),
 d AS (SELECT doc_id, t, {prose_sql('t')} AS prose, {LINES_OF} AS ls, {label_sql('t')} AS label FROM d0),
 f AS (SELECT *, (regexp_matches(label, '{DOT}') OR regexp_matches(label, '{TOC}') OR (label <> '' AND length(label) <= 60 AND regexp_matches(label, '{TITLE_RULE}'))) AS titled,
   {TOC_SQL} AS toc, {LOW_SQL} AS low FROM d),
 b AS (SELECT *, t = '' OR titled OR toc OR low OR {any_of('lower(t)', R.CONTENT_MARKERS)} OR {any_of('lower(t)', R.CONTACT_PHRASES)} AS boiler FROM f)
"""


def _dressed(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{DRESSED} AS text")


@query("flt1_boilerplate_segment", DRESSED_SQL + "SELECT doc_id, boiler FROM b")
def boilerplate(spark, sf):
    return _dressed(spark, sf).select("doc_id", R.boilerplate(F.col("text")).alias("boiler"))


@query(
    "flt2_boilerplate_title",
    f"""WITH d0 AS (SELECT doc_id, trim({TITLED}, {WS}) AS t FROM documents), d AS (SELECT doc_id, t, {label_sql('t')} AS label FROM d0)
SELECT doc_id, regexp_matches(t, '{DOT}') OR regexp_matches(t, '{TOC}') OR (label <> '' AND length(label) <= 60 AND regexp_matches(label, '{TITLE_RULE}')) AS titled FROM d""",
)
def boilerplate_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.boilerplate_title(F.expr(TITLED)).alias("titled"))


@query("flt3_table_of_contents", DRESSED_SQL + "SELECT doc_id, toc FROM b")
def toc(spark, sf):
    return _dressed(spark, sf).select("doc_id", R.table_of_contents(F.col("text")).alias("toc"))


@query("flt4_low_value_text", DRESSED_SQL + "SELECT doc_id, low, round(prose, 6) AS prose FROM b")
def low_value(spark, sf):
    return _dressed(spark, sf).select("doc_id", R.low_value(F.col("text")).alias("low"), F.round(R.prose_ratio(F.col("text")), 6).alias("prose"))


@query(
    "flt5_keep_relevant",
    DRESSED_SQL + """, s AS (SELECT *, CAST(floor(doc_id / 3) AS BIGINT) AS source_id FROM b)
SELECT source_id, doc_id FROM s QUALIFY NOT boiler OR bool_and(boiler) OVER (PARTITION BY source_id)""",
)
def keep_relevant(spark, sf):
    rows = _dressed(spark, sf).withColumn("source_id", F.floor(F.col("doc_id") / 3))
    # Flags are costly and read twice: make them once, without the texts.
    flagged = cut_lineage(rows.select("source_id", "doc_id", R.boilerplate(F.col("text")).alias("boiler")))
    return R.keep_relevant(flagged, F.col("boiler")).select("source_id", "doc_id")


def _bounded(p: str) -> str:
    """Word boundaries around a group, spelled without look-around."""
    edge = "[^\\p{L}\\p{N}_]"
    p = p.replace("(?iU)", "(?i)").replace("(?U)", "")
    return p.replace("\\b(?:", f"(?:^|{edge})(?:").replace(")\\b", f")(?:$|{edge})").replace("'", "''")


NEG = f"regexp_matches(translate(text, '0123456789', ''), '{_bounded(R.NEGATION)}')"
UPDATE_PAIR = (
    "translate(text, '0123456789', '') || CASE doc_id % 4 WHEN 0 THEN ' It is not so in 2024.' WHEN 1 THEN ' Seen in 2024 and 2019.' WHEN 2 THEN ' Took 25 ms.' ELSE '' END",
    "translate(text, '0123456789', '') || CASE doc_id % 4 WHEN 0 THEN ' It is so in 2024.' WHEN 1 THEN ' Seen in 2025.' WHEN 2 THEN ' Took 40,5 ms.' ELSE '' END",
)


@query(
    "flt10_update_detector",
    f"""SELECT doc_id, CASE WHEN (doc_id % 7) / 7.0 < 0.5 THEN NULL WHEN doc_id % 4 = 0 THEN CASE WHEN {NEG} THEN NULL ELSE 'contradiction' END WHEN doc_id % 4 < 3 THEN 'update' END AS update_type,
 CASE WHEN (doc_id % 7) / 7.0 < 0.5 THEN NULL WHEN doc_id % 4 = 0 THEN CASE WHEN {NEG} THEN NULL ELSE 'one side negates' END WHEN doc_id % 4 = 1 THEN 'years: 2025 became 2019, 2024'
  WHEN doc_id % 4 = 2 THEN 'numbers changed' END AS update_reason FROM documents""",
)
def update_detector(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        "doc_id", f"{UPDATE_PAIR[0]} AS a", f"{UPDATE_PAIR[1]} AS b", "(doc_id % 7) / 7.0D AS s"
    )
    return d.withColumn("u", R.update_type(F.col("a"), F.col("b"), F.col("s"))).select("doc_id", "u.update_type", "u.update_reason")


PATHS = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/abs.md' WHEN 2 THEN 'a/../b.md' WHEN 3 THEN 'note.txt' WHEN 4 THEN 'x' || chr(9) || 'y.md' WHEN 5 THEN './' || source || '.md' ELSE source || '/' || lang || '.MD' END"


@query(
    "flt11_path_and_size_validation",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'note_path must not be empty' WHEN 1 THEN 'note_path must be vault-relative' WHEN 2 THEN 'note_path must not contain ''..''' WHEN 3 THEN 'note_path must be a .md file'
 WHEN 4 THEN 'note_path contains control characters' ELSE CASE WHEN n_chars > 2000 THEN 'note content exceeds 2000 characters' END END AS reason FROM documents""",
)
def validation(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{PATHS} AS note_path", "text")
    return d.select("doc_id", F.coalesce(G.path_problem(F.col("note_path")), G.content_problem(F.col("text"), 2000)).alias("reason"))


@query(
    "flt12_block_id_lines",
    LINES_SQL + f""", s AS (SELECT source_id, n, trim(line, {WS}) AS s FROM l)
SELECT source_id, count(*) AS eligible FROM s WHERE s <> '' AND NOT regexp_matches(s, '^#{{1,6}}\\s+') AND NOT starts_with(s, '```') AND NOT starts_with(s, '|') AND NOT starts_with(s, '---')
 AND NOT starts_with(s, '>') AND NOT regexp_matches(s, '\\s+\\^[a-zA-Z0-9-]+$') AND (regexp_matches(s, '^(?:[-*+]|\\d+\\.)\\s+') OR length(s) >= 24) GROUP BY source_id""",
)
def block_lines(spark, sf):
    m = markdown(spark, sf)
    count = F.size(F.filter(X.split_lines(F.col("text")), O.taggable_line))
    return m.select("source_id", count.cast("long").alias("eligible")).filter("eligible > 0")


def words_sql(c: str) -> str:
    stop = ", ".join("'%s'" % w.replace("'", "''") for w in X.STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN ({stop}))"


PAIR_SQL = f"""WITH p AS (SELECT doc_id, list_distinct({words_sql('substr(text, 1, 60)')}) AS a, list_distinct({words_sql("text")}) AS b FROM documents),
 j AS (SELECT *, len(list_intersect(a, b)) AS n FROM p),
 k AS (SELECT doc_id, len(a) AS la, len(b) AS lb, n, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE n / (len(a) + len(b) - n) END AS c FROM j)
"""


def _pairs(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "substr(text, 1, 60) AS title", "text AS body")


@query("flt13_grounded_title", PAIR_SQL + "SELECT doc_id, la > 0 AND lb > 0 AND (n / greatest(la, 1) >= 0.5 OR c >= 0.12) AS grounded FROM k")
def grounded_title(spark, sf):
    words = lambda c: F.array_distinct(X.content_words(F.col(c)))
    return _pairs(spark, sf).select("doc_id", X.grounded(words("title"), words("body")).alias("grounded"))


@query("agg25_title_body_coherence", PAIR_SQL + "SELECT doc_id, round(c, 6) AS coherence FROM k")
def coherence(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(X.coherence(F.col("title"), F.col("body")), 6).alias("coherence"))


@query(
    "flt14_rate_limit_messages",
    "SELECT event_id FROM events WHERE event_type = 'error' OR event_type = 'view' AND value > 50",
)
def rate_limit(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'error' THEN 'HTTP 429 at ' || CAST(user_id AS STRING) WHEN 'view' THEN CASE WHEN value > 50 THEN 'Resource Exhausted' ELSE 'ok' END WHEN 'click' THEN 'timeout' ELSE '' END AS message",
    )
    return e.filter(R.rate_limited(F.col("message"))).select("event_id")


PLANNER = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 80) ELSE 'unrelated planner words about nothing here' END"


@query(
    "flt17_planner_summary_acceptance",
    f"""WITH p AS (SELECT doc_id, trim({PLANNER}, {WS}) AS s, text, list_distinct({words_sql(PLANNER)}) AS a, list_distinct({words_sql('text')}) AS b FROM documents),
 j AS (SELECT *, len(list_intersect(a, b)) AS n FROM p)
SELECT doc_id, CASE WHEN s <> '' AND (trim(text) = '' OR (len(a) > 0 AND len(b) > 0 AND (n / greatest(len(a), 1) >= 0.5 OR n / (len(a) + len(b) - n) >= 0.12))) THEN s END AS accepted FROM j""",
)
def planner_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.accepted_planner_summary(F.expr(PLANNER), F.col("text")).alias("accepted"))


# --- sentence scoring -----------------------------------------------------------------------------

TABLE_RULE = _sql_regex(X.TABLE_LINE)
SYMBOLS = X.SYMBOL_RUN


def clean_sql(c: str) -> str:
    """Cleaned text: same steps on each paragraph."""
    lines = f"list_filter(string_split(p, chr(10)), lambda s: NOT regexp_matches(trim(s, {WS}), '{TABLE_RULE}'))"
    x = f"trim(array_to_string({lines}, chr(10)), {WS})"
    x = f"regexp_replace({x}, '\\s*\\n\\s*', ' ', 'g')"
    x = f"regexp_replace({x}, '{DOT}', ' ', 'g')"
    x = f"regexp_replace({x}, '{SYMBOLS}', ' ', 'g')"
    x = f"trim(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'), {WS})"
    return f"array_to_string(list_filter(list_transform(string_split_regex({c}, '\\n\\s*\\n'), lambda p: {x}), lambda p: p <> ''), chr(10) || chr(10))"


SCORED_SQL = f"""WITH c AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents),
 sa AS (SELECT doc_id, {SENTENCE_SQL.format(c='t')} AS ss, t FROM c),
 s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx, len(ss) AS total FROM sa),
 b AS (SELECT *, {words_sql('sentence')} AS ws FROM s),
 w AS (SELECT doc_id, idx, unnest(ws) AS word FROM b),
 fr AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
 pk AS (SELECT doc_id, max(n) AS peak FROM fr GROUP BY doc_id),
 ws AS (SELECT w.doc_id, w.idx, sum(fr.n / pk.peak) / sqrt(count(*)) AS raw FROM w JOIN fr ON fr.doc_id = w.doc_id AND fr.word = w.word JOIN pk ON pk.doc_id = w.doc_id GROUP BY w.doc_id, w.idx),
 sc AS (SELECT b.doc_id, b.idx, b.sentence, b.total, round(coalesce(raw, 0), 9) AS score FROM b LEFT JOIN ws USING (doc_id, idx))
"""


def _scored(spark, sf):
    return E.scored_text(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("agg15_sentence_scores", SCORED_SQL + "SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(round(score * 1e9) AS BIGINT) AS nano_score FROM sc")
def sentence_scores(spark, sf):
    rows = _scored(spark, sf).select("doc_id", F.posexplode("__scores").alias("idx", "score"))
    return longs(rows, "idx").select("doc_id", "idx", F.round(F.col("score") * 1e9).cast("long").alias("nano_score"))


@query(
    "srt2_extractive_summary",
    SCORED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM sc),
 j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS s FROM r WHERE rk <= 3 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(s) <= 600 THEN s ELSE rtrim(substr(s, 1, 597)) || '...' END AS summary FROM j""",
)
def summary(spark, sf):
    text = E.summary(F.col("__text"), F.col("__sents"), F.col("__scores"), 3, 600)
    return settle(_scored(spark, sf), summary=text).filter("summary <> ''").select("doc_id", "summary")


KEY_SQL = "array_to_string(regexp_extract_all(lower({c}), '[a-z0-9'']+'), ' ')"


@query(
    "srt3_key_points",
    SCORED_SQL + f""", x AS (SELECT doc_id, {KEY_SQL.format(c='sentence')} AS k FROM sc WHERE idx = 0),
 u AS (SELECT sc.*, {KEY_SQL.format(c='sentence')} AS k FROM sc WHERE length(sentence) >= 25),
 d AS (SELECT u.*, row_number() OVER (PARTITION BY u.doc_id, u.k ORDER BY score DESC, idx) AS dup FROM u WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = u.doc_id AND x.k = u.k)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM d WHERE dup = 1)
SELECT doc_id, string_agg(sentence, '|' ORDER BY idx) AS points FROM r WHERE rk <= 5 GROUP BY doc_id""",
)
def key_points(spark, sf):
    points = E.key_points(F.col("__sents"), F.col("__scores"), F.try_element_at("__sents", F.lit(1)))
    return settle(_scored(spark, sf), points=listed(points)).filter("points <> ''").select("doc_id", "points")


BONUS_SQL = " + ".join(f"(CASE WHEN regexp_matches(sentence, '{_bounded(p)}') THEN {w} ELSE 0 END)" for p, w in E.BONUSES)


@query(
    "srt4_evidence_layers",
    SCORED_SQL + f""", l3 AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM sc) WHERE rk <= 3 GROUP BY doc_id),
 l3t AS (SELECT doc_id, CASE WHEN length(s) <= 600 THEN s ELSE rtrim(substr(s, 1, 597)) || '...' END AS l3 FROM l3),
 ex AS (SELECT doc_id, unnest(list_transform({SENTENCE_SQL.format(c='l3')}, lambda q: {KEY_SQL.format(c='q')})) AS k FROM l3t),
 u AS (SELECT doc_id, idx, sentence, total, {KEY_SQL.format(c='sentence')} AS k, round(score + {BONUS_SQL}, 9) AS v FROM sc WHERE length(sentence) >= 30),
 fresh AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id = u.doc_id AND ex.k = u.k)),
 pool AS (SELECT * FROM fresh UNION ALL SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM fresh WHERE k <> '')),
 d AS (SELECT pool.*, row_number() OVER (PARTITION BY doc_id, k ORDER BY v DESC, idx) AS dup FROM pool WHERE k <> ''),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, idx) AS rk FROM d WHERE dup = 1),
 cl AS (SELECT *, CASE WHEN length(regexp_replace(sentence, '\\s+', ' ', 'g')) <= 220 THEN regexp_replace(sentence, '\\s+', ' ', 'g') ELSE rtrim(substr(regexp_replace(sentence, '\\s+', ' ', 'g'), 1, 217)) || '...' END AS clip FROM r)
SELECT doc_id, any_value(l3) AS l3, coalesce(string_agg(clip, '|' ORDER BY idx) FILTER (rk <= 7), '') AS l2, coalesce(string_agg(clip, '|' ORDER BY idx) FILTER (rk BETWEEN 8 AND 17), '') AS l1
FROM cl JOIN l3t USING (doc_id) GROUP BY doc_id""",
)
def evidence(spark, sf):
    packs = E.evidence_packs(table(spark, sf, "documents").select("doc_id", "text"))
    return packs.select("doc_id", "l3", listed(F.col("l2")).alias("l2"), listed(F.col("l1")).alias("l1")).filter("l2 <> ''")


@query("srt5_pack_to_budget")
def packed(spark, sf):
    packs = E.evidence_packs(table(spark, sf, "documents").select("doc_id", "text"))
    return packs.select(
        "doc_id", *[E.packed_prompt(F.col("l3"), F.col("l2"), F.col("l1"), F.col("media_hints"), n).alias(f"at_{n}") for n in (4000, 700, 200, 40)]
    )


@query(
    "srt10_excerpt_join",
    MD_SQL + f""", b AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY source_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM md),
 f AS (SELECT *, min(CASE WHEN used + length(text) > 300 THEN segment_index END) OVER (PARTITION BY source_id) AS stop FROM b),
 k AS (SELECT source_id, segment_index, CASE WHEN segment_index < stop OR stop IS NULL THEN text WHEN 300 - used <= 3 THEN substr(text, 1, CAST(300 - used AS INT)) ELSE rtrim(substr(text, 1, CAST(297 - used AS INT)), {WS}) || '...' END AS t
  FROM f WHERE segment_index < coalesce(stop, 1000000) OR (segment_index = stop AND used < 300))
SELECT source_id, string_agg(t, chr(10) || chr(10) ORDER BY segment_index) AS excerpt FROM k GROUP BY source_id""",
)
def excerpts(spark, sf):
    texts = F.transform(S.markdown_segments(F.col("text")), lambda s: s["text"])
    rows = settle(markdown(spark, sf).select("source_id", "text"), excerpt=E.fit_excerpts(texts, 300))
    return rows.filter("excerpt <> ''").select("source_id", "excerpt")


@query(
    "agg24_salient_ngram",
    f"""WITH c AS (SELECT doc_id, {words_sql(clean_sql('text'))} AS ws FROM documents),
 g AS (SELECT doc_id, ws, i, ws[i:i+2] AS tri FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM c WHERE len(ws) >= 3)),
 f AS (SELECT doc_id, array_to_string(tri, ' ') AS gram, count(*) AS n, min(i) AS at_pos FROM g WHERE len(list_filter(tri, lambda w: w IN ('{"', '".join(T.GENERIC)}'))) = 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_pos) AS k FROM f)
SELECT doc_id, lower(gram) AS gram FROM r WHERE k = 1""",
)
def ngram(spark, sf):
    gram = T.salient_ngram(X.clean_extractive(F.col("text")))
    d = settle(table(spark, sf, "documents").select("doc_id", "text"), gram=F.lower(gram))
    return d.filter("gram IS NOT NULL").select("doc_id", "gram")


# --- text functions -------------------------------------------------------------------------------


@query("fn15_truncate", f"SELECT doc_id, CASE WHEN length(trim(text, {WS})) <= 50 THEN trim(text, {WS}) ELSE rtrim(substr(trim(text, {WS}), 1, 47), {WS}) || '...' END AS short FROM documents")
def truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 50).alias("short"))


@query("fn16_clean_extractive_text", f"WITH m AS (SELECT doc_id, {MARKDOWN} AS text FROM documents) SELECT doc_id, {clean_sql('text')} AS cleaned FROM m")
def clean_text(spark, sf):
    return markdown(spark, sf).select(F.col("source_id").alias("doc_id"), X.clean_extractive(F.col("text")).alias("cleaned"))


HEADLINES = (
    "CASE doc_id % 6 WHEN 0 THEN '## 1.' || CAST(doc_id % 9 AS STRING) || ' ' || substr(text, 1, 40) WHEN 1 THEN 'Chapter ' || CAST(doc_id % 9 AS STRING) || ': ' || substr(text, 1, 90) "
    "WHEN 2 THEN lower(substr(text, 1, 30)) || ' (part ' || CAST(doc_id % 5 + 1 AS STRING) || ')' WHEN 3 THEN '- ' || substr(text, 1, 50) || ' ..... 14' WHEN 4 THEN '   ' ELSE substr(text, 1, 120) END"
)
_RE = lambda p: _sql_regex(p).replace("(?iU)", "(?i)")
COMPOSE_SQL = f"""WITH t AS (SELECT doc_id, trim({HEADLINES}, {WS}) AS t FROM documents),
 p AS (SELECT *, regexp_extract(regexp_extract(t, '{_RE(X.PART_SUFFIX)}', 0), '\\d+', 0) AS part, trim(regexp_replace(t, '{_RE(X.PART_SUFFIX)}', ''), {WS}) AS b FROM t),
 c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(ltrim(b, '#>*-•– ' || chr(9)), {WS}), '{DOT}', ' ', 'g'), '\\s+\\d{{1,4}}$', ''),
  '{_RE(X.TITLE_NUMBERING)}', ''), '{_RE(X.TITLE_ENUM)}', ''), '\\s{{2,}}', ' ', 'g'), ' .:-–' || chr(9)) AS x FROM p),
 k AS (SELECT *, CASE WHEN x = '' THEN 'Untitled concept' WHEN length(x) <= 72 THEN x ELSE coalesce(nullif(trim(regexp_replace(substr(x, 1, 72), '(?s) [^ ]*$', '')), ''), trim(substr(x, 1, 72))) END AS y FROM c)
SELECT doc_id, CASE WHEN regexp_matches(y, '^\\p{{Ll}}') THEN upper(y[1]) || y[2:] ELSE y END || CASE WHEN part <> '' THEN ' (part ' || part || ')' ELSE '' END AS title FROM k"""


@query("fn17_compose_title", COMPOSE_SQL)
def compose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.compose_title(F.expr(HEADLINES)).alias("title"))


@query(
    "fn24_first_line_title",
    f"""WITH m AS (SELECT doc_id, {MARKDOWN} AS text FROM documents),
 f AS (SELECT doc_id, trim(text, {WS}) AS t, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, {WS})), lambda s: s <> '' AND NOT starts_with(s, '#'))[1] AS l FROM m),
 r AS (SELECT doc_id, coalesce(trim(rtrim(l, '.'), {WS}), t) AS x FROM f)
SELECT doc_id, CASE WHEN x = '' THEN 'Untitled concept' WHEN length(x) <= 72 THEN x ELSE rtrim(substr(x, 1, 69), {WS}) || '...' END AS title FROM r""",
)
def line_title(spark, sf):
    return markdown(spark, sf).select(F.col("source_id").alias("doc_id"), X.first_line_title(F.col("text")).alias("title"))


@query(
    "fn23_append_target",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/' || source || '.md' WHEN 1 THEN 'b.md' WHEN 2 THEN NULL END AS path, CASE doc_id % 4 WHEN 0 THEN 'Part ' || doc_id END AS heading FROM documents",
)
def append_target(spark, sf):
    t = F.expr("CASE doc_id % 4 WHEN 0 THEN ' a/' || source || '.md# #Part ' || CAST(doc_id AS STRING) || ' ' WHEN 1 THEN 'b.md#' WHEN 2 THEN '' END")
    return table(spark, sf, "documents").select("doc_id", L.append_target_path(t).alias("path"), L.append_target_heading(t).alias("heading"))


@query(
    "fn25_report_values",
    "SELECT event_id, CASE WHEN event_type = 'click' THEN 'Not provided' ELSE event_type END AS kind, CASE WHEN event_type = 'error' THEN 'Yes' ELSE 'No' END AS failed, regexp_replace(regexp_replace(printf('%.3f', value), '0+$', ''), '\\.$', '') AS amount FROM events",
)
def report_values(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", O.report_value(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), "string").alias("kind"),
        O.report_value(F.col("event_type") == "error", "boolean").alias("failed"), O.report_value(F.col("value"), "double").alias("amount"),
    )


@query(
    "fn22_block_ids",
    LINES_SQL + f""", s AS (SELECT source_id, n, line, trim(line, {WS}) AS s FROM l),
 t AS (SELECT source_id, n, CASE WHEN s <> '' AND NOT regexp_matches(s, '^#{{1,6}}\\s+') AND NOT starts_with(s, '```') AND NOT starts_with(s, '|') AND NOT starts_with(s, '---') AND NOT starts_with(s, '>')
   AND NOT regexp_matches(s, '\\s+\\^[a-zA-Z0-9-]+$') AND (regexp_matches(s, '^(?:[-*+]|\\d+\\.)\\s+') OR length(s) >= 24)
   THEN rtrim(line, {WS}) || ' ^' || substr(sha256(source_id || '|' || (n - 1)), 1, 8) ELSE line END AS o FROM s)
SELECT source_id, md5(rtrim(string_agg(o, chr(10) ORDER BY n), {WS})) AS text_md5 FROM t GROUP BY source_id""",
)
def block_ids(spark, sf):
    tagged = O.with_block_ids(F.col("source_id").cast("string"), F.col("text"))
    return markdown(spark, sf).select("source_id", F.md5(X.rstrip(tagged)).alias("text_md5"))


# --- locations and media --------------------------------------------------------------------------


@query(
    "prj11_location_display",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'pages ' || user_id + 1 || '-' || user_id + 3 ELSE 'page ' || user_id + 1 END
 WHEN 1 THEN 'chapter ' || user_id || ', line 5' WHEN 2 THEN CASE WHEN user_id * 60 >= 3600 THEN CAST(floor(user_id * 60 / 3600) AS BIGINT) || ':' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') || ':00' ELSE user_id || ':00' END || '-' ||
  CASE WHEN user_id * 60 + 75 >= 3600 THEN CAST(floor((user_id * 60 + 75) / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor((user_id * 60 + 75) % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':15' ELSE CAST(floor((user_id * 60 + 75) / 60) AS BIGINT) || ':15' END
 ELSE 'unknown' END AS location FROM events""",
)
def location(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("event_id") % 4)
    u = F.col("user_id")
    at = {n: F.lit(None).cast(t) for n, t in S.LOCATION_FIELDS.items()}
    at["page"], at["page_end"] = F.when(F.col("k") == 0, u + 1), F.when(F.col("k") == 0, F.when(u % 2 == 0, u + 3).otherwise(u + 1))
    at["chapter"], at["line_start"] = F.when(F.col("k") == 1, u), F.when(F.col("k") == 1, 5)
    at["ts_start"], at["ts_end"] = F.when(F.col("k") == 2, u * 60.0), F.when(F.col("k") == 2, u * 60.0 + 75.5)
    return e.select("event_id", P.display(at).alias("location"))


CAPTIONED = "CASE doc_id % 4 WHEN 0 THEN 'Figure ' || CAST(doc_id AS STRING) || '-1: ' || substr(text, 1, 30) || chr(10) || text WHEN 1 THEN 'tbl. 3.2 ' || substr(text, 1, 260) || chr(10) || 'Table 9 ..... 12' ELSE text END"


@query(
    "fn19_captions",
    f"""WITH m AS (SELECT doc_id, {CAPTIONED} AS text FROM documents),
 l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {WS}) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m),
 h AS (SELECT *, regexp_extract(s, '(?i)^\\s*(figure|fig\\.?|table|tbl\\.?)\\s*([A-Za-z]?\\d+(?:[.\\-]\\d+)*)\\s*[:.\\)–-]?\\s*(.*)$', ['k', 'num', 'cap']) AS g FROM l
  WHERE length(s) <= 240 AND regexp_matches(s, '(?i)^\\s*(figure|fig\\.?|table|tbl\\.?)\\s*([A-Za-z]?\\d+(?:[.\\-]\\d+)*)\\s*[:.\\)–-]?\\s*(.*)$')),
 c AS (SELECT *, regexp_replace(trim(regexp_replace(g.cap, '{DOT}', ' ', 'g'), ' .–-' || chr(9)), '\\s{{2,}}', ' ', 'g') AS x FROM h)
SELECT doc_id, n AS line, CASE WHEN starts_with(lower(g.k), 'fig') THEN 'figure' ELSE 'table' END AS kind, CASE WHEN starts_with(lower(g.k), 'fig') THEN 'Figure ' ELSE 'Table ' END || g.num AS label,
 CASE WHEN regexp_matches(x, '^\\d+$') THEN '' WHEN length(x) > 200 THEN trim(regexp_replace(substr(x, 1, 200), '(?s) [^ ]*$', '')) || '...' ELSE x END AS caption FROM c""",
)
def captions(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{CAPTIONED} AS text")
    return longs(d.select("doc_id", F.inline(M.captions(F.col("text")))), "line")


TABLED = "text || chr(10) || '| a | b |' || chr(10) || '| --- | :--: |' || chr(10) || '| ' || CAST(doc_id AS STRING) || ' | x |' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '| y | z |' || chr(10) ELSE '' END || 'tail'"


@query(
    "fn20_markdown_tables",
    """SELECT doc_id, len(string_split(text, chr(10))) + 1 AS line_start, len(string_split(text, chr(10))) + 3 + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS line_end,
 '| a | b |' || chr(10) || '| --- | :--: |' || chr(10) || '| ' || doc_id || ' | x |' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '| y | z |' ELSE '' END AS markdown FROM documents""",
)
def md_tables(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{TABLED} AS text")
    rows = d.select("doc_id", F.inline(M.markdown_tables(F.col("text"))))
    return longs(rows, "line_start", "line_end").select("doc_id", "line_start", "line_end", "markdown")


@query(
    "fn21_cell_grid_to_markdown",
    """WITH c AS (SELECT conv_id, turn AS r, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '|', '\\|') AS v, role FROM conversations),
 n AS (SELECT conv_id, count(*) AS rows FROM c GROUP BY conv_id),
 l AS (SELECT conv_id, r, '| ' || role || ' | ' || v || ' |' || CASE WHEN r = 0 THEN chr(10) || '| --- | --- |' ELSE '' END AS line FROM c WHERE r < 4)
SELECT conv_id, CASE WHEN any_value(rows) >= 2 THEN string_agg(line, chr(10) ORDER BY r) || CASE WHEN any_value(rows) > 4 THEN chr(10) || '| _... ' || (any_value(rows) - 4) || ' more row(s) omitted_ |' ELSE '' END END AS markdown FROM l JOIN n USING (conv_id) GROUP BY conv_id""",
)
def grid(spark, sf):
    c = table(spark, sf, "conversations")
    cells = c.selectExpr("conv_id", "CAST(turn AS INT) AS row", "stack(2, 0, role, 1, text) AS (col, value)")
    return M.grid_to_markdown(cells, ["conv_id"], DEFAULTS.replace(media_table_rows=4))


# Media of a source: lines of its document that say something, as tables and captions by rule.
MEDIA_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 media AS (SELECT doc_id AS source_id, n AS item_order, CASE WHEN n % 3 = 0 THEN 'figure' ELSE 'table' END AS kind, 'L' || (n % 5) AS label, CASE WHEN n % 2 = 0 THEN 'cap ' || (n % 4) ELSE '' END AS caption,
  CASE WHEN n % 4 = 1 THEN '| ' || (n % 3) || ' |' END AS markdown, CAST(floor(n / 6) AS BIGINT) AS page, n AS line_start, n + 2 AS line_end FROM l)
"""


def _media(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    return d.selectExpr(
        "doc_id AS source_id", "n AS item_order", "CASE WHEN n % 3 = 0 THEN 'figure' ELSE 'table' END AS kind", "'L' || CAST(n % 5 AS STRING) AS label",
        "CASE WHEN n % 2 = 0 THEN 'cap ' || CAST(n % 4 AS STRING) ELSE '' END AS caption", "CASE WHEN n % 4 = 1 THEN '| ' || CAST(n % 3 AS STRING) || ' |' END AS markdown",
        "CAST(floor(n / 6) AS BIGINT) AS page", "n AS line_start", "n + 2 AS line_end",
    )


@query(
    "join11_caption_pairing",
    MEDIA_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY source_id, page ORDER BY item_order) AS nth FROM media WHERE kind = 'table' AND markdown IS NOT NULL),
 c AS (SELECT *, row_number() OVER (PARTITION BY source_id, page ORDER BY item_order) AS nth FROM media WHERE kind = 'table' AND markdown IS NULL)
SELECT t.source_id, t.item_order, coalesce(c.label, t.label) AS label, coalesce(c.caption, t.caption) AS caption FROM t LEFT JOIN c USING (source_id, page, nth)
UNION ALL SELECT source_id, item_order, label, caption FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = c.source_id AND t.page = c.page AND t.nth = c.nth)
UNION ALL SELECT source_id, item_order, label, caption FROM media WHERE kind = 'figure'""",
)
def pairing(spark, sf):
    return M.pair_captions(_media(spark, sf).select("source_id", "item_order", "kind", "label", "caption", "markdown", "page")).select("source_id", "item_order", "label", "caption")


@query(
    "win7_media_dedupe",
    MEDIA_SQL + "SELECT source_id, min(item_order) AS item_order, label FROM media GROUP BY source_id, kind, label, caption, markdown",
)
def media_dedupe(spark, sf):
    return M.dedupe_media(_media(spark, sf)).select("source_id", "item_order", "label")


@query(
    "join10_media_to_note_intervals",
    MEDIA_SQL + """, notes AS (SELECT source_id, item_order AS note_id, CASE WHEN item_order % 2 = 0 THEN page END AS page, CASE WHEN item_order % 2 = 0 THEN page + 1 END AS page_end, CASE WHEN item_order % 2 = 1 THEN line_start END AS line_start,
  CASE WHEN item_order % 2 = 1 THEN line_start + 9 END AS line_end FROM media WHERE item_order % 4 < 2),
 h AS (SELECT n.source_id, n.note_id, m.item_order, m.kind, m.label, m.caption, m.markdown FROM notes n JOIN media m ON m.source_id = n.source_id AND
  ((n.page IS NOT NULL AND m.page BETWEEN n.page AND n.page_end) OR (n.line_start IS NOT NULL AND m.line_start <= n.line_end AND m.line_end >= n.line_start))),
 d AS (SELECT *, row_number() OVER (PARTITION BY source_id, note_id, kind, label, caption, markdown ORDER BY item_order) AS dup FROM h),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_id, note_id ORDER BY item_order) AS media_rank FROM d WHERE dup = 1)
SELECT source_id, note_id, item_order, media_rank FROM r WHERE media_rank <= 4""",
)
def media_join(spark, sf):
    m = _media(spark, sf)
    notes = m.filter("item_order % 4 < 2").selectExpr(
        "source_id", "item_order AS note_id", "CASE WHEN item_order % 2 = 0 THEN page END AS page", "CASE WHEN item_order % 2 = 0 THEN page + 1 END AS page_end",
        "CASE WHEN item_order % 2 = 1 THEN line_start END AS line_start", "CASE WHEN item_order % 2 = 1 THEN line_start + 9 END AS line_end",
    )
    return longs(M.media_for_notes(notes, m).select("source_id", "note_id", "item_order", "media_rank"), "media_rank")
