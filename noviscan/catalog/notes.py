"""Notes, links, graph, index maintenance."""

from pyspark.sql import functions as F

from noviscan.catalog.base import joined, listed, query, table
from noviscan.catalog.inputs import (
    ALIAS, CONTENT, EMBED, FOLDER, LINK_A, LINK_B, LINKS_SQL, MTIME, NOTES_SQL, PATH, RAW, STEM, TAGS, index_chunks, notes, raw_notes,
)
from noviscan.catalog.sources import WS, longs
from noviscan.config import DEFAULTS
from noviscan.functions import identity as D
from noviscan.functions import links as L
from noviscan.functions import text as X
from noviscan.operators import index as I
from noviscan.operators import links as G
from noviscan.operators.ordering import one_row
from noviscan.session import shared_folder
from noviscan.sources import notes as N

NOTES_CTE = f"WITH notes AS ({NOTES_SQL}), links AS ({LINKS_SQL})"
# Names and path keys, then the target of every link.
RESOLVED_SQL = NOTES_CTE + """,
 names AS (SELECT name, min(note_path) AS p FROM (SELECT note_path, lower(title) AS name FROM notes UNION ALL SELECT note_path, lower(alias) FROM notes WHERE alias <> '') GROUP BY name HAVING count(DISTINCT note_path) = 1),
 paths AS (SELECT lower(replace(note_path, '.md', '')) AS k, min(note_path) AS p FROM notes GROUP BY 1),
 clean AS (SELECT *, regexp_replace(regexp_replace(link, '#.*', ''), '(?i)\\.md$', '') AS c FROM links),
 resolved AS (SELECT clean.note_path, pos, link, CASE WHEN contains(c, '/') THEN paths.p ELSE names.p END AS target FROM clean
   LEFT JOIN names ON names.name = lower(c) LEFT JOIN paths ON paths.k = lower(c)),
 edges AS (SELECT note_path AS src, target AS dst, max_by(link, pos) AS label FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2)
"""


@query("src1_vault_scan")
def scan(spark, sf):
    # The given tables are parquet, so the folder is a set of paths: system and template folders are mixed in by rule.
    files = raw_notes(spark, sf).withColumn(
        "note_path",
        F.expr("CASE doc_id % 13 WHEN 0 THEN '.obsidian/' || note_path WHEN 1 THEN 'Templates/' || note_path ELSE note_path END"),
    )
    return N.parse_notes(files.filter(~N.skipped_path(F.col("note_path")))).select("note_path", "title", listed(F.col("wikilinks")).alias("wikilinks"))


@query(
    "src1_skip_rules",
    f"SELECT {PATH} AS note_path FROM documents WHERE doc_id % 13 > 2",
)
def skip_rules(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        f"CASE doc_id % 13 WHEN 0 THEN '.obsidian/' || {PATH} WHEN 1 THEN 'Templates/' || {PATH} WHEN 2 THEN 'a/.h' || CAST(doc_id AS STRING) || '.md' ELSE {PATH} END AS note_path"
    )
    return d.filter(~N.skipped_path(F.col("note_path")))


@query(
    "src2_note_lookup",
    NOTES_CTE + f", w AS (SELECT {FOLDER} || '/doc' || doc_id || '.md' AS note_path FROM documents) SELECT w.note_path, title FROM w LEFT JOIN notes USING (note_path)",
)
def lookup(spark, sf):
    wanted = table(spark, sf, "documents").selectExpr(f"{FOLDER} || '/doc' || CAST(doc_id AS STRING) || '.md' AS note_path")
    return N.lookup_notes(notes(spark, sf), wanted).select("note_path", "title")


@query(
    "src3_frontmatter_and_body",
    f"SELECT doc_id, md5(trim({CONTENT}, {WS})) AS body_md5, 'Note ' || doc_id AS header_title FROM documents",
)
def frontmatter(spark, sf):
    parsed = N.parse_notes(raw_notes(spark, sf))
    return parsed.select("doc_id", F.md5("content").alias("body_md5"), F.get_json_object(F.col("frontmatter")["title"], "$").alias("header_title"))


@query(
    "fn5_wikilinks_and_embeds",
    f"SELECT doc_id, CASE WHEN {LINK_A} = {EMBED} THEN {LINK_A} ELSE {LINK_A} || '|' || {EMBED} END AS links, {EMBED} AS embeds FROM documents",
)
def wikilinks(spark, sf):
    n = notes(spark, sf)
    return n.select("doc_id", listed(L.body_links(F.col("content"))).alias("links"), listed(L.body_embeds(F.col("content"))).alias("embeds"))


@query("fn6_inline_tags", "SELECT doc_id, 'inline/t' || (doc_id % 3) AS tags FROM documents")
def inline_tags(spark, sf):
    coded = F.concat(F.lit("```py\n#no\n```\n`#code` "), F.col("content"))
    return notes(spark, sf).select("doc_id", listed(L.body_tags(coded)).alias("tags"))


@query(
    "fn7_header_tags_and_aliases",
    f"SELECT doc_id, {TAGS[0]} || '|' || {TAGS[1]} AS tags, {ALIAS} AS aliases FROM documents",
)
def header_strings(spark, sf):
    p = N.parse_notes(raw_notes(spark, sf))
    return p.select("doc_id", listed(L.header_tags(F.col("frontmatter"))).alias("tags"), listed(F.col("aliases")).alias("aliases"))


@query("set1_tag_union", f"SELECT doc_id, {TAGS[0]} || '|' || {TAGS[1]} || '|inline/t' || (doc_id % 3) AS tags FROM documents")
def tag_union(spark, sf):
    return N.parse_notes(raw_notes(spark, sf)).select("doc_id", listed(F.col("tags")).alias("tags"))


@query(
    "set2_link_union",
    NOTES_CTE + " SELECT note_path, string_agg(link, '|' ORDER BY pos) AS links FROM links GROUP BY note_path",
)
def link_union(spark, sf):
    return N.parse_notes(raw_notes(spark, sf)).select("note_path", listed(F.col("wikilinks")).alias("links"))


@query(
    "fn8_link_normalization",
    NOTES_CTE + """ SELECT note_path, pos, regexp_replace(regexp_replace(link, '#.*', ''), '(?i)\\.md$', '') AS clean, '[[' || regexp_replace(note_path, '\\.md$', '') || ']]' AS formatted FROM links""",
)
def normalized(spark, sf):
    rows = notes(spark, sf).select("note_path", F.posexplode("wikilinks").alias("pos", "link"))
    return longs(rows.select("note_path", "pos", L.normalize_link(F.col("link")).alias("clean"), L.format_link(F.concat(F.lit("./"), "note_path")).alias("formatted")), "pos")


@query("join3_wikilink_resolution", RESOLVED_SQL + "SELECT note_path, CAST(pos AS BIGINT) AS pos, link, target FROM resolved")
def resolution(spark, sf):
    return _link_rows(spark, sf)


def _link_rows(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        f"{PATH} AS note_path", f"stack(3, 0, {LINK_A}, 1, {EMBED}, 2, {LINK_B}) AS (pos, link)", f"{LINK_A} AS a", f"{EMBED} AS e"
    )
    rows = d.filter("pos = 0 OR (pos = 1 AND link <> a) OR (pos = 2 AND link <> a AND link <> e)").select("note_path", "pos", "link")
    return longs(G.resolve_links(rows, notes(spark, sf)), "pos").select("note_path", "pos", "link", "target")


@query(
    "join6_link_status",
    RESOLVED_SQL + "SELECT note_path, link AS target, target AS path, target IS NOT NULL AS resolved FROM resolved",
)
def link_status(spark, sf):
    rows = notes(spark, sf).select(F.col("note_path").alias("owner"), F.explode("wikilinks").alias("link"))
    return G.resolve_links(rows, notes(spark, sf)).select(
        F.col("owner").alias("note_path"), F.col("link").alias("target"), F.col("target").alias("path"), F.col("target").isNotNull().alias("resolved")
    )


@query("join4_link_graph", RESOLVED_SQL + "SELECT src, dst, label FROM edges")
def graph(spark, sf):
    return G.graph_edges(notes(spark, sf))


@query(
    "join5_neighbourhood",
    RESOLVED_SQL + """, seeds AS (SELECT DISTINCT names.p FROM benchmark JOIN names ON names.name = 'doc' || item_id)
SELECT p AS note_path FROM seeds UNION SELECT src FROM edges WHERE dst IN (SELECT p FROM seeds) UNION SELECT dst FROM edges WHERE src IN (SELECT p FROM seeds)""",
)
def neighbourhood(spark, sf):
    # Seeds are titles made of the ids of the benchmark table.
    n = notes(spark, sf)
    seeds = table(spark, sf, "benchmark").selectExpr("'doc' || CAST(item_id AS STRING) AS title")
    return G.neighbourhood(seeds, n, G.graph_edges(n))


@query(
    "join7_transclusion",
    RESOLVED_SQL + f""", e AS (SELECT n.note_path, n.embed, r.p AS target FROM notes n JOIN names r ON r.name = lower(n.embed))
SELECT e.note_path, '[Transcluded: ' || e.embed || ']' || chr(10) || CASE WHEN length(trim(t.content, {WS})) > 400 THEN rtrim(substr(trim(t.content, {WS}), 1, 399), {WS}) || '…' ELSE trim(t.content, {WS}) END AS excerpt
FROM e JOIN notes t ON t.note_path = e.target""",
)
def transclusion(spark, sf):
    return G.transclusions(notes(spark, sf)).select("note_path", listed(F.col("excerpts")).alias("excerpt"))


@query(
    "agg8_duplicate_stems",
    NOTES_CTE + " SELECT lower(title) AS stem, count(*) AS notes, min(note_path) AS first_path, max(note_path) AS last_path FROM notes GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_stems(spark, sf):
    return G.duplicate_stems(notes(spark, sf))


def _stored_graph(spark, sf):
    """The graph as it was before notes with doc_id % 10 = 0 were added and those with % 10 = 1 removed."""
    n = notes(spark, sf)
    before = n.filter("doc_id % 10 <> 0")
    after = n.filter("doc_id % 10 <> 1")
    return before, after


@query(
    "snk4_graph_upsert",
    RESOLVED_SQL.replace(f"WITH notes AS ({NOTES_SQL})", f"WITH notes AS (SELECT * FROM ({NOTES_SQL}) WHERE doc_id % 10 <> 1)") + "SELECT src, dst FROM edges",
)
def graph_upsert(spark, sf):
    before, after = _stored_graph(spark, sf)
    touched = notes(spark, sf).filter("doc_id % 10 < 2").select("note_path")
    return G.upsert_graph(G.graph_nodes(before), G.graph_edges(before), after, touched)[1].select("src", "dst")


@query("snk5_graph_tables", RESOLVED_SQL + "SELECT src, dst FROM edges")
def graph_tables(spark, sf):
    import tempfile

    root = _scratch(spark)
    I.write_snapshot(G.graph_edges(notes(spark, sf)), f"{root}/edges", "1")
    return I.read_snapshot(spark, f"{root}/edges").select("src", "dst")


def _scratch(spark) -> str:
    return shared_folder(spark, "scratch")


HEAD = "'1000:150:local:all-MiniLM-L6-v2:rich=True:transclude=0:400:'"
HASH_SQL = f"sha256({HEAD} || title || ':' || alias || ':' || tag1 || ',' || tag2 || ',' || tag3 || ':' || content)"


@query("fn12_note_content_hash", NOTES_CTE + f" SELECT note_path, {HASH_SQL} AS hash FROM notes")
def note_hash(spark, sf):
    return I.fingerprints(notes(spark, sf)).select("note_path", "hash")


def _fingerprints(spark, sf):
    """(current, stored): one note in ten is new, one gone, one edited, one touched."""
    n = notes(spark, sf)
    current = I.fingerprints(n.filter("doc_id % 10 <> 1"))
    old = n.filter("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    old = old.withColumn("mtime", F.when(F.col("doc_id") % 10 == 3, F.date_sub("mtime", 1)).otherwise(F.col("mtime")))
    return current, I.fingerprints(old)


CHANGE_SQL = "CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'unchanged' END"


@query("join8_incremental_diff", f"SELECT {PATH} AS note_path, {CHANGE_SQL} AS change FROM documents")
def incremental_diff(spark, sf):
    return I.diff(*_fingerprints(spark, sf))


@query("join8_full_rebuild_on_config_change", f"SELECT {PATH} AS note_path, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM documents")
def full_rebuild(spark, sf):
    return I.diff(*_fingerprints(spark, sf), config_changed=True)


@query("join9_stale_count", "SELECT count(*) FILTER (doc_id % 10 < 4) AS stale_notes FROM documents")
def stale(spark, sf):
    return I.stale_count(I.diff(*_fingerprints(spark, sf)))


@query("set3_removed_paths", f"SELECT {PATH} AS note_path FROM documents WHERE doc_id % 10 = 1")
def removed(spark, sf):
    current, stored = _fingerprints(spark, sf)
    return I.removed_paths(stored, current)


@query(
    "snk2_incremental_upsert",
    f"SELECT {PATH} AS note_path, CASE WHEN doc_id % 10 IN (0, 2, 3) THEN 'fresh' ELSE 'kept' END AS origin FROM documents WHERE doc_id % 10 <> 1",
)
def upsert(spark, sf):
    current, stored = _fingerprints(spark, sf)
    touched = I.diff(current, stored).filter("change <> 'unchanged'").select("note_path")
    table_rows = stored.select("note_path", F.lit("kept").alias("origin"))
    return I.upsert(table_rows, current.select("note_path", F.lit("fresh").alias("origin")), touched)


@query("snk2_upsert_report", f"SELECT {PATH} AS note_path, CASE doc_id % 10 WHEN 1 THEN 'missing' ELSE 'indexed' END AS outcome FROM documents WHERE doc_id % 10 < 4")
def upsert_report(spark, sf):
    current, stored = _fingerprints(spark, sf)
    touched = I.diff(current, stored).filter("change <> 'unchanged'").select("note_path")
    return I.upsert_report(touched, current)


@query(
    "snk3_delete_note_chunks",
    "SELECT vec_id FROM embeddings WHERE label % 3 <> 0",
)
def delete_chunks(spark, sf):
    chunks = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "'n' || CAST(label AS STRING) || '.md::' || CAST(vec_id AS STRING) AS chunk_id",
        "CASE WHEN vec_id % 2 = 0 THEN 'n' || CAST(label AS STRING) || '.md' END AS note_path",
    )
    gone = table(spark, sf, "embeddings").filter("label % 3 = 0").selectExpr("'n' || CAST(label AS STRING) || '.md' AS note_path")
    return I.delete_note_chunks(chunks, gone).select("vec_id")


@query(
    "snk12_fingerprint_upsert",
    NOTES_CTE + f" SELECT note_path, {HASH_SQL} AS hash FROM notes WHERE doc_id % 10 <> 1",
)
def fingerprint_upsert(spark, sf):
    current, stored = _fingerprints(spark, sf)
    touched = notes(spark, sf).filter("doc_id % 10 < 3").select("note_path")
    return I.upsert(stored, current, touched).select("note_path", "hash")


@query("snk1_full_index_build")
def full_build(spark, sf):
    from noviscan.plans.index import build_chunks
    from noviscan.udfs import hashing_embedder

    return build_chunks(notes(spark, sf), hashing_embedder).select("chunk_id", "note_path", "chunk_index", F.size("embedding").alias("dims"))


@query("prj5_note_chunk_rows")
def note_chunk_rows(spark, sf):
    from noviscan.operators.chunking import note_chunks

    n = notes(spark, sf)
    text = N.embedding_text(F.col("title"), F.col("aliases"), F.col("tags"), F.col("content"), None, True)
    return longs(note_chunks(n.withColumn("embedding_text", text)), "chunk_index").select("chunk_id", "note_title", "heading", "chunk_index", "text")


@query(
    "prj4_embedding_text",
    NOTES_CTE + f""" SELECT note_path, title || CASE WHEN alias <> '' THEN ' | ' || alias ELSE '' END || ' | #' || tag1 || ' #' || tag2 || ' #' || tag3 || chr(10) || chr(10) || trim(content, {WS}) AS text FROM notes""",
)
def embedding_text(spark, sf):
    return notes(spark, sf).select(
        "note_path", N.embedding_text(F.col("title"), F.col("aliases"), F.col("tags"), F.col("content"), None, True).alias("text")
    )


@query(
    "agg9_index_statistics",
    NOTES_CTE + """ SELECT (SELECT count(*) FROM notes WHERE doc_id % 10 <> 1) AS note_count, (SELECT count(*) FROM links JOIN notes USING (note_path) WHERE doc_id % 10 <> 1) AS link_count,
 count(*) FILTER (doc_id % 10 IN (0, 2, 3)) AS indexed_notes, count(*) FILTER (doc_id % 10 > 3) AS skipped_notes, count(*) FILTER (doc_id % 10 = 1) AS removed_notes,
 (SELECT count(*) * 2 FROM notes WHERE doc_id % 10 <> 1) AS chunk_count, count(*) FILTER (doc_id % 10 IN (0, 2, 3)) * 2 AS chunks_added, 'incremental' AS index_mode FROM notes""",
)
def index_statistics(spark, sf):
    n = notes(spark, sf).filter("doc_id % 10 <> 1")
    chunks = n.select("note_path", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return I.index_stats(I.diff(*_fingerprints(spark, sf)), n, chunks, False)


META = """SELECT source AS vault_id, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'gemini' ELSE 'local' END AS provider, 'all-MiniLM-L6-v2' AS model,
 CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(500 * (n % 3) AS INT) END AS chunk_size, CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS chunk_count, n FROM (SELECT source, count(*) + length(source) + min(doc_id) AS n FROM documents GROUP BY source) t"""


@query(
    "agg13_index_health_warnings",
    f"""WITH m AS ({META})
SELECT vault_id, CAST(CASE WHEN chunk_count <= 0 OR provider IS NULL THEN 1 ELSE (CASE WHEN provider <> 'local' THEN 1 ELSE 0 END) + (CASE WHEN chunk_size IS NULL OR chunk_size <> 1000 THEN 1 ELSE 0 END) + (CASE WHEN n % 5 > 0 THEN 1 ELSE 0 END) END AS BIGINT) AS warnings
FROM m WHERE chunk_count <= 0 OR provider IS NULL OR provider <> 'local' OR chunk_size IS NULL OR chunk_size <> 1000 OR n % 5 > 0""",
)
def health(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents_of_health")
    meta = spark.sql(META.replace("FROM documents", "FROM documents_of_health"))
    stale_rows = meta.selectExpr("vault_id", "n % 5 AS stale_notes")
    return I.health_warnings(meta.drop("n"), stale_rows, F.lit(True)).groupBy("vault_id").agg(F.count(F.lit(1)).alias("warnings"))


@query(
    "snk8_index_metadata_latest",
    "SELECT 'v' || user_id AS vault_id, event_type AS space_id, max_by(event_id, (ts, event_id)) AS chunk_count, max(ts) AS indexed_at FROM events GROUP BY 1, 2",
)
def metadata(spark, sf):
    meta = table(spark, sf, "events").selectExpr("'v' || CAST(user_id AS STRING) AS vault_id", "event_type AS space_id", "event_id AS chunk_count", "ts AS indexed_at")
    return I.latest_meta(meta).select("vault_id", "space_id", "chunk_count", "indexed_at")


@query(
    "set9_query_text_dedupe",
    "SELECT count(DISTINCT text) AS texts, count(DISTINCT CASE WHEN doc_id % 4 > 0 THEN text END) AS unused FROM documents",
)
def text_dedupe(spark, sf):
    d = table(spark, sf, "documents")
    return one_row(
        I.embeddings_to_make(d).agg(F.count(F.lit(1)).alias("texts")),
        I.embeddings_to_make(d.filter("doc_id % 4 > 0")).agg(F.count(F.lit(1)).alias("unused")),
    )


@query(
    "set9_embedding_cache_misses",
    "SELECT sha1(text) AS text_sha1 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0) GROUP BY text",
)
def cache_misses(spark, sf):
    d = table(spark, sf, "documents")
    cache = d.filter("doc_id % 4 = 0").select(F.sha1("text").alias("text_sha1")).distinct()
    return I.embeddings_to_make(d, cache).select("text_sha1")


@query(
    "udf1_hashing_embedder",
    """WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
 ch AS (SELECT conv_id, turn, unnest(list_transform(string_split(t, ''), lambda x: ord(x))) AS o, generate_subscripts(string_split(t, ''), 1) AS i FROM c),
 nx AS (SELECT *, lead(o) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM ch),
 tk AS (SELECT conv_id, turn, list_sum(list_transform(string_split(w, ''), lambda x: ord(x))) AS s FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS w FROM c)),
 f AS (SELECT conv_id, turn, o % 48 AS d, 1.0 AS v FROM nx UNION ALL SELECT conv_id, turn, (o * 31 + p) % 48, 0.5 FROM nx WHERE p IS NOT NULL UNION ALL SELECT conv_id, turn, CAST(s % 48 AS BIGINT), 2.0 FROM tk),
 g AS (SELECT conv_id, turn, d, CAST(sum(v) AS DOUBLE) AS v FROM f GROUP BY ALL)
SELECT conv_id, turn, CAST(d AS BIGINT) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM g""",
)
def hashing(spark, sf):
    from noviscan.udfs import embedding_column, hashing_embedder

    rows = table(spark, sf, "conversations").withColumn("e", embedding_column(hashing_embedder)("text"))
    return rows.select("conv_id", "turn", F.posexplode("e").alias("dim", "value")).filter("value <> 0").select(
        "conv_id", "turn", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


@query(
    "srt1_keyword_search",
    """WITH c AS (SELECT doc_id, source || '/' || doc_id AS note_path, lower('Note ' || lang) AS t, lower(source) AS h, lower(text) AS x FROM documents),
 s AS (SELECT *, t || chr(10) || h || chr(10) || x AS hay FROM c),
 k AS (SELECT *, (length(hay) - length(replace(hay, 'the', ''))) / 3 AS n1, (length(hay) - length(replace(hay, 'en', ''))) / 2 AS n2 FROM s)
SELECT doc_id AS chunk_id, note_path, CAST(n1 + n2 + (CASE WHEN contains(t, 'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(t, 'en') THEN 2 ELSE 0 END)
 + (CASE WHEN contains(h, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(h, 'en') THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM k WHERE n1 > 0 AND n2 > 0 ORDER BY score DESC, note_path, chunk_id LIMIT 50""",
)
def keyword(spark, sf):
    from noviscan.operators.search import keyword_search

    chunks = table(spark, sf, "documents").selectExpr(
        "doc_id AS chunk_id", "source || '/' || CAST(doc_id AS STRING) AS note_path", "'Note ' || lang AS note_title", "source AS heading", "text"
    )
    return keyword_search(chunks, "The EN", 50).select("chunk_id", "note_path", "score")


#: Whole benchmark texts, whose words must all occur, and inside of the greatest word of each.
ASKED_SQL = """SELECT item_id AS query_id, lower(text) AS query FROM benchmark
 UNION ALL SELECT 1000000 + item_id, substr(list_max(list_filter(regexp_extract_all(lower(text), '[^\\s]+'), lambda w: length(w) > 2)), 2, length(list_max(list_filter(regexp_extract_all(lower(text), '[^\\s]+'), lambda w: length(w) > 2))) - 2) FROM benchmark
 UNION ALL SELECT 2000000 + item_id, substr(list_max(regexp_extract_all(lower(text), '[^\\s]+')), 1, 2) FROM benchmark"""


def _chunks_and_queries(spark, sf):
    chunks = table(spark, sf, "documents").selectExpr(
        "doc_id AS chunk_id", "source || '/' || CAST(doc_id AS STRING) AS note_path", "lang AS note_title", "source AS heading", "text"
    )
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\s]+"), F.lit(0))
    b = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("query"), words.alias("words"))
    long = F.array_max(F.filter("words", lambda w: F.length(w) > 2))
    inner = F.substring(long, F.lit(2), F.length(long) - 2)
    asked = b.select(F.col("item_id").alias("query_id"), "query").unionByName(b.select((F.lit(1000000) + F.col("item_id")).alias("query_id"), inner.alias("query")))
    return chunks, asked.unionByName(b.select((F.lit(2000000) + F.col("item_id")).alias("query_id"), F.substring(F.array_max("words"), 1, 2).alias("query")))


@query(
    "srt1_keyword_search_many",
    f"""WITH q AS (SELECT query_id, list_distinct(regexp_extract_all(query, '[^\\s]+')) AS terms FROM ({ASKED_SQL}) t WHERE query IS NOT NULL AND len(regexp_extract_all(query, '[^\\s]+')) > 0),
 c AS (SELECT doc_id, source || '/' || doc_id AS note_path, lower(lang) AS t, lower(source) AS h, lower(lang) || chr(10) || lower(source) || chr(10) || lower(text) AS hay FROM documents),
 hits AS (SELECT query_id, terms, c.* FROM q, c WHERE len(list_filter(terms, lambda w: NOT contains(hay, w))) = 0),
 w AS (SELECT query_id, doc_id, note_path, t, h, hay, unnest(terms) AS term FROM hits),
 sc AS (SELECT query_id, doc_id, note_path, sum((length(hay) - length(replace(hay, term, ''))) / length(term)
   + (CASE WHEN contains(t, term) THEN 2 ELSE 0 END) + (CASE WHEN contains(h, term) THEN 1 ELSE 0 END)) AS score FROM w GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_path, doc_id) AS rank, doc_id AS chunk_id, note_path, CAST(score AS DOUBLE) AS score FROM sc QUALIFY rank <= 5""",
)
def keyword_many(spark, sf):
    """Makes the stored index of all documents and answers from it."""
    from noviscan.operators.search import keyword_search_many

    return longs(keyword_search_many(*_chunks_and_queries(spark, sf), 5), "rank")


@query(
    "srt1_keyword_index_tokens",
    """WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(lang) || chr(10) || lower(source) || chr(10) || lower(text), '[^\\s]+')) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS chunks, count(*) AS times FROM e GROUP BY token""",
)
def keyword_tokens(spark, sf):
    """The token lists of the stored index, added up over its buckets."""
    from noviscan.operators import keyword_index as K

    root = _scratch(spark)
    K.write_keyword_index(_chunks_and_queries(spark, sf)[0], root)
    tokens = K.read_keyword_index(spark, root, "bigint").filter("kind = 'token'")
    times = F.aggregate("times", F.lit(0).cast("long"), lambda n, x: n + x)
    return tokens.groupBy(F.col("key").alias("token")).agg(F.sum(F.size("places")).alias("chunks"), F.sum(times).alias("times"))


@query(
    "prj12_open_uri",
    NOTES_CTE + """ SELECT note_path, 'obsidian://open?file=' || replace(replace(regexp_replace(note_path, '\\.md$', ''), ' ', '%20'), '&', '%26') || '&vault=main' AS uri FROM notes""",
)
def open_uri(spark, sf):
    return notes(spark, sf).select("note_path", L.open_uri(F.col("note_path"), "main").alias("uri"))


@query(
    "udf2_index_surface",
    "SELECT 'notes' AS name, count(*) AS n FROM documents UNION ALL SELECT 'stale', 0",
)
def index_surface(spark, sf):
    """Build an index from all notes, refresh it unchanged, and count."""
    from noviscan.plans.index import ChunkIndex
    from noviscan.udfs import hashing_embedder

    idx = ChunkIndex(spark, _scratch(spark), hashing_embedder)
    n = notes(spark, sf)
    idx.refresh(n)
    again = idx.refresh(n)
    return again.select(F.lit("notes").alias("name"), F.col("note_count").alias("n")).unionByName(
        again.select(F.lit("stale").alias("name"), F.col("indexed_notes").alias("n"))
    )
