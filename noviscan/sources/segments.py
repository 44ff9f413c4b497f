"""Located segments from text, pages, chapters and timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.operators.ordering import dense_index, prefix_sums

HEADING_LINE = r"(?U)^#{1,3}\s+.+$"  # fixed value
CHAPTER_STRIDE = 1 << 22

LOCATION_FIELDS = {
    "page": "int",
    "page_end": "int",
    "chapter": "int",
    "chapter_end": "int",
    "line_start": "int",
    "line_end": "int",
    "ts_start": "double",
    "ts_end": "double",
}


def location(**known: Column) -> Column:
    """Location struct with the given fields set and all others null."""
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in LOCATION_FIELDS.items()])


def _cut(lines: Column, runs: Column, target: int) -> Column:
    """Cut [first, last] line runs every ``target`` lines and attach the text of each piece."""
    pieces = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.sequence(r["first"], r["last"], F.lit(target)),
                lambda a: F.struct(a.alias("a"), F.least(a + F.lit(target - 1), r["last"]).alias("b")),
            ),
        )
    )
    located = F.transform(
        pieces,
        lambda p: F.struct(
            X.strip(F.array_join(F.slice(lines, p["a"], p["b"] - p["a"] + 1), "\n")).alias("text"),
            p["a"].cast("int").alias("line_start"),
            p["b"].cast("int").alias("line_end"),
        ),
    )
    return F.filter(located, lambda s: s["text"] != "")


def markdown_segments(text: Column, target: int = DEFAULTS.segment_target_lines) -> Column:
    """Segments that open at level 1-3 headings and run at most ``target`` lines."""

    def over(lines):
        def runs(starts):
            return F.transform(
                starts,
                lambda s, i: F.struct(
                    s.alias("first"), F.coalesce(F.get(starts, i + 1) - 1, F.size(lines)).alias("last")
                ),
            )

        opens = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
            lambda n: (n == 1) | X.strip(F.element_at(lines, n)).rlike(HEADING_LINE),
        )
        return F.when(F.size(lines) > 0, _cut(lines, X.let(opens, runs), target)).otherwise(
            F.array().cast("array<struct<text:string,line_start:int,line_end:int>>")
        )

    return X.let(X.split_lines(text), over)


def plain_segments(text: Column, target: int = DEFAULTS.segment_target_lines) -> Column:
    """Blank-line paragraphs of at most ``target`` lines."""

    def over(lines):
        def cut(blank):
            def blank_at(n):
                return F.coalesce(F.get(blank, n - 1), F.lit(True))

            numbers = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
            firsts = F.filter(numbers, lambda n: ~blank_at(n) & blank_at(n - 1))
            lasts = F.filter(numbers, lambda n: ~blank_at(n) & blank_at(n + 1))
            runs = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
            return _cut(lines, runs, target)

        return X.let(F.transform(lines, X.is_blank), cut)

    return X.let(X.split_lines(text), over)


def explode_segments(df: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(pieces).alias("segment_index", "s")).select(
        *keep,
        "segment_index",
        F.col("s.text").alias("text"),
        F.col("s.line_start").alias("line_start"),
        F.col("s.line_end").alias("line_end"),
    )


def segment_pieces(text: Column, markdown: Column | bool = True) -> Column:
    flag = F.lit(markdown) if isinstance(markdown, bool) else markdown
    return F.when(flag, markdown_segments(text)).otherwise(plain_segments(text))


def text_segments(df: DataFrame, keep: list[str], text: str = "text", markdown: Column | bool = True) -> DataFrame:
    """Markdown or plain segmenting per row, chosen by a flag column."""
    return explode_segments(df, segment_pieces(F.col(text), markdown), keep)


def best_page_text(primary: DataFrame, alternative: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the first extraction unless it is unreliable and the other is reliable or longer."""
    from noviscan.operators.relevance import unreliable_page

    alt = alternative.select(*keys, X.strip(F.col("text")).alias("alt_text"))
    base = primary.select(*keys, X.strip(F.col("text")).alias("text"))
    better = (
        unreliable_page(F.col("text"))
        & (F.coalesce(F.col("alt_text"), F.lit("")) != "")
        & (~unreliable_page(F.col("alt_text")) | (F.length("alt_text") > F.length("text")))
    )
    return base.join(alt, keys, "left").select(
        *keys,
        F.when(better, F.col("alt_text")).otherwise(F.col("text")).alias("text"),
        F.coalesce(better, F.lit(False)).alias("used_alternative"),
    )


def page_segments(pages: DataFrame, cfg: EngineConfig = DEFAULTS, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """One segment per non-empty page among the first ``max_pages``; plus one warning per cut document."""
    kept = pages.filter((F.col("page") <= cfg.max_pages) & ~X.is_blank(F.col("text")))
    segments = dense_index(kept.select(doc, "page", X.strip(F.col("text")).alias("text")), [doc], "page", "segment_index")
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"))
    warnings = counts.filter(F.col("page_count") > cfg.max_pages).select(
        doc,
        F.concat(
            F.lit("pages: "), F.col("page_count"),
            F.lit(f" given, {cfg.max_pages} kept"),
        ).alias("warning"),
    )
    return segments, warnings


def chapter_segments(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """Markdown segments per chapter with one running index per book."""
    pieces = text_segments(chapters.filter(~X.is_blank(F.col("text"))), [book, "chapter"])
    placed = pieces.withColumn("__pos", F.col("chapter") * F.lit(CHAPTER_STRIDE) + F.col("segment_index"))
    return dense_index(placed.drop("segment_index"), [book], "__pos", "segment_index").drop("__pos")


def skipped_chapters(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    return (
        chapters.groupBy(book)
        .agg(F.count_if(X.is_blank(F.col("text"))).alias("skipped"))
        .filter("skipped > 0")
        .withColumn(
            "warning",
            F.concat(F.lit("Skipped "), F.col("skipped"), F.lit(" EPUB chapter(s) with no readable text.")),
        )
    )


def timed_segments(rows: DataFrame, source: str, pos: str) -> DataFrame:
    """Transcribed rows: stripped, blanks dropped, indexed in order."""
    kept = rows.withColumn("text", X.strip(F.col("text"))).filter(F.col("text") != "")
    return dense_index(kept, [source], pos, "segment_index")


def language_tags(language: Column) -> Column:
    clean = X.strip(F.coalesce(language, F.lit("")))
    return F.when(clean != "", F.array(F.concat(F.lit("language/"), clean))).otherwise(F.array().cast("array<string>"))


# File extensions per source type, tried in this order.
EXTENSIONS = {
    "text": (".txt",),
    "markdown": (".md", ".markdown"),
    "audio_video": (".mp3", ".wav", ".m4a", ".mp4", ".mov", ".mkv"),
    "pdf": (".pdf",),
    "epub": (".epub",),
    "docx": (".docx",),
}


def source_type(ref: Column, plugins: dict[str, Column] | None = None) -> Column:
    """Route a reference to a source type: plugins first, then links, then extensions; else null."""
    from noviscan.functions.identity import video_id_in_video_url

    clean = X.strip(ref)
    is_url = clean.rlike("(?i)^https?://")
    extension = F.lower(F.regexp_extract(clean, r"(\.[^./\\]+)$", 1))
    routed = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, test in (plugins or {}).items():
        routed = routed.when(test, F.lit(name))
    routed = routed.when(is_url & video_id_in_video_url(clean).isNotNull(), F.lit("youtube")).when(is_url, F.lit("web"))
    for name, endings in EXTENSIONS.items():
        routed = routed.when(extension.isin(*endings), F.lit(name))
    return routed


def default_segments(sources: DataFrame, segments: DataFrame, source: str = "source_id") -> DataFrame:
    """Sources without segments become one segment holding their stripped text."""
    covered = segments.select(source).distinct()
    whole = sources.join(covered, source, "left_anti").filter(~X.is_blank(F.col("text")))
    return segments.select(source, "segment_index", "text").unionByName(
        whole.select(source, F.lit(0).alias("segment_index"), X.strip(F.col("text")).alias("text"))
    )


def default_texts(sources: DataFrame, segments: DataFrame, source: str = "source_id") -> DataFrame:
    """Sources without text get their non-blank segments joined by blank lines (one source = one text value)."""
    empty = sources.filter(X.is_blank(F.col("text"))).select(source)
    joined = (
        segments.filter(~X.is_blank(F.col("text")))
        .join(empty, source, "left_semi")
        .groupBy(source)
        .agg(X.join_ordered(F.collect_list(F.struct("segment_index", "text")), "\n\n").alias("joined"))
    )
    return sources.join(joined, source, "left").withColumn(
        "text", F.when(X.is_blank(F.col("text")), F.coalesce("joined", "text")).otherwise(F.col("text"))
    ).drop("joined")


def cap_characters(segments: DataFrame, limit: int, source: str = "source_id") -> DataFrame:
    """Keep segments in order until ``limit`` characters, cutting the one that crosses it."""
    if limit <= 0:
        return segments
    placed = prefix_sums(segments, [source], "segment_index", {"before": F.length("text")})
    return (
        placed.filter(F.col("before") < limit)
        .withColumn("text", F.substring(F.col("text"), F.lit(1), F.lit(limit) - F.col("before").cast("int")))
        .drop("before")
    )


def cap_warnings(segments: DataFrame, limit: int, source: str = "source_id") -> DataFrame:
    total = segments.groupBy(source).agg(F.sum(F.length("text")).alias("chars"))
    return total.filter(F.col("chars") > limit).select(
        source,
        F.lit(
            f"characters: {limit} kept"
        ).alias("warning"),
    )
