"""Tables and figures: detection, pairing with captions, placement on notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.operators.ordering import keep_first

# Caption lines and the rule below a table header.
CAPTION = r"(?iU)^\s*(figure|fig\.?|table|tbl\.?)\s*([A-Za-z]?\d+(?:[.\-]\d+)*)\s*[:.\)–-]?\s*(.*)$"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"


def clean_caption(c: Column, limit: int = DEFAULTS.media_caption_chars) -> Column:
    bare = F.btrim(F.regexp_replace(c, X.DOT_LEADER, " "), F.lit(" .–-\t"))

    def shorten(t):
        head = X.strip(F.regexp_replace(F.substring(t, 1, limit), "(?s) [^ ]*$", ""))
        return (
            F.when((t == "") | t.rlike(r"^\d+$"), F.lit(""))
            .when(F.length(t) > limit, F.concat(head, F.lit("...")))
            .otherwise(t)
        )

    return X.let(F.regexp_replace(bare, r"(?U)\s{2,}", " "), shorten)


def captions(text: Column, limit: int = DEFAULTS.media_caption_chars) -> Column:
    """array<struct<line, kind, label, caption>> of caption lines; long sentences are no captions."""

    def read(line, i):
        kind = F.when(F.lower(F.regexp_extract(line, CAPTION, 1)).startswith("fig"), "figure").otherwise("table")
        label = F.concat(F.initcap(kind), F.lit(" "), F.regexp_extract(line, CAPTION, 2))
        hit = (F.length(line) <= limit + 40) & line.rlike(CAPTION)
        return F.when(
            hit,
            F.struct(
                (i + 1).alias("line"), kind.alias("kind"), label.alias("label"),
                clean_caption(F.regexp_extract(line, CAPTION, 3), limit).alias("caption"),
            ),
        )

    return F.array_compact(F.transform(F.transform(X.split_lines(text), X.strip), read))


def markdown_tables(text: Column) -> Column:
    """array<struct<line_start, line_end, markdown>>: header line, rule line and following pipe lines."""

    def over(lines):
        def at(n):
            return F.coalesce(F.get(lines, n - 1), F.lit(""))

        def piped(n):
            return at(n).contains("|") & ~X.is_blank(at(n))

        numbers = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
        starts = F.filter(numbers, lambda n: at(n).contains("|") & at(n + 1).rlike(TABLE_RULE))
        breaks = F.filter(numbers, lambda n: ~piped(n))

        def build(found):
            def table(s):
                stop = F.coalesce(F.array_min(F.filter(breaks, lambda b: b >= s + 2)), F.size(lines) + 1) - 1
                return F.struct(
                    s.alias("line_start"),
                    stop.alias("line_end"),
                    F.array_join(F.transform(F.slice(lines, s, stop - s + 1), X.rstrip), "\n").alias("markdown"),
                )

            # A start inside the previous table is one of its rows.
            first = F.filter(
                F.transform(found, table),
                lambda t, i: (i == 0) | ~F.exists(F.slice(F.transform(found, table), F.lit(1), F.greatest(i, F.lit(0))), lambda u: u["line_end"] >= t["line_start"]),
            )
            return F.transform(
                first,
                lambda t: F.struct(
                    F.concat(F.lit("Table (lines "), t["line_start"], F.lit("-"), t["line_end"], F.lit(")")).alias("label"),
                    t["line_start"].alias("line_start"), t["line_end"].alias("line_end"), t["markdown"].alias("markdown"),
                ),
            )

        return X.let(starts, build)

    return X.let(X.split_lines(text), over)


def grid_to_markdown(cells: DataFrame, keys: list[str], cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Cell rows (keys, row, col, value) -> one markdown table per key; null markdown when it is no table.

    Rows beyond the cap are counted, not gathered.
    """
    clean = F.replace(X.squeeze(F.coalesce("value", F.lit(""))), F.lit("|"), F.lit("\\|"))
    rows = (
        cells.select(*keys, "row", "col", clean.alias("value"))
        .groupBy(*keys, "row")
        .agg(F.collect_list(F.struct("col", "value")).alias("c"), F.max("col").alias("last"), F.bool_or(F.col("value") != "").alias("filled"))
        .filter("filled")
    )
    order = Window.partitionBy(*keys).orderBy("row")
    shape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.max("last") + 1).alias("width"))
    head = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= cfg.media_table_rows)
    joined = head.join(shape, keys)
    values = F.transform(F.sort_array("c"), lambda s: s["value"])
    padded = F.concat(values, F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size(values), F.lit(0))))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width").cast("int")), " | "), F.lit(" |"))
    text = F.when(F.col("at") == 1, F.concat(line, F.lit("\n"), rule)).otherwise(line)
    tables = joined.select(*keys, "rows", "width", "at", text.alias("text")).groupBy(*keys, "rows", "width").agg(
        X.join_ordered(F.collect_list(F.struct("at", "text")), "\n").alias("body")
    )
    more = F.when(
        F.col("rows") > cfg.media_table_rows,
        F.concat(F.lit("\n| _... "), F.col("rows") - cfg.media_table_rows, F.lit(" more row(s) omitted_ |")),
    ).otherwise("")
    usable = (F.col("rows") >= 2) & (F.col("width") >= 2)
    return tables.select(*keys, F.when(usable, F.concat("body", more)).alias("markdown"))


def pair_captions(media: DataFrame) -> DataFrame:
    """n-th structured table of a page takes the n-th table caption of that page; used captions go away.

    ``media``: source_id, item_order, kind, label, caption, markdown, page. Ranks run within a page.
    """
    order = Window.partitionBy("source_id", "page").orderBy("item_order")
    is_table = (F.col("kind") == "table") & (F.coalesce("markdown", F.lit("")) != "") & F.col("page").isNotNull()
    is_caption = (F.col("kind") == "table") & (F.coalesce("markdown", F.lit("")) == "") & F.col("page").isNotNull()
    tables = media.filter(is_table).withColumn("nth", F.row_number().over(order))
    labels = media.filter(is_caption).withColumn("nth", F.row_number().over(order))
    on = ["source_id", "page", "nth"]
    merged = (
        tables.join(labels.select(*on, F.col("label").alias("l2"), F.col("caption").alias("c2")), on, "left")
        .withColumn("label", F.coalesce("l2", "label"))
        .withColumn("caption", F.when(F.col("l2").isNotNull(), F.col("c2")).otherwise(F.col("caption")))
    )
    unused = labels.join(tables.select(*on), on, "left_anti")
    rest = media.filter(~is_table & ~is_caption)
    return merged.select(*media.columns).unionByName(unused.select(*media.columns)).unionByName(rest)


def dedupe_media(media: DataFrame) -> DataFrame:
    fields = [F.coalesce(F.col(c), F.lit("\0")) for c in ("kind", "label", "caption", "markdown")]
    return keep_first(media, [F.col("source_id"), *fields], ["item_order"])


LINE_BUCKET = 64


def media_for_notes(notes: DataFrame, media: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Media on a note's pages or overlapping its lines; first ``media_per_note`` distinct items per note.

    Range joins become equi-joins: pages and line buckets are expanded on the note side and joined on
    (source, bucket), so a long source is spread over its pages and buckets.
    """
    n_end = F.coalesce(F.when(F.col("page_end") != 0, F.col("page_end")), F.col("page"))
    by_page = (
        notes.filter(F.col("page").isNotNull() & (n_end >= F.col("page")))
        .select("source_id", "note_id", F.explode(F.sequence("page", n_end)).alias("page"))
        .join(media.filter(F.col("page").isNotNull()), ["source_id", "page"])
    )
    l_end = F.coalesce(F.when(F.col("line_end") != 0, F.col("line_end")), F.col("line_start"))

    def bucketed(df):
        return df.withColumn("l_end", l_end).filter(F.col("line_start").isNotNull() & (F.col("l_end") >= F.col("line_start"))).withColumn(
            "bucket", F.explode(F.sequence(F.floor(F.col("line_start") / LINE_BUCKET), F.floor(F.col("l_end") / LINE_BUCKET)))
        )

    a = bucketed(notes).select("source_id", "note_id", "bucket", F.col("line_start").alias("n0"), F.col("l_end").alias("n1"))
    b = bucketed(media)
    by_line = a.join(b, ["source_id", "bucket"]).filter((F.col("line_start") <= F.col("n1")) & (F.col("l_end") >= F.col("n0")))
    columns = ["source_id", "note_id", "item_order", "kind", "label", "caption", "markdown"]
    hits = by_page.select(*columns).unionByName(by_line.select(*columns))
    fields = [F.coalesce(F.col(c), F.lit("\0")) for c in ("kind", "label", "caption", "markdown")]
    unique = keep_first(hits, [F.col("source_id"), F.col("note_id"), *fields], ["item_order"])
    order = Window.partitionBy("source_id", "note_id").orderBy("item_order", "kind", "label")
    return unique.withColumn("media_rank", F.row_number().over(order)).filter(F.col("media_rank") <= cfg.media_per_note)


def media_hint(label: Column, kind: Column, caption: Column) -> Column:
    name = X.strip(F.coalesce(F.nullif(label, F.lit("")), kind, F.lit("")))
    text = X.strip(F.coalesce(caption, F.lit("")))
    return F.when((text != "") & (name != ""), F.concat(name, F.lit(": "), text)).when(text != "", text).otherwise(name)


def media_section(items: DataFrame, keys: list[str]) -> DataFrame:
    """'Tables & figures' section per note (at most ``media_per_note`` items each)."""
    head = F.concat(
        F.lit("**"), F.col("label"),
        F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit(" — "), F.col("caption"))).otherwise(""), F.lit("**"),
        F.when(~F.col("where").isin("", "unknown"), F.concat(F.lit(" ("), F.col("where"), F.lit(")"))).otherwise(""),
    )
    block = F.concat(head, F.when(F.coalesce("markdown", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("markdown"))).otherwise(""))
    return items.groupBy(*keys).agg(
        F.concat(
            F.lit("## Tables & figures\n\n"),
            X.join_ordered(F.collect_list(F.struct("media_rank", block.alias("text"))), "\n\n"), F.lit("\n"),
        ).alias("media_section")
    )
