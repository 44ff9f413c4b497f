"""Notes of a knowledge base: scan, parse, look up."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from noviscan.functions import links as L
from noviscan.functions import text as X

# Folders that never hold notes (exact case / any case).
SKIP_FOLDERS = (".obsidian", ".trash", ".git", ".smart-env", "node_modules")
TEMPLATE_FOLDERS = ("templates", "template")
HEADER_BLOCK = r"(?msd)\A\x{FEFF}?-{3,}[^\S\n]*$\n?(.*?)^-{3,}[^\S\n]*$\n?(.*)\z"
NO_STRINGS = "array<string>"


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _header_fields(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """YAML header -> field name to JSON value; null when it does not parse to a mapping."""
    import yaml  # a worker without it fails, rather than dropping headers

    def read(block):
        if block is None:
            return None
        try:
            value = yaml.safe_load(block)
        except yaml.YAMLError:
            return None
        if not isinstance(value, dict):
            return None
        return {str(k): json.dumps(v, ensure_ascii=False, default=str) for k, v in value.items()}

    for series in blocks:
        yield series.map(read)


def skipped_path(path: Column) -> Column:
    """Hidden files, system folders and template folders hold no notes."""
    parts = F.split(path, "/")
    return (
        F.element_at(parts, -1).startswith(".")
        | F.exists(parts, lambda p: p.isin(*SKIP_FOLDERS) | F.lower(p).isin(*TEMPLATE_FOLDERS))
    )


def read_note_files(spark: SparkSession, root: str, vault_id: str = "default") -> DataFrame:
    """note_path, raw, mtime for every markdown file below ``root``."""
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .load(root)
    )
    base = root.rstrip("/").removeprefix("file://")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.regexp_replace(path, r"^(?:file:)?/*" + _quoted(base.lstrip("/")) + "/+", "")
    rows = files.select(
        F.lit(vault_id).alias("vault_id"),
        relative.alias("note_path"),
        F.col("value").alias("raw"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    return rows.filter(~skipped_path(F.col("note_path")))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def header_block(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(X.strip(raw), HEADER_BLOCK, 1), F.lit(""))


def note_body(raw: Column) -> Column:
    """Text after the header block, stripped; the whole text when there is no header."""
    text = X.strip(raw)
    has = text.rlike(HEADER_BLOCK)
    return X.strip(F.when(has, F.regexp_extract(text, HEADER_BLOCK, 2)).otherwise(text))


def parse_notes(files: DataFrame) -> DataFrame:
    """Raw files -> notes with title, content, header fields, aliases, tags and links."""
    clean = F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n"))
    staged = (
        files.withColumn("raw", clean)
        .withColumn("__block", header_block(F.col("raw")))
        .withColumn("content", note_body(F.col("raw")))
        .withColumn("frontmatter", F.coalesce(_header_fields("__block"), F.create_map().cast("map<string,string>")))
    )
    fm, content = F.col("frontmatter"), F.col("content")
    kept = [c for c in files.columns if c != "raw"]
    return staged.select(
        *kept,
        L.stem(F.col("note_path")).alias("title"),
        "content",
        "frontmatter",
        L.note_links(content, fm).alias("wikilinks"),
        L.header_strings(fm, "aliases", "alias").alias("aliases"),
        L.note_tags(content, fm).alias("tags"),
    )


def lookup_notes(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested paths with their note, null where missing or skipped."""
    usable = notes.filter(~skipped_path(F.col("note_path")))
    return wanted.join(usable, "note_path", "left")


def text_corpus(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, rejected) from rows of path, raw; markdown keeps its tags, links and header title."""
    parsed = parse_notes(files.withColumnRenamed("path", "note_path"))
    is_md = F.lower(F.col("note_path")).rlike(r"\.(md|markdown)$")
    raw = files.select(F.col("path").alias("note_path"), X.strip(F.col("raw")).alias("plain"))
    both = parsed.join(raw, "note_path")
    named = F.get_json_object(F.col("frontmatter")["title"], "$")
    rows = both.select(
        F.col("note_path").alias("source_ref"),
        F.when(is_md, F.coalesce(named, F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(is_md, F.col("content")).otherwise(F.col("plain")).alias("text"),
        F.when(is_md, F.lit("markdown")).otherwise(F.lit("text")).alias("source_type"),
        F.when(is_md, F.col("tags")).otherwise(F.array().cast(NO_STRINGS)).alias("tags"),
        F.when(is_md, F.col("wikilinks")).otherwise(F.array().cast(NO_STRINGS)).alias("wikilinks"),
    )
    empty = F.col("text") == ""
    rejected = rows.filter(empty).select("source_ref", F.concat(F.lit("Empty text file: "), F.col("source_ref")).alias("reason"))
    return rows.filter(~empty), rejected


def embedding_text(
    title: Column, aliases: Column, tags: Column, content: Column, transcluded: Column | None, rich: bool
) -> Column:
    """Header line (title, aliases, tags) over the body and any transcluded excerpts."""
    hashed = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), F.ltrim(t, F.lit("#")))), " ")
    named = F.concat(F.array(F.coalesce(title, F.lit(""))), aliases) if rich else F.array().cast(NO_STRINGS)
    header = F.array_join(F.filter(F.concat(named, F.array(hashed)), lambda p: p != ""), " | ")
    parts = [X.strip(content)]
    if transcluded is not None:
        parts.append(F.array_join(F.coalesce(transcluded, F.array().cast(NO_STRINGS)), "\n\n"))
    pieces = F.filter(F.array(header, *parts), lambda p: p != "")
    return F.array_join(pieces, "\n\n")
