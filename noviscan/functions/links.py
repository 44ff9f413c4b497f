"""Links, tags, paths and open-URIs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noviscan.functions import text as X

# Link, embed and tag syntax; header fields that hold no links.
LINK = r"!?\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
EMBED = r"!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
INLINE_TAG = r"(?U)(?<![\w/])#([a-zA-Z][\w/-]*)"
FENCED_CODE = r"(?s)```[^\n]*\n.*?```"
INLINE_CODE = r"`[^`\n]+`"
LINKLESS_FIELDS = ("tags", "tag", "aliases", "alias", "cssclasses", "cssclass")


def _distinct_stripped(items: Column) -> Column:
    return F.array_distinct(X.nonempty(items))


def body_links(content: Column) -> Column:
    return _distinct_stripped(F.regexp_extract_all(content, F.lit(LINK), F.lit(1)))


def body_embeds(content: Column) -> Column:
    return _distinct_stripped(F.regexp_extract_all(content, F.lit(EMBED), F.lit(1)))


def body_tags(content: Column) -> Column:
    scanned = F.regexp_replace(F.regexp_replace(content, FENCED_CODE, " "), INLINE_CODE, " ")
    return F.array_distinct(F.regexp_extract_all(scanned, F.lit(INLINE_TAG), F.lit(1)))


def _json_strings(value: Column) -> Column:
    """JSON text of a string or a list -> array of stripped non-empty strings; else empty."""
    as_list = F.from_json(value, "array<string>")
    as_text = F.array(F.get_json_object(value, "$"))
    picked = F.when(value.startswith("["), as_list).when(value.startswith('"'), as_text)
    return _distinct_stripped(F.coalesce(picked, F.array().cast("array<string>")))


def header_strings(fields: Column, *names: str) -> Column:
    """Values of the first field that is present."""
    return _json_strings(F.coalesce(*[fields[n] for n in names]))


def header_tags(fields: Column) -> Column:
    pieces = F.flatten(F.transform(header_strings(fields, "tags", "tag"), lambda t: F.split(t, ",")))
    return F.array_distinct(
        F.filter(F.transform(pieces, lambda p: F.ltrim(X.strip(p), F.lit("#"))), lambda p: p != "")
    )


def note_tags(content: Column, fields: Column) -> Column:
    return F.array_distinct(F.concat(header_tags(fields), body_tags(content)))


def header_links(fields: Column) -> Column:
    scanned = F.filter(F.map_entries(fields), lambda e: ~F.lower(e["key"]).isin(*LINKLESS_FIELDS))
    found = F.transform(
        scanned,
        lambda e: body_links(
            F.when(e["value"].startswith("["), F.array_join(F.from_json(e["value"], "array<string>"), " ")).otherwise(
                F.coalesce(F.get_json_object(e["value"], "$"), F.lit(""))
            )
        ),
    )
    return F.array_distinct(F.flatten(found))


def note_links(content: Column, fields: Column) -> Column:
    return F.array_distinct(F.concat(body_links(content), header_links(fields)))


def _forward(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?s)(?<=.)\.[^.]*$", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def link_target(path: Column) -> Column:
    """Vault path as a link target: no extension, no leading ``./``."""
    return F.regexp_replace(without_extension(X.strip(_forward(path))), r"^(\./)+", "")


def format_link(path: Column) -> Column:
    return X.let(link_target(path), lambda t: F.when(t != "", F.concat(F.lit("[["), t, F.lit("]]"))).otherwise(""))


def normalize_link(link: Column) -> Column:
    """Lookup form of a link: no anchor, no extension, no leading ``./``."""
    bare = X.strip(F.regexp_replace(X.strip(F.coalesce(link, F.lit(""))), r"[#^].*", ""))
    return X.strip(F.regexp_replace(without_extension(_forward(bare)), r"^(\./)+", ""))


def open_uri(path: Column, vault: str | None = None, new_leaf: bool = False) -> Column:
    def quoted(c):
        encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.replace(encoded, F.lit("%2F"), F.lit("/"))

    tail = "" if not vault else f"&vault={vault}"
    tail += "&newLeaf=true" if new_leaf else ""
    target = without_extension(X.strip(_forward(path)))
    return X.let(
        target,
        lambda t: F.when(t != "", F.concat(F.lit("obsidian://open?file="), quoted(t), F.lit(tail))).otherwise(""),
    )


def append_target_path(target: Column) -> Column:
    return F.nullif(X.strip(F.substring_index(X.strip(target), "#", 1)), F.lit(""))


def append_target_heading(target: Column) -> Column:
    rest = F.regexp_replace(F.regexp_extract(X.strip(target), r"(?s)#(.*)$", 1), r"(?U)^[\s]*#*", "")
    return F.nullif(X.strip(rest), F.lit(""))


def slug(c: Column) -> Column:
    """Letters, digits, blank, dash and underscore stay; the rest becomes underscores."""
    clean = F.btrim(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N} _-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("concept"))


def relative_path(path: Column) -> Column:
    """Vault-relative path, null when empty or when it climbs out with ``..``."""
    clean = F.ltrim(X.strip(_forward(path)), F.lit("./"))
    return F.when((clean != "") & ~F.array_contains(F.split(clean, "/"), ".."), clean)


def same_path(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(relative_path(a)) == F.lower(relative_path(b)), F.lit(False))


def output_path(
    source_title: Column, concept: Column, source_type: Column, moment: Column, folder: str, layout: str, pattern: str | None = None
) -> Column:
    """Fill the path pattern for a proposed note; null when it would leave the vault."""
    default = "{folder}/{concept_slug}.md" if layout == "flat" else "{folder}/{source_slug}/{concept_slug}.md"
    chosen = pattern or default
    path = F.lit(chosen)
    values = {
        "folder": F.lit(folder.strip("/ ")),
        "source_slug": slug(source_title),
        "concept_slug": slug(concept),
        "source_title": source_title,
        "source_type": source_type,
        "date": F.date_format(moment, "yyyy-MM-dd"),
        "year": F.date_format(moment, "yyyy"),
        "month": F.date_format(moment, "MM"),
        "day": F.date_format(moment, "dd"),
    }
    for name, value in values.items():
        if "{%s}" % name in chosen:
            path = F.replace(path, F.lit("{%s}" % name), value)
    if folder and "{folder}" not in chosen:
        path = F.when(path.startswith(folder + "/"), path).otherwise(
            F.concat(F.lit(folder + "/"), F.ltrim(path, F.lit("/")))
        )
    clean = F.ltrim(X.strip(_forward(path)), F.lit("./"))
    named = F.when(F.lower(clean).endswith(".md"), clean).when(clean == "", F.lit("note.md")).otherwise(F.concat(clean, F.lit(".md")))
    return F.when(~F.array_contains(F.split(clean, "/"), ".."), named)


def moc_path(sample_path: Column) -> Column:
    parent = F.regexp_replace(sample_path, r"/?[^/]*$", "")
    return F.when(parent == "", F.lit("index.md")).otherwise(F.concat(parent, F.lit("/index.md")))
