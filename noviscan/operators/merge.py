"""Merging accepted proposals into notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noviscan.functions import links as L
from noviscan.functions import text as X
from noviscan.operators.chunking import sections
from noviscan.operators.ordering import prefix_sums
from noviscan.session import cut_lineage
from noviscan.sources.notes import note_body


def path_problem(path: Column) -> Column:
    """Why a proposed path is not acceptable; null when it is."""
    raw = X.strip(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return (
        F.when(raw == "", "note_path must not be empty")
        .when(raw.startswith("/"), "note_path must be vault-relative")
        .when(~F.lower(raw).endswith(".md"), "note_path must be a .md file")
        .when(F.array_contains(F.split(raw, "/"), ".."), "note_path must not contain '..'")
        .when(raw.rlike(r"[\x00-\x1f]"), "note_path contains control characters")
    )


def clean_path(path: Column) -> Column:
    return F.regexp_replace(X.strip(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def content_problem(content: Column, limit: int = 500_000) -> Column:
    return F.when(F.length(F.coalesce(content, F.lit(""))) > limit, F.lit(f"note content exceeds {limit} characters"))


def validate(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason)."""
    checked = proposals.withColumn("reason", F.coalesce(path_problem(F.col("note_path")), content_problem(F.col("content"))))
    valid = checked.filter(F.col("reason").isNull()).drop("reason").withColumn("note_path", clean_path(F.col("note_path")))
    return valid, checked.filter(F.col("reason").isNotNull())


def append_body(content: Column, heading: str = "Update") -> Column:
    """Body to append: no header block, opened by a heading."""
    body = note_body(content)
    return (
        F.when(body == "", F.lit(""))
        .when(body.startswith("#"), body)
        .otherwise(F.concat(F.lit(f"## {heading}\n\n"), body))
    )


def _folded(heading: Column) -> Column:
    return F.regexp_replace(F.lower(X.strip(heading)), r"(?U)\s+", " ")


def merged_content(existing: Column, draft: Column, heading: Column, fallback: str = "Update") -> Column:
    """Existing note with the draft appended at its end or inside the matching section.

    Merging into a section rewrites every heading of the note at level two.
    """
    addition = append_body(draft, fallback)

    def build(n):
        plain = F.concat(X.rstrip(existing), F.lit("\n\n"), X.strip(n["add"]), F.lit("\n"))
        untouched = F.concat(X.rstrip(existing), F.lit("\n"))
        wanted = _folded(F.coalesce(heading, F.lit("")))
        hit = F.exists(n["parts"], lambda s: s["heading"].isNotNull() & (_folded(s["heading"]) == wanted))
        blocks = F.transform(
            n["parts"],
            lambda s, i: F.concat(
                F.when(s["heading"].isNotNull(), F.concat(F.lit("## "), s["heading"], F.lit("\n"))).otherwise(""),
                X.strip(s["body"]),
                F.when(
                    s["heading"].isNotNull() & (_folded(s["heading"]) == wanted), F.concat(F.lit("\n\n"), X.strip(n["add"]))
                ).otherwise(""),
                F.when(s["heading"].isNotNull() & (i < F.size(n["parts"]) - 1), "\n").otherwise(""),
            ),
        )
        body = F.concat(X.strip(F.array_join(blocks, "\n")), F.lit("\n"))
        has_head = X.lstrip(existing).startswith("---") & existing.rlike(r"(?s)^[^-]*---.*?---")
        head = F.regexp_extract(existing, r"(?s)^\s*(---.*?---)", 1)
        inside = F.when(has_head, F.concat(head, F.lit("\n"), body)).otherwise(body)
        return F.when(n["add"] == "", untouched).when((wanted == "") | ~hit, plain).otherwise(inside)

    return X.let(F.struct(addition.alias("add"), sections(note_body(existing)).alias("parts")), build)


def merge_status(mode: Column, exists: Column, overwrite: Column) -> Column:
    return (
        F.when(~mode.isin("write", "append"), "error")
        .when((mode == "append") & exists, "appended")
        .when((mode == "write") & exists & ~overwrite, "skipped_exists")
        .otherwise("written")
    )


def preview(proposals: DataFrame, notes: DataFrame) -> DataFrame:
    """What applying each proposal on its own would write."""
    current = notes.select("note_path", F.col("raw").alias("existing"))
    p = proposals.join(current, "note_path", "left")
    exists = F.col("existing").isNotNull()
    existing = F.coalesce("existing", F.lit(""))
    overwrite = F.coalesce("overwrite", F.lit(False))
    final = (
        F.when((F.col("mode") == "append") & exists, merged_content(existing, F.col("content"), F.col("append_heading")))
        .when(F.col("mode") == "append", F.concat(X.strip(F.col("content")), F.lit("\n")))
        .when(exists & ~overwrite, existing)
        .otherwise(F.col("content"))
    )
    return p.select(
        *proposals.columns,
        exists.alias("exists"),
        ((F.col("mode") == "append") | ~exists | overwrite).alias("will_write"),
        existing.alias("existing_content"),
        final.alias("final_content"),
    )


def _number_turns(proposals: DataFrame) -> DataFrame:
    """Order of passes per path: neighbouring appends without a heading share one turn."""
    plain = (F.col("mode") == "append") & F.col("append_heading").isNull()
    marked = prefix_sums(proposals.withColumn("__plain", plain), ["note_path"], "pos", {"__breaks": F.when(F.col("__plain"), 0).otherwise(1)})
    slot = marked.withColumn("__slot", F.col("__breaks") * 2 + F.when(F.col("__plain"), 0).otherwise(1))
    order = Window.partitionBy("note_path").orderBy("__slot")
    turns = slot.select("note_path", "__slot").distinct().withColumn("turn", F.row_number().over(order) - 1)
    return slot.join(turns, ["note_path", "__slot"]).drop("__breaks", "__slot", "__plain")


def _append_runs(run: DataFrame, state: DataFrame) -> DataFrame:
    """Paths with a run of plain appends: all additions in order behind the existing note (or the first draft).

    The gathered texts of a path are the note that is written.
    """
    rows = run.groupBy("note_path").agg(
        F.sort_array(F.collect_list(F.struct("pos", "content", append_body(F.col("content")).alias("add")))).alias("items")
    )
    joined = rows.join(state.select("note_path", F.col("raw").alias("existing")), "note_path", "left")
    base = F.coalesce("existing", F.concat(X.strip(F.element_at("items", 1)["content"]), F.lit("\n")))
    later = F.when(F.col("existing").isNull(), F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))).otherwise(F.col("items"))
    adds = F.filter(F.transform(later, lambda i: X.strip(i["add"])), lambda a: a != "")
    text = F.when((F.size(later) == 0) & F.col("existing").isNull(), base).otherwise(
        F.concat(F.array_join(F.concat(F.array(X.rstrip(base)), adds), "\n\n"), F.lit("\n"))
    )
    return joined.select("note_path", text.alias("raw"), F.col("existing").isNull().alias("created"))


def apply_proposals(proposals: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, written notes, backups) of one batch in ``pos`` order.

    Later proposals of a path see what earlier ones wrote. A run of plain appends is merged at once;
    only writes and appends under a heading open a new pass, so the number of passes is the longest
    alternation on one path, not the number of its proposals.
    """
    valid, rejected = validate(proposals)
    ordered = _number_turns(valid)
    last = ordered.agg(F.max("turn")).first()[0]
    last = -1 if last is None else last
    if last > 0:
        ordered = cut_lineage(ordered)
    state = notes.select("note_path", "raw")
    results = rejected.select("pos", "note_path", F.lit("error").alias("status"), F.lit(False).alias("overwritten"), F.col("reason").alias("error"))
    backups, written = None, None
    exists_text = F.lit("Note already exists; pass overwrite=true to replace (a .bak backup is kept)")
    for turn in range(last + 1):
        now = ordered.filter(F.col("turn") == turn).drop("turn")
        plain = (F.col("mode") == "append") & F.col("append_heading").isNull()
        runs = now.filter(plain)
        merged = _append_runs(runs, state)
        done = preview(now.filter(~plain), state).withColumn(
            "status", merge_status(F.col("mode"), F.col("exists"), F.coalesce("overwrite", F.lit(False)))
        )
        if last > 0:
            merged, done = cut_lineage(merged), cut_lineage(done)
        replaced = (F.col("mode") == "write") & F.col("exists") & (F.col("status") == "written")
        error = F.when(F.col("status") == "skipped_exists", exists_text).when(F.col("status") == "error", F.lit("mode must be 'write' or 'append'"))
        first = runs.groupBy("note_path").agg(F.min("pos").alias("__first"))
        appended = (
            runs.join(first, "note_path").join(merged.select("note_path", "created"), "note_path")
            .withColumn("status", F.when(F.col("created") & (F.col("pos") == F.col("__first")), "written").otherwise("appended"))
        )
        none = F.lit(None).cast("string")
        results = results.unionByName(done.select("pos", "note_path", "status", replaced.alias("overwritten"), error.alias("error"))).unionByName(
            appended.select("pos", "note_path", "status", F.lit(False).alias("overwritten"), none.alias("error"))
        )
        saved = done.filter(replaced).select(
            F.concat("note_path", F.lit(".bak")).alias("backup_path"), "note_path", F.col("existing_content").alias("raw"), "pos"
        )
        backups = saved if backups is None else backups.unionByName(saved)
        out = done.filter(F.col("status").isin("written", "appended")).select("note_path", F.col("final_content").alias("raw")).unionByName(
            merged.select("note_path", "raw")
        )
        written = out if written is None else written.join(out.select("note_path"), "note_path", "left_anti").unionByName(out)
        if turn < last:
            state = state.join(out.select("note_path"), "note_path", "left_anti").unionByName(out)
    return results, written, backups
