"""Location text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss."""
    total = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, s = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h, pad(m), pad(s))).otherwise(F.concat_ws(":", m, pad(s)))


def _span(word: str, start: Column, end: Column) -> Column:
    wide = F.coalesce((end != 0) & (end != start), F.lit(False))
    return F.when(
        start.isNotNull(),
        F.when(wide, F.concat(F.lit(f"{word}s "), start, F.lit("-"), end)).otherwise(F.concat(F.lit(f"{word} "), start)),
    )


def display(loc: dict[str, Column]) -> Column:
    """Readable location from its eight fields."""
    place = F.coalesce(
        _span("chapter", loc["chapter"], loc["chapter_end"]), _span("page", loc["page"], loc["page_end"])
    )
    lines = _span("line", loc["line_start"], loc["line_end"])
    t0 = clock(loc["ts_start"])
    t1 = clock(F.coalesce(F.when(loc["ts_end"] != 0, loc["ts_end"]), loc["ts_start"]))
    times = F.when(loc["ts_start"].isNotNull(), F.when(t0 != t1, F.concat(t0, F.lit("-"), t1)).otherwise(t0))
    return F.coalesce(F.nullif(F.concat_ws(", ", place, lines, times), F.lit("")), F.lit("unknown"))


def fields(prefix: str = "") -> dict[str, Column]:
    names = ("page", "page_end", "chapter", "chapter_end", "line_start", "line_end", "ts_start", "ts_end")
    return {n: F.col(prefix + n) for n in names}
