"""Cues from WebVTT text and greedy cue windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.operators.ordering import ordered_fold

TIMING = r"(?U)^(\d{2}:\d{2}:\d{2}\.\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2}\.\d{3})"  # fixed value


def _seconds(stamp: Column) -> Column:
    return (
        F.substring(stamp, 1, 2).cast("int") * 3600
        + F.substring(stamp, 4, 2).cast("int") * 60
        + F.substring(stamp, 7, 6).cast("double")
    )


def vtt_cues(content: Column) -> Column:
    """array<struct<start,duration,text>>: text between timing lines, tags and counters removed."""
    lines = F.filter(
        F.transform(X.split_lines(content), X.strip),
        lambda s: (s != "") & ~s.startswith("WEBVTT") & ~s.startswith("NOTE"),
    )

    def over(ls):
        def build(marks):
            def cue(at, i):
                stop = F.coalesce(F.get(marks, i + 1) - 1, F.size(ls))
                body = F.filter(F.slice(ls, at + 1, F.greatest(stop - at, F.lit(0))), lambda s: ~s.rlike(r"(?U)^\d+$"))
                clean = X.nonempty(F.transform(body, lambda s: F.regexp_replace(s, "<[^>]+>", "")))
                start = _seconds(F.regexp_extract(F.element_at(ls, at), TIMING, 1))
                end = _seconds(F.regexp_extract(F.element_at(ls, at), TIMING, 2))
                return F.struct(
                    start.alias("start"),
                    F.greatest(F.lit(0.0), end - start).alias("duration"),
                    X.squeeze(F.array_join(clean, " ")).alias("text"),
                )

            return F.filter(F.transform(marks, cue), lambda c: c["text"] != "")

        marks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1))), lambda n: F.coalesce(F.get(ls, n - 1), F.lit("")).rlike(TIMING))
        return X.let(marks, build)

    return X.let(lines, over)


WINDOW_SCHEMA = "window_index int, text string, ts_start double, ts_end double"


def cue_windows(cues: DataFrame, video: str = "video_id", cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Greedy windows: close once a cue ends ``cue_window_seconds`` or more after the window start.

    Input columns: video, pos, start, duration, text. The scan holds one open window, never a video.
    """
    schema = T.StructType([cues.schema[video], *T._parse_datatype_string(WINDOW_SCHEMA).fields])
    span = cfg.cue_window_seconds

    def close(state):
        index, key, opened, ended, parts = state
        return (index + 1, key, None, None, []), [(key, index, " ".join(parts).strip(), opened, ended)]

    def step(state, row):
        key, _pos, start, duration, words = row
        index, _key, opened, _ended, parts = state or (0, key, None, None, [])
        opened = start if opened is None else opened
        ended = start + duration
        state = (index, key, opened, ended, [*parts, words])
        return close(state) if ended - opened >= span else (state, [])

    def finish(state):
        return close(state)[1] if state[4] else []

    rows = cues.select(video, "pos", F.col("start").cast("double"), F.col("duration").cast("double"), "text")
    return ordered_fold(rows, [video], ["pos"], schema, step, finish)
