"""Topics: what is made once, and what is not carried along."""

from pyspark.sql import functions as F

from noviscan.operators import titles as N
from noviscan.operators import topics as T
from noviscan.operators.ordering import keep_first


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keep_first_carries_what_is_read(spark):
    """all columns were one value, so texts were shuffled and sorted for their keys alone."""
    rows = spark.createDataFrame([(1, 2, None, "x"), (1, 1, "b", None), (2, 5, "c", "z")], "k int, at int, title string, text string")
    first = keep_first(rows, ["k"], ["at"])
    assert first.columns == rows.columns
    assert sorted(map(tuple, first.collect())) == [(1, 1, "b", None), (2, 5, "c", "z")]
    assert "text" not in plan(first.select("k", "title")).split("\n", 1)[0] and "min_by(text" not in plan(first.select("k", "title"))


def test_topic_flags_come_with_their_titles(spark):
    """low value was judged again in each of three branches, after texts had been moved for it."""
    rows = [(1, 0, "# One\nThe river runs to the sea."), (1, 1, "12 34 56 78 90 " * 30), (2, 0, "99 88 77 66 " * 30)]
    segments = spark.createDataFrame(rows, "source_id long, segment_index long, text string")
    scores = segments.select("source_id", "segment_index", F.lit(True).alias("is_novel"), F.lit(False).alias("is_unknown"))
    sources = segments.select("source_id", F.lit("Source").alias("title")).distinct()
    found = T.plan_topics(sources, segments, scores).select("source_id", "topic_pos", "title", "is_novel", "rank")
    assert "regexp_count" not in plan(found)
    assert sorted((r["source_id"], r["topic_pos"]) for r in found.collect()) == [(1, 0), (2, 0)]


def test_salient_runs_skip_general_words(one):
    assert one(lambda t: N.salient_ngram(t), t="alpha beta gamma system alpha beta gamma model alpha beta") == "Alpha Beta Gamma"
    assert one(lambda t: N.salient_ngram(t), t="alpha system beta model gamma data") == "Alpha"
