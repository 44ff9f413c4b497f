"""What must not grow with the square of a group, or be shuffled though nothing happens to it."""

import random

from pyspark.sql import functions as F

from noviscan.llm import jaccard_join, line_dedup, linking
from noviscan.llm.base import parted, without, written


def test_variants_that_do_not_link_are_hardly_paired(spark, monkeypatch):
    """Variants of one text, 0.34 apart: all meet in the lists of their shingles, the sketches keep them apart."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for n in range(90):
        words = list(base)
        for at in rng.sample(range(5, 395), 16):
            words[at] = f"x{n}_{at}"
        texts.append(" ".join(words))
    texts.append(" ".join(texts[7].split()[:-20]))
    counts = []

    def counted(df, name):
        out = written(df, name)
        if name == "cross-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(linking, "written", counted)
    rows = jaccard_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    linked = {(a, b) for a in range(91) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    root = list(range(91))
    for a, b in sorted(linked) * 91:
        root[a] = root[b] = min(root[a], root[b])
    assert (90, 7) in linked
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(root))
    assert sum(counts) < 91 * 90 // 2 // 4


def test_stages_shuffle_only_rows_that_a_join_may_touch(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("text").alias("text")).union(spark.sql("SELECT 7L, 'again'"))
    gone = written(spark.sql("SELECT explode(array(7L, 9L, 19999L, NULL)) AS doc_id"), "gone")
    perhaps, stay = parted(docs, "doc_id", gone)
    assert perhaps.count() < 30 and perhaps.count() + stay.count() == 20_001
    got = without(docs, gone)
    assert got.count() == 20_001 - 5 and got.filter("doc_id IS NULL OR doc_id IN (7, 9, 19999)").isEmpty()


def test_lines_are_dropped_from_the_documents_that_repeat_them_only(spark):
    line = "this very line is long enough to be compared with others"
    texts = [f"{line}\nown {k} words of it" if k % 50 == 0 else f"nothing {k ** 3} else {k}" for k in range(200)]
    texts[3] = None
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(docs).collect()}
    want = {k: f"own {k} words of it" if k in (50, 100, 150) else t for k, t in enumerate(texts)}
    assert got == want
