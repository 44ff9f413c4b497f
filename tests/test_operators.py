"""Small fixtures for single operators, and brute-force checks of the order-dependent ones."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF
from noviscan import DEFAULTS, EngineConfig
from noviscan.catalog.base import table
from noviscan.catalog.inputs import markdown
from noviscan.functions import identity as D
from noviscan.functions import links as L
from noviscan.functions import locations as P
from noviscan.functions import text as X
from noviscan.functions import vectors as V
from noviscan.operators import chunking as C
from noviscan.operators import dedupe as DD
from noviscan.operators import evidence as E
from noviscan.operators import index as I
from noviscan.operators import links as G
from noviscan.operators import merge as M
from noviscan.operators import novelty as N
from noviscan.operators import prompts as Q
from noviscan.operators import proposals as O
from noviscan.operators import relevance as R
from noviscan.operators import runs as RU
from noviscan.operators import search as SE
from noviscan.operators import similarity as K
from noviscan.operators import titles as T
from noviscan.operators import topics as TP
from noviscan.operators.ordering import dense_index, prefix_sums
from noviscan.sources import notes as NO
from noviscan.sources import segments as S
from noviscan.sources import transcripts as TR


def texts(chunks):
    return [c["text"] for c in chunks]


def test_config_checks():
    with pytest.raises(ValueError):
        EngineConfig(novel_threshold=0.8)
    with pytest.raises(ValueError):
        EngineConfig(chunk_overlap=1000)


# --- chunks ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [60, 140, 400])
def test_chunks_hold_the_text_in_order(one, size):
    """Without overlap the words of all chunks are those of the body, and each chunk names the heading above it."""
    rng = np.random.default_rng(size)
    parts, wanted, above = [], [], []
    for section in range(5):
        parts.append(f"# Part {section}")
        for _ in range(3):
            words = [f"s{section}w{k}" for k in rng.integers(0, 1000, int(rng.integers(3, 40)))]
            parts.append(" ".join(words) + ".")
            wanted += [w.rstrip(".") for w in words]
            above += [f"Part {section}"] * len(words)
    got, headings = [], []
    for chunk in one(lambda t: C.chunks(t, size, 0), t="\n\n".join(parts)):
        words = re.findall(r"s\d+w\d+", chunk["text"])
        got += words
        headings += [chunk["heading"]] * len(words)
        assert len(chunk["text"]) <= size + len("# Part 0\n\n") + 40
    assert got == wanted
    if size == 60:
        assert headings == above


def reference_units(body):
    fence, item = re.compile(r"\s*```"), re.compile(r"\s*([-*+]|\d+\.)\s")
    lines = [ln + "\n" for ln in body.split("\n")]
    lines[-1] = lines[-1][:-1]
    out, kind = [], None
    for ln in lines:
        blank = not ln.strip()
        if kind == "fence":
            out[-1] += ln
            if fence.match(ln):
                kind = None
            continue
        if blank:
            kind = None
        elif fence.match(ln):
            out.append(ln)
            kind = "fence"
        elif item.match(ln):
            if kind == "list":
                out[-1] += ln
            else:
                out.append(ln)
                kind = "list"
        elif kind == "list" and ln.startswith(("  ", "\t")):
            out[-1] += ln
        elif kind == "para":
            out[-1] += ln
        else:
            out.append(ln)
            kind = "para"
    return out


def pack_brute(units, size, overlap):
    done, held = [], []

    def cut():
        text = "".join(held).strip()
        if text:
            done.append(text)
        keep = []
        for u in reversed(held):
            if keep and sum(map(len, keep)) + len(u) > overlap:
                break
            keep.insert(0, u)
        held[:] = keep if overlap > 0 else []

    for u in units:
        if held and len("".join(held)) + len(u) > size:
            cut()
        held.append(u)
    if "".join(held).strip():
        done.append("".join(held).strip())
    return done


def test_chunks_against_brute_force(spark):
    """Whole documents whose units all fit: sections, units, packing and overlap by plain loops."""
    overlap = 150
    rows = table(spark, SF, "documents").select(
        "doc_id", F.concat(F.lit("- a\n  b\n1. c\n\n```\nx\n\ny\n```\n"), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\ntail\n* z")).alias("text")
    )
    for size in (400, 2000):
        made = rows.select("text", C.chunks(F.col("text"), size, overlap).alias("c")).collect()
        checked = 0
        for row in made:
            units = reference_units(row["text"].strip())
            if re.search(r"(?m)^#{1,6}\s", row["text"]) or any(len(u) > size for u in units):
                continue
            checked += 1
            assert texts(row["c"]) == pack_brute(units, size, overlap)
        assert checked > 20


def test_chunks_lose_no_words(spark):
    # Pieces of a split unit are glued without a blank, so words are looked up in the running text.
    rows = markdown(spark, SF).select("text", C.chunks(F.col("text"), 300, 60).alias("c")).collect()
    for row in rows:
        whole = "\n".join(texts(row["c"]))
        body = re.sub(r"(?m)^#{1,6}\s+.*$", "", row["text"])
        assert all(word in whole for word in body.split())


def blocks_brute(text, limit):
    def hard(t):
        return [p.strip() for p in (t[i : i + limit] for i in range(0, len(t), limit)) if p.strip()]

    def group(parts, sep):
        out, held, used = [], [], 0
        for p in parts:
            if len(p) > limit:
                out += [sep.join(held)] if held else []
                out, held, used = out + hard(p), [], 0
                continue
            if held and used + len(p) + len(sep) > limit:
                out, held, used = [*out, sep.join(held)], [], 0
            held, used = [*held, p], used + len(p) + len(sep)
        return out + ([sep.join(held)] if held else [])

    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    for pattern, sep in ((r"\n\s*\n", "\n\n"), (r"(?<=[.!?])\s+", " ")):
        parts = [p.strip() for p in re.split(pattern, text) if p.strip()]
        if len(parts) > 1:
            return group(parts, sep)
    return hard(text)


def test_planning_blocks_against_brute_force(spark):
    for limit in (80, 1200):
        for row in markdown(spark, SF).select("text", C.text_blocks(F.col("text"), limit).alias("b")).collect():
            assert row["b"] == blocks_brute(row["text"], limit)


def test_sentences_are_cut_between_full_stops_only(one):
    parts = ["Prof. Okafor et al. left at noon.", "Was e.g. the 3.5 ratio kept?", "Nobody said!", "It ended"]
    assert one(X.sentences_keeping_abbreviations, t=" ".join(parts[2:])) == parts[2:]
    assert "".join(one(X.sentences_keeping_abbreviations, t=" ".join(parts))).replace(" ", "") == "".join(parts).replace(" ", "")


# --- notes and links ------------------------------------------------------------------------------


def notes_of(spark, *rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1][:-3], a, []) for p, a in rows], "note_path string, title string, aliases array<string>, tags array<string>")


def test_link_resolution_fixture(spark):
    notes = notes_of(spark, ("a/Foo.md", ["Foo Alias"]), ("b/Foo.md", []), ("Bar.md", []))
    links = spark.createDataFrame([("Bar",), ("a/Foo",), ("Foo Alias",), ("Foo",), ("A/foo.md#x",)], "link string")
    got = {r["link"]: r["target"] for r in G.resolve_links(links, notes).collect()}
    assert got == {"Bar": "Bar.md", "a/Foo": "a/Foo.md", "Foo Alias": "a/Foo.md", "Foo": None, "A/foo.md#x": "a/Foo.md"}
    assert [r["stem"] for r in G.duplicate_stems(notes).collect()] == ["foo"]


def test_link_normalization(one):
    for raw, clean in {"folder/Note.md#Heading": "folder/Note", "Note^block": "Note", "./Note": "Note"}.items():
        assert one(L.normalize_link, t=raw) == clean


def test_note_parsing(spark):
    raw = '---\ntags: "one, two"\nrelated: ["[[Data Structures]]", "plain text"]\nsummary: see [[Python Basics|x]]\n---\n#python in `#code` and #data-engineering/spark\n```\n#no\n```\n![[B|label]] [[A]]'
    bad = "---\na: b: c\n---\nbody"
    rows = NO.parse_notes(spark.createDataFrame([("x/N.md", raw), ("y.md", bad)], "note_path string, raw string")).orderBy("note_path").collect()
    assert rows[0]["tags"] == ["one", "two", "python", "data-engineering/spark"]
    assert rows[0]["wikilinks"] == ["B", "A", "Data Structures", "Python Basics"]
    assert rows[1]["content"] == "body" and rows[1]["frontmatter"] == {}


def test_vault_scan_reads_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "templates").mkdir()
    (tmp_path / "sub dir" / "Note A.md").write_text("# A\n[[B]]", encoding="utf-8")
    (tmp_path / "templates" / "t.md").write_text("x", encoding="utf-8")
    (tmp_path / ".hidden.md").write_text("x", encoding="utf-8")
    rows = NO.parse_notes(NO.read_note_files(spark, str(tmp_path))).collect()
    assert [(r["note_path"], r["wikilinks"]) for r in rows] == [("sub dir/Note A.md", ["B"])]


def test_source_identity(one):
    same = {one(lambda u: D.source_key(F.lit(""), u), u=u) for u in ("https://youtu.be/abc", "https://www.youtube.com/watch?v=abc&t=1", "youtube.com/shorts/abc")}
    assert same == {"youtube:abc"}
    assert one(D.canonical_url, u="HTTPS://Ex.com/a/?utm_source=1&b=2#x") == "https://ex.com/a?b=2"


def test_incremental_index(spark, tmp_path):
    from noviscan.plans.index import ChunkIndex
    from noviscan.udfs import hashing_embedder

    def notes(text):
        rows = [("A.md", "alpha beta\n[[B]]"), ("B.md", text), ("C.md", "gamma")]
        return NO.parse_notes(spark.createDataFrame(rows, "note_path string, raw string")).withColumn("mtime", F.lit(1))

    idx = ChunkIndex(spark, str(tmp_path), hashing_embedder)
    assert idx.refresh(notes("beta"))["index_mode"] is not None
    first = idx.table("stats").first()
    again = idx.refresh(notes("beta")).first()
    edited = idx.refresh(notes("beta more")).first()
    assert (first["index_mode"], first["indexed_notes"]) == ("full", 3)
    assert (again["index_mode"], again["indexed_notes"], again["skipped_notes"]) == ("incremental", 0, 3)
    assert (edited["indexed_notes"], edited["skipped_notes"], edited["chunk_count"]) == (1, 2, 3)
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    assert idx.query(asked, 1).first()["note_path"] == "A.md"
    assert idx.keyword("gamma").first()["note_path"] == "C.md"


# --- similarity and novelty -----------------------------------------------------------------------


def test_strategies_agree(spark):
    e = table(spark, SF, "embeddings")
    runs = [
        sorted(map(tuple, K.top_k(e, e, 4, query_id="vec_id", chunk_id="vec_id", differ_on="vec_id", strategy=s).collect()))
        for s in ("broadcast", "cells")
    ]
    assert runs[0] == runs[1]


def test_hot_group_is_split(spark, monkeypatch):
    """A group larger than a block gives the same rows as plain numpy."""
    monkeypatch.setattr(K, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(K, "QUERY_BLOCKS_PER_TASK", 2)
    e = table(spark, SF, "embeddings").withColumn("g", F.lit("hot"))
    got = {(r["query_id"], r["raw_rank"]): r["chunk_id"] for r in K.top_k(e, e, 2, query_id="vec_id", chunk_id="vec_id", group="g", differ_on="vec_id").collect()}
    rows = sorted(e.select("vec_id", "embedding").collect())
    m = K.unit_rows([r["embedding"] for r in rows])
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :2]
    assert got == {(rows[i]["vec_id"], k + 1): rows[best[i, k]]["vec_id"] for i in range(len(rows)) for k in range(2)}


def test_tag_boost_fixtures(spark):
    row = spark.range(1).select(
        V.tag_boost(F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b")), DEFAULTS).alias("one"),
        V.tag_boost(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), DEFAULTS).alias("three"),
        V.tag_boost(F.lit(None).cast("array<string>"), F.array(F.lit("a")), DEFAULTS).alias("none"),
        V.for_verdict(F.lit(0.5), F.array(F.lit("a")), F.array(F.lit("a")), DEFAULTS).alias("low"),
    ).first()
    assert (round(row["one"], 6), round(row["three"], 6), row["none"], row["low"]) == (0.06, 0.15, 0.0, 0.5)


def scores_of(spark, *sims):
    return spark.createDataFrame([(1, 0, s, s < 0.55, s >= 0.75) for s in sims], "source_id int, segment_index int, best_similarity double, is_novel boolean, is_known boolean")


def test_verdict_fixtures(spark):
    def verdict(*sims):
        return N.source_verdicts(scores_of(spark, *sims)).first()["verdict"]

    assert verdict(0.92, 0.92) == "Already known"
    assert verdict(0.2) == "Novel"
    assert verdict(0.9, 0.2) == "Partially new"
    segment = N.segment_scores(scores_of(spark, 0.9, 0.2)).first()
    assert segment["is_novel"] and segment["best_similarity"] == 0.2
    empty = spark.createDataFrame([(7,)], "source_id int")
    assert tuple(N.source_verdicts(scores_of(spark, 0.9), empty).select("verdict", "novelty_score").first()) == ("Novel", 1.0)


def matches_of(spark, rows):
    return spark.createDataFrame(
        [(1, i + 1, p, b, None, t, q) for i, (p, b, t, q) in enumerate(rows)],
        "query_id int, rank int, note_path string, base_similarity double, heading string, tags array<string>, query_tags array<string>",
    )


def test_append_gate_fixtures(spark):
    def target(cfg, *rows):
        got = N.append_targets(matches_of(spark, rows), cfg).collect()
        return got[0]["append_target"] if got else None

    cfg = DEFAULTS.replace(append_margin=0.1)
    assert target(DEFAULTS.replace(known_threshold=0.85), ("a.md", 0.5, [], [])) is None
    assert target(cfg, ("a.md", 0.82, [], []), ("b.md", 0.80, [], [])) is None
    assert target(cfg, ("a.md", 0.92, [], []), ("b.md", 0.75, [], [])) == "a.md"
    assert target(cfg, ("a.md", 0.92, ["history"], ["programming"])) is None
    assert target(cfg, ("a.md", 0.92, ["history"], ["History"])) == "a.md"


def claim_brute(vectors, threshold):
    m = np.round(K.unit_rows(vectors) @ K.unit_rows(vectors).T, 9)
    owner = {}
    for i in range(len(m)):
        if i not in owner:
            for j in range(i + 1, len(m)):
                if j not in owner and m[i, j] >= threshold:
                    owner[j] = i
    return owner


def test_duplicate_claiming(spark):
    def run(vectors, threshold):
        rows = [("s", i, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
        df = spark.createDataFrame(rows, "source_id string, item_id int, pos long, embedding array<double>")
        got = DD.claim_duplicates(df, DEFAULTS.replace(duplicate_threshold=threshold)).collect()
        return {r["item_id"]: r["duplicate_of"] for r in got}

    assert run([[1, 0], [0.999, 0.01], [0, 1]], 0.9) == {1: 0}
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 3))
    vectors[40:55] = vectors[5]
    assert run(vectors, 0.85) == claim_brute(vectors, 0.85)


def clustered(n, centres, noise):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(centres, 12))
    return middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, 12))


def claim_frame(spark, vectors):
    rows = [("s", i, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "source_id string, item_id int, pos long, embedding array<double>")


def test_claims_of_a_large_source(spark):
    """The angular cells and rounds give what the walk and brute force give, zero and null vectors included."""
    vectors = np.vstack([clustered(300, 12, 0.25), np.zeros((2, 12))])
    vectors[200:220] = vectors[7]
    df = claim_frame(spark, vectors).union(spark.sql("SELECT 's', 999, 999L, CAST(NULL AS ARRAY<DOUBLE>)"))
    cfg = DEFAULTS.replace(duplicate_threshold=0.9)
    for most in (50, 4096):
        got = {r.item_id: r.duplicate_of for r in DD.claim_duplicates(df, cfg, most).collect()}
        assert got == claim_brute(vectors, 0.9)


def test_claim_cells_rule_most_pairs_out(spark):
    vectors = clustered(4000, 60, 0.05)
    items = claim_frame(spark, vectors).withColumnRenamed("source_id", "cell")
    routed = DD.angular_cells(items, 0.9)
    sizes = routed.groupBy(F.col("home").alias("cell")).count()
    compared = routed.select(F.explode("visits").alias("cell")).join(sizes, "cell").agg(F.sum("count")).first()[0]
    assert compared < 4000 * 4000 / 10
    apart = DD.angular_cells(claim_frame(spark, np.random.default_rng(1).normal(size=(300, 40))).withColumnRenamed("source_id", "cell"), 0.2)
    assert {(r.home, *r.visits) for r in apart.collect()} == {("s", "s")}


# --- filters and scoring --------------------------------------------------------------------------


def test_boilerplate_fixtures(one):
    toc = "\n".join(f"Chapter {i} ........ {i}" for i in range(5))
    for text in ("Acknowledgements", "## Table of Contents", "References\n[1] A", toc, ""):
        assert one(R.boilerplate, t=text)
    assert not one(R.boilerplate, t="Gradient descent updates parameters along the negative gradient of the loss.")
    assert one(R.boilerplate_title, t="Chapter 3: Summary")
    assert not one(R.boilerplate_title, t="Summary of gradient descent optimization")
    assert one(R.low_value, t="http://a.b https://c.d www.e.f OceanofPDF.com")


def test_update_fixtures(spark):
    def kind(a, b, s=0.9):
        return spark.createDataFrame([(a, b)], "a string, b string").select(R.update_type(F.col("a"), F.col("b"), F.lit(s))["update_type"]).first()[0]

    assert kind("It is not stable.", "It is stable.") == "contradiction"
    assert kind("Released in 2026.", "Released in 2024.") == "update"
    assert kind("Takes 25 ms.", "Takes 40 ms.") == "update"
    assert kind("Takes 25 ms.", "Takes 40 ms.", 0.4) is None


def test_page_quality(one):
    assert one(R.unreliable_page, t="short")
    assert one(R.unreliable_page, t="zxcv bcdf ghjk lmnp qrst vwxz " * 6)
    assert not one(R.unreliable_page, t="The quick brown fox jumps over the lazy dog near a calm river bank every day. " * 2)


def test_titles(one, spark):
    assert one(X.compose_title, t="## 1.2 Gradient Descent") == "Gradient Descent"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Alpha Concept", "Beta Concept", "Alpha Concept", "Gamma"])], "source_id int, pos long, title string")
    got = [r["out"] for r in T.disambiguate(rows, "source_id", "pos", "title", "out").orderBy("pos").collect()]
    assert got == ["Alpha Concept (part 1)", "Beta Concept", "Alpha Concept (part 2)", "Gamma"]
    body = spark.createDataFrame([("Cosine similarity is a measure of the angle between vectors. It ranges from zero to one.", "")], "b string, h string")
    assert T.refine_title(T.stage_body(body, "b"), "b", "h", "t").first()["t"].startswith("Cosine Similarity")


def test_quality_fixture(one):
    good = (
        "---\na: b\n---\n# Gradient Descent\n\nGradient descent is a method that follows the slope of a loss.\n\n"
        "## Key points\n\n- gradient one\n- descent two\n\n## Related notes\n\n- [[Optimizer]]\n"
    )
    full = one(lambda t: O.quality(F.lit("Gradient Descent"), t), t=good)
    weak = one(lambda t: O.quality(F.lit("Other"), t), t="# Wrong\n\nshort")
    assert full["quality_score"] >= 0.8 and weak["quality_score"] < full["quality_score"] and "heading_mismatch" in weak["quality_flags"]


def test_prompt_budget(spark):
    text = " ".join(f"Sentence {i} explains that the method has a limit of {i} percent for case {i}." for i in range(40))
    packs = E.evidence_packs(spark.createDataFrame([(text,)], "text string"))
    for limit in (4000, 700, 250, 100, 30):
        assert len(packs.select(E.packed_prompt(F.col("l3"), F.col("l2"), F.col("l1"), F.col("media_hints"), limit)).first()[0]) <= limit + 1


def test_refine_body(one):
    got = one(O.refine_body, t="# T\ntext\n\n\n\n- a\n- A\n## S\n- a\n```\n\n\n- x\n- x\n```\nend")
    assert got.startswith("# T\n\ntext\n\n- a\n\n## S\n\n- a\n\n```\n") and got.endswith("- x\n- x\n```\nend\n")
    assert "- A" not in got
    assert one(O.refine_body, t="- a\n```\nx\n```\n- a\n- b") == "- a\n\n```\nx\n```\n- b\n"
    assert one(O.refine_body, t="- a\n```\nx\n```\n# S\n- a") == "- a\n\n```\nx\n```\n\n# S\n\n- a\n"


def test_keyword_search_many_counts_substrings(spark):
    chunks = spark.createDataFrame(
        [(1, "p1", None, "H", "the newest idea"), (2, "p2", "t", None, "a new, idea"), (3, "p3", "t", "h", "new idea"), (4, "p4", "t", "h", "news")],
        "chunk_id long, note_path string, note_title string, heading string, text string",
    )
    asked = spark.createDataFrame([(1, "new idea"), (2, "e"), (3, "x"), (4, " "), (5, "NEWS")], "query_id long, query string")
    many = {(r.query_id, r.chunk_id, r.score) for r in SE.keyword_search_many(chunks, asked).collect()}
    assert many == {(q.query_id, r.chunk_id, r.score) for q in asked.collect() for r in SE.keyword_search(chunks, q.query).collect()}
    assert {c for q, c, _ in many if q == 1} == {1, 2, 3}


def test_upsert_graph_equals_a_rebuild(spark):
    """A dangling link finds its note, a name becomes ambiguous, a target goes, an alias moves."""
    schema = "note_path string, title string, aliases array<string>, tags array<string>, wikilinks array<string>"

    def note(path, links=(), aliases=()):
        return (path, path.rsplit("/", 1)[-1].removesuffix(".md"), list(aliases), [], list(links))

    before = [note("A.md", ["B", "x/C", "D", "Nick", "E"]), note("x/C.md"), note("D.md"), note("E.md", ["A"]), note("F.md", [], ["Nick"])]
    after = [before[0], note("B.md", ["A"]), note("x/C.md"), note("D.md"), note("y/D.md"), note("F.md"), note("G.md", ["nick"], ["Nick"])]
    touched = spark.createDataFrame([(p,) for p in ("B.md", "y/D.md", "E.md", "F.md", "G.md")], "note_path string")
    old, new = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    nodes, edges = G.upsert_graph(G.graph_nodes(old), G.graph_edges(old), new, touched)
    assert sorted(edges.collect()) == sorted(G.graph_edges(new).collect()) and edges.count() == 5
    assert {r.note_path for r in nodes.collect()} == {n[0] for n in after}


def test_complete_arrays_beat_loose_objects(spark):
    cases = [
        ('[{"title":"A"}] and {"title":"B","body":"b","id":"1"}', ["A"]),
        ('{"notes":[{"title":"A"}]} {"title":"B","body":"b"}', ["A"]),
        ('see {"title":"A"} then {"title":"B"', ["A"]),
        ('[1, 2]\n[{"title":"A","body":"b"}]', ["A"]),
        ("nothing", []),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "reply_id long, reply string")
    got = Q.reply_items(rows).orderBy("reply_id", "at").collect()
    assert [[r.title for r in got if r.reply_id == k] for k in range(len(cases))] == [want for _, want in cases]


def test_run_guard_orders_over_frames():
    from noviscan.streaming.feeds import RunGuard

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    guard = RunGuard(100, 0, 2)
    guard.state = Value()
    frames = [pd.DataFrame({"seq": s, "prompt_chars": [1, 1], "failed": f}) for s, f in (([4, 3], [True, True]), ([2, 1], [False, True]))]
    out = pd.concat(guard.handleInputRows(("r",), iter(frames), None))
    assert out["seq"].tolist() == [1, 2, 3, 4] and out["streak"].tolist() == [1, 0, 1, 2] and out["disabled"].tolist() == [False] * 3 + [True]


def test_long_chains_of_claims_end(spark):
    """Each item is near its neighbours only; every second one is kept."""
    import math

    n = 40
    rows = [("s", k, k, [math.cos(0.3 * k), math.sin(0.3 * k), 2.0 * k / n]) for k in range(n)]
    df = spark.createDataFrame(rows, "source_id string, item_id long, pos long, embedding array<double>")
    unit = [[x / math.sqrt(sum(y * y for y in r[3])) for x in r[3]] for r in rows]
    kept, claims = [], {}
    for k in range(n):
        near = [j for j in kept if sum(a * b for a, b in zip(unit[j], unit[k])) >= 0.9]
        if near:
            claims[k] = near[0]
        else:
            kept.append(k)
    got = {r.item_id: r.duplicate_of for r in DD.claim_duplicates(df, DEFAULTS.replace(duplicate_threshold=0.9)).collect()}
    assert got == claims and len(kept) > 10


# --- runs, ordering, merging ----------------------------------------------------------------------


def test_prefix_sums_cross_blocks(spark):
    rows = spark.range(10_000).selectExpr("'hot' AS k", "id AS pos", "id % 7 AS v")
    got = prefix_sums(rows, ["k"], "pos", {"s": "v"}).filter("pos = 9999").first()["s"]
    assert got == sum(i % 7 for i in range(9999))
    assert dense_index(rows.filter("pos % 3 = 1"), ["k"], "pos", "i").agg(F.max("i")).first()[0] == 3332


def test_cue_windows_fixture(spark):
    cues = spark.createDataFrame([("v", i, float(s), float(d), f"w{i}") for i, (s, d) in enumerate([(0, 10), (12, 10), (25, 10), (40, 5)])], "video_id string, pos int, start double, duration double, text string")
    got = [(r["text"], r["ts_start"], r["ts_end"]) for r in TR.cue_windows(cues).orderBy("window_index").collect()]
    assert got == [("w0 w1 w2", 0.0, 35.0), ("w3", 40.0, 45.0)]


def test_segment_cap_fixture(spark):
    segs = spark.createDataFrame([(1, 0, "abcd"), (1, 1, "efgh")], "source_id int, segment_index int, text string")
    assert [r["text"] for r in S.cap_characters(segs, 6).orderBy("segment_index").collect()] == ["abcd", "ef"]
    assert S.cap_warnings(segs, 6).count() == 1


def test_budget_schedule_against_loop(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(50, 400, size=40)]
    cfg = DEFAULTS.replace(budget_chars=4000, budget_calls=0, draft_batch=4)
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "run_id int, pos long, chars long")
    got = {r["pos"]: r["batch"] for r in RU.shrink_batches(rows, 100, cfg).collect()}
    want, at, used, batch = {}, 0, 0, 0
    while at < len(sizes):
        take = next((t for t in range(min(4, len(sizes) - at), 0, -1) if used + 100 + sum(sizes[at : at + t]) <= 4000), 0)
        if not take:
            break
        want.update({at + j: batch for j in range(take)})
        used, at, batch = used + 100 + sum(sizes[at : at + take]), at + take, batch + 1
    assert got == {i: want.get(i) for i in range(len(sizes))}


def test_secrets_are_redacted(spark):
    logs = spark.createDataFrame([(1, 1, "token=abc password: xyz ok")], "log_id int, ts int, message string")
    assert RU.recent_logs(logs).first()["message"] == "[redacted] [redacted] ok"


def test_merge_sees_earlier_writes(spark):
    p = spark.createDataFrame(
        [(0, "n.md", "# New\nbody", "write", False, None), (1, "n.md", "more", "append", False, None), (2, "n.md", "again", "write", False, None),
         (3, "n.md", "under", "append", False, "New"), (4, "/abs.md", "x", "write", False, None)],
        "pos long, note_path string, content string, mode string, overwrite boolean, append_heading string",
    )
    results, written, _ = M.apply_proposals(p, spark.createDataFrame([("o.md", "old")], "note_path string, raw string"))
    assert [r["status"] for r in results.orderBy("pos").collect()] == ["written", "appended", "skipped_exists", "appended", "error"]
    text = written.first()["raw"]
    assert text.index("body") < text.index("under") < text.index("more")


def test_json_recovery_and_claims(spark):
    replies = spark.createDataFrame([(1, 'x ```json\n[{"title": "A"}, {"title": "B", "body": "[[L]]"}]\n``` y'), (2, "none")], "reply_id int, reply string")
    assert [r["title"] for r in Q.reply_items(replies).orderBy("at").collect()] == ["A", "B"]


def test_location_display(spark):
    def show(**known):
        at = {n: F.lit(known.get(n)).cast(t) for n, t in S.LOCATION_FIELDS.items()}
        return spark.range(1).select(P.display(at)).first()[0]

    assert show(page=2, page_end=4, line_start=1) == "pages 2-4, line 1"
    assert show(ts_start=3661.0, ts_end=3700.0) == "1:01:01-1:01:40"
    assert show() == "unknown"



def test_title_letters_stay_single(one):
    titles = ["\xdfheit und so", "ﬁn den", "ᾳ alpha", "\xe4pfel", "ŉ an"]
    assert [one(X.compose_title, t=t) for t in titles] == ["ẞheit und so", "ﬁn den", "ᾼ alpha", "\xc4pfel", "ŉ an"]
    import duckdb

    shown = duckdb.execute("SELECT list_transform(?, lambda c: upper(c[1]))", [titles]).fetchall()[0][0]
    assert [one(X.compose_title, t=t)[0] for t in titles] == shown


def test_composed_titles_lose_one_suffix(spark):
    rows = spark.createDataFrame([(1, 1, "Alpha 93 (part 2)"), (1, 2, "Beta (853) (part 3)"), (1, 3, "Beta (853)"), (1, 4, "Gamma 7"), (1, 5, "gamma 7")], "source_id int, pos long, title string")
    got = [r["out"] for r in T.disambiguate(rows, "source_id", "pos", "title", "out", composed=True).orderBy("pos").collect()]
    assert got == ["Alpha 93", "Beta (853)", "Beta", "Gamma 7 (part 1)", "gamma 7 (part 2)"]


def test_sentence_scores_round_halves_up(spark):
    """193 / (128 * 8) = 0.1884765625: the tenth decimal is a half, the ninth is even."""
    first = " ".join(["aaa", *[f"one{k}" for k in range(62)], "thrice"])
    second = " ".join(["aaa"] * 127 + ["thrice"] * 2)
    rows = spark.createDataFrame([([first + ".", second + "."],), (None,), ([],)], "s array<string>")
    got = [r["v"] for r in rows.select(E.sentence_scores("s").alias("v")).collect()]
    assert got[0][0] == 0.188476563 and got[1:] == [None, []]


def test_scores_are_held_in_slices(monkeypatch):
    """Against brute force, with copies, skipped rows and matrices of a few rows at a time."""
    rng = np.random.default_rng(1)
    index = K.unit_rows(list(rng.normal(size=(300, 8))))
    index[50:80] = index[7]
    queries, own, other = index[:120], np.arange(120), np.arange(300)
    monkeypatch.setattr(K, "SCORES_AT_ONCE", 5000)
    assert max(s.stop - s.start for s in K.steps(120, 300)) * 300 <= 5000
    for k in (1, 3, 40, 400):
        rows, cols, values = K.best_k_of(queries, index, k, own, other)
        scores = np.round(queries @ index.T, 9)
        scores[own, own] = -np.inf
        want = [(r, c) for r in range(120) for c in sorted(range(300), key=lambda c: (-scores[r, c], c))[: min(k, 300)] if c != r]
        assert list(zip(rows.tolist(), cols.tolist())) == want


def test_bins_cover_cells():
    rng = np.random.default_rng(2)
    sizes, pivots = rng.integers(0, 50, 40), K.unit_rows(list(rng.normal(size=(40, 6))))
    order, bins, heads = K._bins(sizes, pivots, 100)
    assert sorted(order) == list(range(40)) and bins[heads].tolist() == list(range(bins.max() + 1))
    assert all(sizes[order[bins == b]].sum() <= 100 for b in range(bins.max() + 1))


def test_completer_gets_small_frames(spark):
    from noviscan.udfs import PROMPTS_AT_ONCE, complete

    def provider(batches):
        for batch in batches:
            yield batch.assign(reply=str(len(batch)), error=None, input_tokens=1, output_tokens=1)

    got = complete(spark.range(1000).coalesce(1), provider).collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and max(int(r["reply"]) for r in got) == PROMPTS_AT_ONCE


def test_relevance_flags_are_made_once(spark):
    from noviscan.catalog.text import keep_relevant

    plan = keep_relevant(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "text#" not in plan


def test_prose_words_at_the_edges(spark):
    texts = ["www.. abc", "(word) ab", "a b c d", "x1 ab1 abcd12", "https://x.y été 中文", "...", "www.a", "é1 éa1 😀😀"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", R.prose_ratio(F.col("t")).alias("p")).orderBy("k").collect()
    assert [round(r.p, 6) for r in got] == [0.5, 1.0, 0.0, 0.666667, 0.666667, 0.0, 0.0, 0.333333]


def test_queries_of_one_split_are_dealt_out(spark, monkeypatch):
    """a file of one row group is one task, which then made all scores."""
    monkeypatch.setattr(K, "DEALT_FROM", 10, raising=False)
    e = table(spark, SF, "embeddings").filter("vec_id < 200").coalesce(1)
    q, x = e.selectExpr("vec_id AS query_id", "embedding AS qv"), e.selectExpr("vec_id AS chunk_id", "embedding AS xv")
    near = K._broadcast_pairs(q, x, 3, K._result_schema(e, e, "vec_id", "vec_id"), False)
    assert near.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_close_scores_are_ranked_in_double_precision(monkeypatch):
    """neighbours that single precision cannot tell apart, over tiles of the index."""
    monkeypatch.setattr(K, "INDEX_AT_ONCE", 7)
    queries = K.unit_rows([[1.0, 0.0], [0.0, 1.0]])
    index = K.unit_rows([[1.0, 0.2 - i * 1e-8] for i in range(30)])
    rows, cols, values = K.best_k_of(queries, index, 3)
    assert list(zip(rows.tolist(), cols.tolist())) == [(0, 29), (0, 28), (0, 27), (1, 0), (1, 1), (1, 2)]
    assert values.tolist() == np.round((queries @ index.T)[rows, cols], 9).tolist()


def test_source_analysis_matches_once(spark, monkeypatch):
    """verdicts, segments and overlaps read one set of matches."""
    from noviscan.catalog import QUERIES

    calls, real = [], K.top_k
    monkeypatch.setattr(K, "top_k", lambda *args, **named: calls.append(1) or real(*args, **named))
    assert QUERIES["agg3_source_analysis"](spark, SF).count() > 0 and len(calls) == 1


@pytest.mark.parametrize("name", ["agg6_text_analysis_against_benchmark", "snk1_full_index_build"])
def test_chunks_are_made_once(spark, name):
    """F16, F20: the rows that are read several times are stored chunks; no plan makes them again."""
    from noviscan.catalog import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "posexplode" not in plan


def test_a_long_document_carries_no_text_through_the_fold(spark):
    """F16, F20: 20 000 sentences in one unit; the fold copied all chunks so far at every sentence."""
    import time

    df = spark.createDataFrame([("Some words of a sentence. " * 20000,)], "t string")
    began = time.time()
    assert df.select(F.size(C.chunks(F.col("t"), 1000, 150))).first()[0] > 500
    assert time.time() - began < 60
