"""Cross-tokenizer alignment and best-fit packing against plain versions that call the libraries on whole texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from noviscan.llm import best_fit, token_alignment
from noviscan.llm.bpe_ids import ByteBpe

DOCS = "doc_id long, text string, lang string, `row` long, a binary, ids string, piece int, bucket long"
ODD = [
    None, "", " ", "x", "a  b", " lead", "trail ", "tab\tand\nline", "é漢😀" * 3, "▁mark", "a▁b", "<s> </s> <unk> <0x0A> <|endoftext|>",
    "naïve ﬁ ½   　 ​", "word " * 9_000, "-" * 40_000, " " * 5_000 + "x", "aaaa" * 3_000, "same text", "same text", "\x00\x07", "'s 're don't",
    "0123456789" * 500, "éàü" * 2_000,
]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "l", 5, b"z", "clash", 3, 4) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts(spark):
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    return [*given, *ODD]


# ---- ids


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sta.,19éß漢 　́"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(byte_bpe, text):
    own = ids_of(True)
    byte_bpe.encode_special_tokens = True
    assert own.encode([text])[0] == byte_bpe.encode(text, add_special_tokens=False).ids


def ids_of(names_are_text, kept={}):  # noqa: B006
    if names_are_text not in kept:
        kept[names_are_text] = ByteBpe("byte_bpe_50k.json", names_are_text)
    return kept[names_are_text]


# ---- alignment


def groups_of(text, byte_bpe, pieces):
    """Groups of (A ids, B ids) by walking both token lists."""
    if not text:
        return []
    byte_bpe.encode_special_tokens = True
    own = {chr(c): b for b, c in marks()}
    a = byte_bpe.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(own[c] for c in t) for t in a.tokens]
    b = pieces.encode(text)
    b_bytes = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(pieces.id_to_piece, b))]
    want = (" " + text).encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return []
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a.ids) or j < len(b):
        if at_a <= at_b and i < len(a.ids):
            left.append(a.ids[i])
            at_a += len(a_bytes[i])
            i += 1
        else:
            right.append(b[j])
            at_b += len(b_bytes[j])
            j += 1
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    return out


def marks():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [(b, b) for b in shown] + [(b, 256 + n) for n, b in enumerate(rest)]


def brute_alignment(texts, byte_bpe, pieces):
    groups = [groups_of(t, byte_bpe, pieces) for t in texts]
    links = [collections.Counter((a, b) for own_a, own_b in own for a in own_a for b in own_b) for own in groups]
    held = collections.Counter(pair for own in links for pair in own)
    best = collections.defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for own, pairs in zip(groups, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        out.append((
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(pairs.values()),
            sum(n for (a, b), n in pairs.items() if held[a, b] == best[a]), sum(n * held[p] for p, n in pairs.items()),
            hashlib.sha256(shown.encode()).hexdigest() if own else "",
        ))
    return out


def digested(row):
    return (*row[1:7], hashlib.sha256(row.groups.encode()).hexdigest() if row.groups else "")


def test_query_of_alignment(spark, byte_bpe, pieces):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_alignment([r.text for r in given], byte_bpe, pieces)
    got = token_alignment.op12_token_alignment(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {r.doc_id: w for r, w in zip(given, want)}


def test_few_words_are_kept(spark, byte_bpe, pieces, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 3)
    texts = [f"w{k} and w{k + 1}  \n w{k}\t" for k in range(40)] + ["x " * 30]
    monkeypatch.setattr("noviscan.llm.token_alignment.sized_slices", lambda batches, column: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    got = token_alignment.aligned_documents(docs_of(spark, texts).repartition(2))
    assert {r[0]: digested(r) for r in got.collect()} == dict(enumerate(brute_alignment(texts, byte_bpe, pieces)))


def test_alignment_equals_brute_force(spark, texts, byte_bpe, pieces):
    got = token_alignment.aligned_documents(docs_of(spark, texts).repartition(5))
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in got.columns[1:7]], ("groups", "string")]
    want = brute_alignment(texts, byte_bpe, pieces)
    assert {r[0]: digested(r) for r in got.collect()} == dict(enumerate(want))
    assert sum(w[6] == "" for w in want) >= 4 and max(w[0] * w[1] for w in want) > 10**7


def test_alignment_in_several_passes_and_blocks(spark, byte_bpe, pieces, monkeypatch):
    monkeypatch.setattr(token_alignment, "LINKS_PER_BLOCK", 50)
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 6)
    monkeypatch.setattr(token_alignment, "PENDING", 100)
    texts = ["the cat and the naïve dog", "漢字 and 漢字", "-" * 300, "the cat", None, "xqzt " * 40, "the cat"]
    docs = docs_of(spark, texts, [1, 1, 2, None, 3, 4, 4]).repartition(3)
    want = sorted(zip([1, 1, 2, None, 3, 4, 4], brute_alignment(texts, byte_bpe, pieces)), key=str)
    got = token_alignment.aligned_documents(docs, pairs_per_pass=60)
    assert sorted(((r[0], digested(r)) for r in got.collect()), key=str) == want


def test_alignment_of_nothing(spark):
    assert token_alignment.aligned_documents(docs_of(spark, [])).collect() == []
    assert [tuple(r) for r in token_alignment.aligned_documents(docs_of(spark, [None, ""])).collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (0, 1)]


@given(st.sets(st.integers(0, 2**32 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.int64)
    found = token_alignment.PerfectHash.of(keys)
    again = token_alignment.PerfectHash.unpacked(found.sizes, found.packed())
    assert sorted(again.number(keys).tolist()) == list(range(len(keys))) and sum(found.sizes) <= 8 * len(keys) + 64


# ---- packing


def check_packing(rows, ids_of_doc, capacity):
    """Rows (key, piece, start, length, crc, sequence, offset) hold every document whole and no sequence overflows."""
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for key, piece, start, length, crc, sequence, offset in rows:
        ids = ids_of_doc[key][start : start + length]
        assert length == len(ids) > 0 and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[key].append((piece, start, length))
        bins[sequence].append((offset, length))
    for key, ids in ids_of_doc.items():
        own = sorted(pieces[key])
        assert [p for p, _, _ in own] == list(range(-(-len(ids) // capacity)))
        assert all(n == capacity for _, _, n in own[1:]) and [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_and_tight(spark, texts, byte_bpe):
    byte_bpe.encode_special_tokens = False
    ids = {k: [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    got = best_fit.packed(docs_of(spark, texts).repartition(2), capacity=1024)
    assert got.columns == ["doc_id", "lang", "row", "a", "bucket", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = got.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()
    used = check_packing([tuple(r) for r in rows], ids, 1024)
    assert used <= 1.03 * sum(map(len, ids.values())) / 1024 + 2
    whole = {r.sequence_id: r for r in best_fit.sequences(got).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(map(len, ids.values()))
    assert all(len(r.ids) == 4 * r.n_tokens == 4 * sum(r.lengths) for r in whole.values())


def test_query_of_packing(spark, byte_bpe):
    byte_bpe.encode_special_tokens = False
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*byte_bpe.encode(r.text or "", add_special_tokens=False).ids, 2] for r in given}
    got = best_fit.op13_best_fit(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "int", *["bigint"] * 5]
    assert check_packing([tuple(r) for r in got.collect()], ids, 1024) <= 1.02 * sum(map(len, ids.values())) / 1024 + 2


def test_small_windows_and_few_open_sequences(spark, byte_bpe):
    texts = ["word " * n for n in (3, 9, 1, 16, 17, 31, 33, 5, 5, 5, 70, 2)]
    byte_bpe.encode_special_tokens = False
    ids = {k: [*byte_bpe.encode(t, add_special_tokens=False).ids, 7] for k, t in enumerate(texts)}
    got = best_fit.packed(docs_of(spark, texts), capacity=16, most_open=2, window=3, end_id=7)
    rows = got.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()
    check_packing([tuple(r) for r in rows], ids, 16)
    assert best_fit.packed(docs_of(spark, [])).collect() == []


def test_best_fit_rule():
    """Against a list of open bins: least room that fits, and of one bin too many the fullest closes."""
    rng = random.Random(5)
    for most in (1, 3, 50):
        bins, open_bins, number = best_fit.OpenSequences(100, most), {}, 0
        for _ in range(3000):
            n = rng.randint(1, 100)
            sequence, offset = bins.place(n)
            free = min((f for f in open_bins.values() if f >= n), default=100)
            assert offset == 100 - free
            if free < 100:
                assert open_bins.pop(sequence) == free
            else:
                assert sequence == number
                number += 1
            if free > n:
                open_bins[sequence] = free - n
            if len(open_bins) > most:
                least = min(open_bins.values())
                closed = [s for s, f in open_bins.items() if f == least and s not in bins.open[f]]
                assert len(closed) == 1
                del open_bins[closed[0]]
            assert bins.count == len(open_bins)
