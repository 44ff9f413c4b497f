"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit one binary classifier over hashed letter n-grams
tells the languages with +1 from those with -1; its margin is the mean log-odds per n-gram. A text gets the
language whose codeword has the least logistic loss against the margins; where the second is almost as
near, the answer is flagged as ambiguous.

The counts behind the classifiers cover all training rows: a task counts its rows with numpy and sends one
vector per language; their sum is one row per language and bucket, bounded by ``max_languages`` x ``2^buckets_log2``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, slices, table, text_of

BUCKETS_LOG2 = 15
MAX_LANGUAGES = 512
MARGIN_SCALE = 12.0
AMBIGUOUS_GAP = 0.02
UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +-1: all splits for few languages, seeded random splits of 12 log2(n) bits for many."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.vstack([np.ones(len(splits)), *[1 - 2.0 * ((splits >> k) & 1) for k in range(n - 1)]])
    seed, bits = np.random.default_rng(7), 12 * int(np.ceil(np.log2(n)))
    code = np.where(seed.random((n, bits)) < 0.5, 1.0, -1.0)
    code[0, (code == code[0]).all(axis=0)] *= -1  # no classifier with one side only
    return code


def gram_buckets(text: str, bits: int) -> np.ndarray:
    """Buckets of the letter 1-, 2- and 3-grams of a text; runs of other characters count as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = points >= 128
    letter |= (points >= 97) & (points <= 122)
    # white space and punctuation above ASCII is rare; it counts as letters and so has n-grams of its own
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    grams = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    if not letter.any():
        return np.empty(0, np.int64)
    two = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + grams[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + grams[2:] * np.uint64(0x27D4EB2F165667C5)
    one = grams[grams != 32] * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([one, two, three]) >> np.uint64(64 - bits)).astype(np.int64)


def class_counts(training: DataFrame, bits: int) -> DataFrame:
    """Occurrences per (lang, bucket) over all rows of ``training`` (text, lang)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                found += np.bincount(gram_buckets(text, bits), minlength=1 << bits)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"]
            )

    per_task = training.select(text_of().alias("text"), "lang").mapInArrow(count, "lang string, bucket long, n long")
    return per_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their codewords and the weights of the binary classifiers."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bits: int):
        self.languages, self.code, self.weights, self.bits = languages, code, weights, bits

    @classmethod
    def fit(cls, training: DataFrame, bits: int = BUCKETS_LOG2, max_languages: int = MAX_LANGUAGES) -> Model:
        """From the (text, lang) rows of ``training``; rows without lang teach nothing."""
        training = training.filter(F.col("lang").isNotNull())
        rows = class_counts(training, bits)
        found: dict[str, np.ndarray] = {}
        for row in rows.toLocalIterator():  # at most max_languages x 2^bits rows
            if row.lang not in found and len(found) == max_languages:
                raise ValueError(f"more than {max_languages} languages")
            found.setdefault(row.lang, np.zeros(1 << bits))[row.bucket] = row.n
        languages = sorted(found)
        if not languages:
            return cls([], np.ones((0, 1)), np.zeros((1 << bits, 1)), bits)
        share = np.vstack([(found[x] + 0.05) / (found[x] + 0.05).sum() for x in languages])
        code = codewords(len(languages))
        weights = np.empty((1 << bits, code.shape[1]))
        for bit in range(code.shape[1]):
            yes, no = share[code[:, bit] > 0], share[code[:, bit] < 0]
            weights[:, bit] = np.log(yes.mean(axis=0) / no.mean(axis=0)) if len(yes) and len(no) else 0.0
        return cls(languages, code, weights, bits)

    def decode(self, text: str) -> tuple[str, float, float]:
        """Language, its probability among the codewords, and the gap to the second."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        buckets = gram_buckets(text, self.bits)
        if not len(buckets):
            return UNDETERMINED, 0.0, 0.0
        margins = MARGIN_SCALE * self.weights[buckets].mean(axis=0)
        # each bit counts by how sure its classifier is, so weak classifiers cannot outvote strong ones
        trust = np.abs(margins) / max(np.abs(margins).sum(), 1e-9)
        loss = (np.logaddexp(0.0, -self.code * margins) * trust).sum(axis=1) * len(margins) ** 0.5
        odds = np.exp(-(loss - loss.min()))
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        best = float(odds[order[0]])
        return self.languages[order[0]], best, best - (float(odds[order[1]]) if len(odds) > 1 else 0.0)


def identify(df: DataFrame, model: Model, text: str = "text", ambiguous_gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; a narrow step inside the scan.

    ``und`` with score 0 where the text is null, empty or has no letter, or where nothing was learned.
    Input columns called like a result are replaced. Equal texts get equal answers; ties go to the first
    language by name.
    """
    names = ("lang_pred", "score", "ambiguous")
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], text_of(f"`{text}`").alias("__text"))

    def run(batches):
        for batch in slices(batches):
            found = [model.decode(value) for value in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [
                pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] < ambiguous_gap for x in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *names])

    fields = source.drop("__text").schema
    return source.mapInArrow(run, fields.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return Model.fit(docs.filter(~held_out()).select("text", "lang"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents whose language is determined and not ambiguous go on, with their own columns."""
    found = identify(docs, fit_documents(docs))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select(*docs.columns)
