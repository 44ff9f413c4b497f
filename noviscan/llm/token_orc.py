"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids, stripe-parallel reads.

Documents are dealt out in ranges of doc_id and sorted within them, so files, stripes and row groups hold
disjoint id ranges: the row index prunes ranges and the Bloom filter prunes single ids. Each file also knows
how many ids stand before each of its documents; the totals of the files (one row each) give the rest.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, scratch, slices, table, text_of, written
from noviscan.llm.bpe_ids import byte_marks
from noviscan.operators.ordering import prefix_sums

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BYTES_PER_FILE = 32 << 20
#: Offsets of so many files (16 bytes each) are broadcast; beyond, they are joined.
BROADCAST_FILES = 1_000_000
#: White space as the tokenizer understands it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "10000", "orc.stripe.size": str(32 << 20), "compression": "zstd",
}


class Words:
    """Ids of whole texts, as bytes, by a ``tokenizers`` file whose tokens mark the end of a word.

    Texts of characters below U+0250 are lower-cased, cut into the matches of the tokenizer's pattern, each closed
    by a zero byte, and merged by the file's merges as ranks: a byte before the zero byte becomes the end-of-word
    form of that byte, which comes before every merge as in the file's own model. Texts with other characters, a
    zero byte, the name of an added token, or a character whose lower case is none of these go to the library.
    """

    def __init__(self, tokenizer, name: str = TOKENIZER):
        self.tokenizer = tokenizer
        self.fast, self.ids = merges_as_ranks(name)
        below = [chr(c) for c in range(1, 0x250)]
        self.usual = re.compile(any_of(c for c in below if len(c.lower()) == 1 and c.lower() < "\u0250") + "*+").fullmatch
        letters, digits = (any_of(c for c in below if unicodedata.category(c)[0] == kind) for kind in "LN")
        white = f"[{WHITE}]"
        other = f"[^{white[1:-1]}{letters[1:-1]}{digits[1:-1]}]"
        # Fixed value: what the pattern of the tokenizer file matches.
        self.matches = re.compile(f"{letters}++|(?!'(?:[stmd]|re|ve|ll)){other}++|{digits}|'(?:[stmd]|re|ve|ll)").findall
        self.names = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)").search

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if not self.usual(text) or self.names(text):
                rest.append(k)
            elif found := self.matches(text.lower()):
                out[k] = self.ids[self.fast.encode_ordinary("\0".join(found) + "\0")].tobytes()
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(found.ids, "<i4").tobytes()
        return out


def any_of(characters) -> str:
    """A character class of these characters, in ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


@functools.cache
def merges_as_ranks(name: str):
    """Encoder of words each closed by a zero byte, and the file's id of each of its ranks."""
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    own, suffix = {chr(c): b for b, c in byte_marks().items()}, model["end_of_word_suffix"]

    def plain(token: str) -> bytes:
        closed = token.endswith(suffix)
        return bytes(own[c] for c in (token[: -len(suffix)] if closed else token)) + b"\0" * closed

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(1, 256)}
    for k, (left, right) in enumerate(model["merges"]):
        ranks.setdefault(plain(left + right), 512 + k)
    ids = np.zeros(max(ranks.values()) + 1, "<i4")
    for token, k in model["vocab"].items():
        if (rank := ranks.get(plain(token))) is not None:
            ids[rank] = k
    return tiktoken.Encoding("closed-words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}), ids


@functools.cache
def words_of(tokenizer: str) -> Words:
    """One for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(public_tokenizers.path(tokenizer)), tokenizer)


def tokenize(batches, tokenizer: str = TOKENIZER, end_id: int = END_ID):
    """Slices of (doc_id, text) batches, each with the ids of its texts (closed by ``end_id``) as an Arrow list."""
    words, end = words_of(tokenizer), np.array([end_id], "<i4").tobytes()
    for batch in slices(batches):
        coded = [ids + end for ids in words.encode(batch.column("text").to_pylist())]
        ends = np.cumsum([0, *[len(x) // 4 for x in coded]])
        flat = np.frombuffer(b"".join(coded), "<i4")
        yield batch, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def write_token_files(df: DataFrame, path: str, files: int, text: str = "text") -> None:
    """Tokenized ``df`` (doc_id, text) as ORC below ``path``, rows in ascending doc_id order.

    Columns of the files: ``file`` (their order), ``doc_id``, ``start_in_file``, ``n_tokens``, ``ids``. A null
    doc_id comes first; rows that repeat an id are ordered by their text, so equal rows are neighbours. A
    null or empty text is the end id alone. Other columns are not written.
    """
    dealt = (
        df.select(F.col("doc_id").cast("long"), text_of(f"`{text}`").alias("text"))
        .repartitionByRange(files, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def place(batches):
        before = 0
        for batch, ids in tokenize(batches):
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ends - sizes), pa.array(sizes), ids],
                ["doc_id", "start_in_file", "n_tokens", "ids"],
            )
            before = int(ends[-1])

    placed = dealt.mapInArrow(place, "doc_id long, start_in_file long, n_tokens long, ids array<int>")
    placed.select(F.spark_partition_id().alias("file"), "*").write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents with ``ids`` and ``start``, the number of ids of all documents before; split by stripes.

    The totals are one row per file, a written table whose running sums are made in blocks of files.
    """
    schema = "file int, doc_id long, start_in_file long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).orc(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("all", F.lit(0))
    offsets = written(prefix_sums(totals, ["all"], "file", {"offset": "total"}).select("file", "offset"), "token-offsets")
    few = offsets.count() <= BROADCAST_FILES
    return rows.join(F.broadcast(offsets) if few else offsets, "file").select(
        "doc_id", (F.col("offset") + F.col("start_in_file")).alias("start"), "n_tokens", "ids"
    )


def ids_crc(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])

    return rows.mapInArrow(run, rows.drop("ids").schema.add("ids_crc32", "long"))


def file_count(docs: DataFrame, text: str = "text") -> int:
    """Files of about ``BYTES_PER_FILE`` of text, and no fewer than there are cores."""
    size = docs.agg(F.sum(F.octet_length(text_of(f"`{text}`")))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, 1 + size // BYTES_PER_FILE)


@query("op9_token_orc")
def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "token-orc")
    write_token_files(docs, path, file_count(docs))
    return ids_crc(read_token_files(spark, path))
