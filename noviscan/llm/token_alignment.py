"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs under minimal perfect hashes.

First pass: documents are encoded by both tokenizers, cut into groups where tokens of both end at the same byte,
and each task counts the documents per linked id pair. The distinct pairs are dealt out over buckets by hash;
each bucket gets a minimal perfect hash (levels of bits: a key stands on the first level where no other key of
its bucket has its slot, and its rank among all set bits is its number). The counts of the tasks become dense
vectors indexed by it, which are added up in a tree. Second pass: the documents are aligned anew, and each link's
count is looked up and verified by the key stored at its number.

No group spans a space between two characters that are no white space: the byte-level pattern begins a match
there, and no piece of the other model has a space behind another character. So texts are cut at these spaces,
and a task encodes and aligns each distinct word once.

The pairs' table is broadcast up to ``PAIRS_PER_PASS`` pairs. Beyond, buckets are taken in groups of that size and
each group is one more pass; the sums of a document are added up over the passes.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, slices, table, text_of, written
from noviscan.llm.bpe_ids import ByteBpe, flat, sized_slices

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Fits the pieces' ids; a pair is one number below 2^32.
B_IDS = 1 << 15
BUCKETS = 64
LEVELS = 48
LOAD = 2.0
#: Pairs that a task counts before it merges equal ones.
PENDING = 4_000_000
LINKS_PER_BLOCK = 4_000_000
WIDE_GROUP = 1 << 14
PAIRS_PER_PASS = 16_000_000
#: Words, and characters of words, that a task keeps aligned.
KEPT_WORDS = 500_000
KEPT_CHARS = 16 << 20
#: Longer words are encoded by themselves.
PLAIN_CHARS = 200
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# ---- tokens and groups


class Pieces:
    """Ids and bytes of a sentencepiece model that puts a space before each text."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.bytes_of = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes_of.append(b"" if self.model.is_control(k) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligned:
    """The groups of documents (or words): ids of both sides, the group of each token, and the document of each group."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray):
        self.documents = len(a_ends) - 1
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_bytes[self.a]), np.cumsum(b_bytes[self.b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        self.in_a, self.in_b = (np.bincount(x, minlength=len(shared)) for x in (self.group_a, self.group_b))
        self.n_a, self.n_b = np.diff(a_ends), np.diff(b_ends)
        first = np.cumsum(self.in_a) - self.in_a  # the first token of each group tells its document
        self.document = np.searchsorted(np.cumsum(self.n_a), first, side="right")

    def per_document(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.documents, np.int64)
        np.add.at(out, self.document, values)
        return out

    def links(self):
        """Blocks (document, pair, times) of the links: each A token of a group with each B token of it.

        Equal pairs of a wide group are counted before they are listed, so a block stays small.
        """
        size = self.in_a * self.in_b
        wide = size > WIDE_GROUP
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        narrow = np.flatnonzero(~wide & (size > 0))
        block = np.cumsum(size[narrow]) // LINKS_PER_BLOCK
        for cut in np.split(narrow, np.flatnonzero(np.diff(block)) + 1):
            n = size[cut]
            group = np.repeat(cut, n)
            within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.divmod(within, self.in_b[group])
            yield self.document[group], self.a[start_a[group] + i] * B_IDS + self.b[start_b[group] + j], np.ones(len(group), np.int64)
        for g in np.flatnonzero(wide).tolist():
            own_a, times_a = np.unique(self.a[start_a[g] : start_a[g] + self.in_a[g]], return_counts=True)
            own_b, times_b = np.unique(self.b[start_b[g] : start_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, LINKS_PER_BLOCK // len(own_b))
            for at in range(0, len(own_a), step):
                pairs = (own_a[at : at + step, None] * B_IDS + own_b).ravel()
                yield np.full(len(pairs), self.document[g]), pairs, (times_a[at : at + step, None] * times_b).ravel()

    def written_out(self) -> list[bytes]:
        """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
        groups_a, groups_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        at_a = np.arange(len(self.a)) + (groups_b - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + groups_a[self.group_b]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[groups_a + groups_b - self.in_b - 1], marks[groups_a + groups_b - 1] = ord("|"), ord(";")
        digits = 1 + (ids[:, None] >= 10 ** np.arange(1, 5)).sum(axis=1)
        shown = np.zeros((len(ids), 6), np.uint8)
        for k in range(5):
            rest = digits - 1 - k
            shown[:, k] = np.where(rest >= 0, ids // 10 ** np.maximum(rest, 0) % 10 + ord("0"), 0)
        shown[np.arange(len(ids)), digits] = marks
        text = shown[np.arange(6) <= digits[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(digits + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [text[x : y - 1] if y > x else b"" for x, y in zip(ends, ends[1:])]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def without(ids: np.ndarray, ends: np.ndarray, void: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists after those that are void became empty."""
    n = np.diff(ends)
    return ids[np.repeat(~void, n)], np.cumsum([0, *np.where(void, 0, n)])


class Words:
    """Distinct words of the texts of a task, numbered as they come, and what ``keep`` makes of their alignment.

    A text is its words joined by single spaces. Where too many are held, all are forgotten.
    """

    CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])").split
    #: Words that both ways of encoding take alike, and that may stand after one another in one text.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ɏ](?:[\0-ɏ]*[!-~À-ÖØ-öø-ɏ])?").fullmatch

    def __init__(self, byte_bpe: str, pieces: str):
        self.a, self.b = ByteBpe(byte_bpe, names_are_text=True), Pieces(pieces)
        if any("▁" in self.b.model.id_to_piece(k).lstrip("▁") for k in range(self.b.model.get_piece_size())):
            self.CUT = lambda text: [text]  # a piece may span words: texts stay whole
        self.sizes = [np.array([len(x) for x in model.bytes_of]) for model in (self.a, self.b)]
        self.forget()

    def forget(self) -> None:
        self.at, self.chars, self.void = {}, 0, np.zeros(0, bool)

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all words one after another, where each text's end (with a leading 0), and which texts have none.

        Empty texts have no words, nor have those with a word whose tokens of either side do not give the space
        before it and the word, byte by byte.
        """
        words = [self.CUT(text) if text else [] for text in texts]
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(words)) if w not in self.at]
        if self.at and (len(self.at) + len(new) > KEPT_WORDS or self.chars > KEPT_CHARS):
            self.forget()
            new = list(dict.fromkeys(itertools.chain.from_iterable(words)))
        self.learn(new)
        ends = np.cumsum([0, *map(len, words)])
        flat = np.fromiter(map(self.at.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(ends[-1]))
        bad = np.add.reduceat(np.append(self.void[flat], False), ends[:-1])[: len(texts)] > 0 if len(flat) else np.zeros(len(texts), bool)
        bad |= np.diff(ends) == 0
        keep = np.repeat(~bad, np.diff(ends))
        return flat[keep], np.cumsum([0, *np.where(bad, 0, np.diff(ends))]), bad

    def learn(self, new: list[str]) -> None:
        plain = [word for word in new if len(word) <= PLAIN_CHARS and self.PLAIN(word)]
        if len(plain) < len(new):
            others = set(new).difference(plain)
            new = [*plain, *[word for word in new if word in others]]
        (a, a_ends), (b, b_ends) = self.encoded(new, len(plain)), flat(self.b.encode(new))
        want = "".join([f" {word}" for word in new]).encode()
        lengths = np.cumsum([0, *[len(word) if word.isascii() else len(word.encode()) for word in new]]) + np.arange(len(new) + 1)
        void = np.zeros(len(new), bool)
        for ids, ends, model, sizes in ((a, a_ends, self.a, self.sizes[0]), (b, b_ends, self.b, self.sizes[1])):
            given = b"".join(map(model.bytes_of.__getitem__, ids.tolist()))
            if given != want or (np.cumsum(np.append(0, sizes[ids]))[ends] != lengths).any():
                void |= [b"".join(map(model.bytes_of.__getitem__, ids[x:y].tolist())) != f" {w}".encode() for x, y, w in zip(ends, ends[1:], new)]
        if void.any():
            a, a_ends, b, b_ends = *without(a, a_ends, void), *without(b, b_ends, void)
        self.at |= zip(new, range(len(self.at), len(self.at) + len(new)))
        self.chars += sum(map(len, new))
        self.void = np.concatenate([self.void, void])
        self.keep(Aligned(a, a_ends, b, b_ends, *self.sizes))

    def encoded(self, new: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """A ids of a space and each word; the first ``plain`` words are one text, told apart by their bytes."""
        some = new[:plain]
        a = np.array(self.a.fast.encode_ordinary("".join([f" {word}" for word in some])), np.int64)
        at = np.cumsum([1 + (len(word) if word.isascii() else len(word.encode())) for word in some])
        ends = np.append(0, np.searchsorted(np.cumsum(self.sizes[0][a]), at) + 1) if some else np.zeros(1, np.int64)
        rest, rest_ends = flat(self.a.encode([f" {word}" for word in new[plain:]]))
        return np.concatenate([a, rest]), np.concatenate([ends, len(a) + rest_ends[1:]])

    def keep(self, found: Aligned) -> None:
        raise NotImplementedError


class PairsOfWords(Words):
    """The distinct linked pairs of each word."""

    def forget(self) -> None:
        super().forget()
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def keep(self, found: Aligned) -> None:
        own = distinct(np.concatenate([distinct(word << 32 | pair) for word, pair, _ in found.links()]))
        counts = np.bincount(own >> 32, minlength=found.documents)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.pairs = np.concatenate([self.pairs, own & 0xFFFFFFFF])

    def held(self, texts: list[str]) -> np.ndarray:
        """The linked pairs of each text, each once a text."""
        words, ends, _ = self.numbered(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        once = distinct(text << 32 | words)
        text, words = once >> 32, once & 0xFFFFFFFF
        n = self.starts[words + 1] - self.starts[words]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return distinct(np.repeat(text, n) << 32 | self.pairs[np.repeat(self.starts[words], n) + within]) & 0xFFFFFFFF


class SumsOfWords(Words):
    """What each word's alignment and the counts of its links come to."""

    def __init__(self, byte_bpe: str, pieces: str, known: PairTable):
        self.known = known
        super().__init__(byte_bpe, pieces)

    def forget(self) -> None:
        super().forget()
        self.sums, self.groups = np.zeros((0, len(SUMS)), np.int64), []

    def keep(self, found: Aligned) -> None:
        n_best, count_sum = np.zeros(found.documents, np.int64), np.zeros(found.documents, np.int64)
        for word, pair, times in found.links():
            counts = self.known.look_up(pair)
            best = (counts > 0) & (counts == self.known.highest[pair // B_IDS])
            np.add.at(n_best, word, times * best)
            np.add.at(count_sum, word, times * counts)
        n_groups = np.bincount(found.document, minlength=found.documents)
        n_links = found.per_document(found.in_a * found.in_b)
        self.sums = np.concatenate([self.sums, np.stack([found.n_a, found.n_b, n_groups, n_links, n_best, count_sum], axis=1)])
        self.groups += found.written_out()

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        words, ends, _ = self.numbered(texts)
        total = np.concatenate([np.zeros((1, len(SUMS)), np.int64), np.cumsum(self.sums[words], axis=0)])
        flat, at = words.tolist(), ends.tolist()
        return total[ends[1:]] - total[ends[:-1]], [b";".join([self.groups[w] for w in flat[x:y]]).decode() for x, y in zip(at, at[1:])]


# ---- counts under minimal perfect hashes


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, LEVELS) % np.uint64(BUCKETS)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; other keys get any number or -1."""

    def __init__(self, sizes: list[int], flags: np.ndarray):
        self.sizes, self.flags = sizes, flags
        self.starts = np.cumsum([0, *sizes])
        self.rank = np.cumsum(flags, dtype=np.int64) - flags

    @classmethod
    def of(cls, keys: np.ndarray, load: float = LOAD) -> PerfectHash:
        sizes, flags = [], []
        while len(keys):
            if len(sizes) == LEVELS:  # below one in 2^40 for any key after the first levels; then with more room
                return cls.of(keys, 2 * load) if load > 64 else cls.of(np.unique(keys), 2 * load)
            size = max(8, int(load * len(keys)))
            slot = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            keys = keys[~alone[slot]]
        return cls(sizes, np.concatenate(flags) if flags else np.zeros(0, bool))

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            slot = self.starts[level] + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.flags[slot]
            out[left[here]] = self.rank[slot[here]]
            left = left[~here]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.flags).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    together = np.concatenate([*keys, np.zeros(0, np.int64)])
    order = np.argsort(together, kind="stable")
    together, sums = together[order], np.cumsum(np.append(0, np.concatenate([*counts, np.zeros(0, np.int64)])[order]))
    ends = np.flatnonzero(np.append(together[1:] != together[:-1], True)) + 1 if len(together) else np.zeros(0, np.int64)
    return together[ends - 1], np.diff(np.append(0, sums[ends]))


def pair_counts(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """(bucket, salt, keys, counts) of each task over (row, doc_id, text): the documents that hold each linked pair."""
    salts = max(1, int(docs.rdd.getNumPartitions() ** 0.5))

    def run(batches):
        salt = TaskContext.get().partitionId() % salts
        words = PairsOfWords(byte_bpe, pieces)
        keys, counts, waiting = [], [], 0

        def emit():
            own, sums = merged(keys, counts)
            bucket = bucket_of(own)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            rows = [(k, order[ends[k] : ends[k + 1]]) for k in range(BUCKETS) if ends[k + 1] > ends[k]]
            columns = [
                pa.array([k for k, _ in rows], pa.int64()), pa.array([salt] * len(rows), pa.int64()),
                pa.array([own[at].astype("<u4").tobytes() for _, at in rows], pa.binary()),
                pa.array([sums[at].astype("<i8").tobytes() for _, at in rows], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "salt", "keys", "counts"])

        for batch in sized_slices(batches, "text"):
            held = words.held(batch.column("text").to_pylist())
            keys.append(held)
            counts.append(np.ones(len(held), np.int64))
            waiting += len(held)
            if waiting > PENDING:
                own, sums = merged(keys, counts)
                keys, counts, waiting = [own], [sums], 0
                if len(own) > PENDING // 2:
                    yield emit()
                    keys, counts = [], []
        if keys:
            yield emit()

    return docs.select("text").mapInArrow(run, "bucket long, salt long, keys binary, counts binary")


def perfect_hashes(partials: DataFrame) -> DataFrame:
    """(bucket, n, sizes, bits) of a minimal perfect hash of each bucket's distinct pairs, merged in two levels."""

    def distinct(group: pa.Table) -> pa.Table:
        keys = reduce(np.union1d, [np.frombuffer(x, "<u4") for x in group.column("keys").to_pylist()])
        return pa.table({"bucket": group.column("bucket")[:1], "keys": pa.array([keys.astype("<u4").tobytes()], pa.binary())})

    def build(group: pa.Table) -> pa.Table:
        keys = reduce(np.union1d, [np.frombuffer(x, "<u4") for x in group.column("keys").to_pylist()])
        found = PerfectHash.of(keys)
        return pa.table({
            "bucket": group.column("bucket")[:1], "n": pa.array([len(keys)], pa.int64()),
            "sizes": pa.array([found.sizes], pa.list_(pa.int64())), "bits": pa.array([found.packed()], pa.binary()),
        })

    some = partials.select("bucket", "salt", "keys").groupBy("bucket", "salt").applyInArrow(distinct, "bucket long, keys binary")
    return some.groupBy("bucket").applyInArrow(build, "bucket long, n long, sizes array<long>, bits binary")


def dense_counts(partials: DataFrame, hashes: DataFrame) -> DataFrame:
    """(bucket, sizes, bits, keys, counts): the keys and the documents per pair as vectors indexed by the hash.

    A vector holds one bucket, and vectors are added up in two levels: per salt of the tasks, then per bucket.
    """
    salted = partials.join(hashes, "bucket").select("bucket", "salt", "n", "sizes", "bits", "keys", "counts")

    def scatter(group: pa.Table) -> pa.Table:
        found = PerfectHash.unpacked(group.column("sizes")[0].as_py(), group.column("bits")[0].as_py())
        n = group.column("n")[0].as_py()
        own, sums = np.zeros(n, "<u4"), np.zeros(n, "<i8")
        for keys, counts in zip(group.column("keys"), group.column("counts")):
            keys, counts = np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<i8")
            at = found.number(keys)
            own[at] = keys
            sums[at] += counts
        return vectors(group, own, sums)

    def add(group: pa.Table) -> pa.Table:
        own = reduce(np.maximum, [np.frombuffer(x, "<u4") for x in group.column("keys").to_pylist()])
        sums = reduce(np.add, [np.frombuffer(x, "<i8") for x in group.column("counts").to_pylist()])
        return vectors(group, own, sums)

    def vectors(group: pa.Table, own: np.ndarray, sums: np.ndarray) -> pa.Table:
        one = {c: group.column(c)[:1] for c in ("bucket", "sizes", "bits")}
        return pa.table(one | {"keys": pa.array([own.tobytes()], pa.binary()), "counts": pa.array([sums.tobytes()], pa.binary())})

    fields = "bucket long, sizes array<long>, bits binary, keys binary, counts binary"
    return salted.groupBy("bucket", "salt").applyInArrow(scatter, fields).groupBy("bucket").applyInArrow(add, fields)


def highest_counts(counted: DataFrame) -> np.ndarray:
    """Per A id the highest count of its pairs; as long as the vocabulary."""

    def run(batches):
        for batch in slices(batches, 1):
            a = np.frombuffer(batch.column(0)[0].as_buffer(), "<u4") // B_IDS
            counts = np.frombuffer(batch.column(1)[0].as_buffer(), "<i8")
            own, at = np.unique(a, return_inverse=True)
            most = np.zeros(len(own), np.int64)
            np.maximum.at(most, at, counts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(most)], ["a", "most"])

    rows = counted.select("keys", "counts").mapInArrow(run, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    out = np.zeros(1 << 16, np.int64)
    for row in rows.toLocalIterator():  # a row per A id
        out[row.a] = row.most
    return out


class PairTable:
    """Counts of pairs of some buckets, by number under their perfect hashes, each verified by its key."""

    def __init__(self, rows: list, highest: np.ndarray):
        self.highest = highest
        levels = max([len(r.sizes) for r in rows], default=0)
        self.sizes, self.starts = np.zeros((levels, BUCKETS), np.uint64), np.zeros((levels, BUCKETS), np.int64)
        self.here = np.zeros(BUCKETS, bool)
        flags, keys, counts, at = [], [], [], 0
        for r in rows:  # one after another, so a rank among all set bits goes through the buckets' vectors
            self.here[r.bucket] = True
            for level, size in enumerate(r.sizes):
                self.sizes[level, r.bucket], self.starts[level, r.bucket] = size, at
                at += size
            flags.append(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=sum(r.sizes)).astype(bool))
            keys.append(np.frombuffer(r.keys, "<u4"))
            counts.append(np.frombuffer(r.counts, "<i8"))
        self.bits = np.packbits(np.concatenate([*flags, np.zeros(0, bool)]))
        self.keys, self.counts = np.concatenate([*keys, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, "<i8")])
        self.rank = None

    def load(self) -> PairTable:
        if self.rank is None:  # in the task: bits travel packed
            self.flags = np.unpackbits(self.bits).astype(bool)
            self.rank = np.cumsum(self.flags, dtype=np.int64) - self.flags
        return self

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of pairs, 0 for those of other buckets."""
        out, bucket = np.zeros(len(pairs), np.int64), bucket_of(pairs)
        left = np.flatnonzero(self.here[bucket])
        for level in range(len(self.sizes)):
            own, sizes = bucket[left], self.sizes[level]
            slot = self.starts[level][own] + (mixed(pairs[left], level) % np.maximum(sizes[own], np.uint64(1))).astype(np.int64)
            found = self.flags[slot] & (sizes[own] > 0)
            number = self.rank[slot[found]]
            if (self.keys[number] != pairs[left[found]]).any():
                raise ValueError("a linked pair was not counted")
            out[left[found]] = self.counts[number]
            left = left[~found]
            if not len(left):
                break
        if len(left):
            raise ValueError("a linked pair was not counted")
        return out


def link_sums(docs: DataFrame, known: PairTable, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Second pass over (row, doc_id, text): each document's groups and what the counts of its links come to."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        words = SumsOfWords(byte_bpe, pieces, shared.value.load())
        for batch in sized_slices(batches, "text"):
            sums, groups = words.of(batch.column("text").to_pylist())
            columns = [*batch.columns[:2], *[pa.array(c) for c in sums.T], pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *SUMS, "groups"])

    return docs.mapInArrow(run, ", ".join(["row long", "doc_id long", *[f"{c} long" for c in SUMS], "groups string"]))


def aligned_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, pairs_per_pass: int = PAIRS_PER_PASS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of ``docs`` (doc_id, text).

    Groups are the shortest runs of bytes at whose end tokens of both sides end; all A and B tokens of a group are
    linked. ``groups`` lists their ids as ``a1,a2|b1;a3|b2,b3``. A pair's count is the number of rows of ``docs`` that hold
    it linked; ``n_best`` counts the links whose count is the highest of their A id, ties included. Null and empty
    texts have zeros and '', and so have texts whose tokens of either side do not give a space and the text, byte by
    byte. Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    partials = written(pair_counts(rows, byte_bpe, pieces), "pair-counts")
    hashes = written(perfect_hashes(partials), "pair-hashes")
    counted = written(dense_counts(partials, hashes), "dense-counts")
    highest = highest_counts(counted)
    groups, size = [[]], 0
    for bucket, n in sorted(tuple(r) for r in hashes.select("bucket", "n").collect()):  # a row per bucket
        if groups[-1] and size + n > pairs_per_pass:
            groups.append([])
            size = 0
        groups[-1].append(bucket)
        size += n
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(groups) > 1:
        rows = written(rows, "rows")  # several passes know a row by its number
    passes = []
    for own in groups:
        known = list(counted.filter(F.col("bucket").isin(own)).toLocalIterator()) if own else []
        passes.append(link_sums(rows, PairTable(known, highest), byte_bpe, pieces))
    columns = ["doc_id", *SUMS, "groups"]
    if len(passes) == 1:
        return passes[0].select(columns)
    same = [F.first(c).alias(c) for c in columns if c not in ("n_best", "count_sum")]
    added = reduce(DataFrame.unionByName, passes).groupBy("row").agg(*same, *[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    return added.select(columns)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", *SUMS, digest.alias("groups_sha256"))
