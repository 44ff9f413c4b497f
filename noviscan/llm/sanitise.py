"""Personal data and the terms that give it away.

Base spans (e-mail, IP, card and phone numbers) are the protected entities. From the corpus, the pointwise
mutual information of a term and an entity tells how much of the entity's information content the term
reveals: PMI(t, e) / IC(e), 1 where the term occurs with the entity only. All counts are numbers of distinct
texts, and a term occurs with an entity where a text holds both, however far apart. In the documents that hold
the entity, terms above one threshold are generalised and those above a second are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, sieve, sifted, slices, table, text_of, written

#: A term must occur with an entity in so many distinct texts.
LEAST_CONTEXTS = 2
GENERALISE_FROM = 0.6
REMOVE_FROM = 0.9
KEPT_WORDS = 300_000

#: Base patterns, fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass their check, by kind and start."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in short_parts(m[0]))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def short_parts(address: str) -> list[str]:
    """The four numbers without leading zeros; one too long to be an address stays too large."""
    return [p.lstrip("0")[:4] or "0" for p in address.split(".")]


def term_hash(term: str) -> int:
    """As Spark's ``xxhash64`` of the string."""
    return int(np.uint64(xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), seed=42)).astype(np.int64))


def terms_in(text: str) -> set[str]:
    return {w.lower() for w in set(TERM.findall(text))}


def find_entities(docs: DataFrame) -> DataFrame:
    """Every document with its base spans and the hash of its text; text and terms go on only where there are some."""
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
        "entities array<string>, terms array<string>, key long, text string"
    )
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "terms", "key", "text"]
    types = [*[pa.int64()] * 5, pa.string(), *[pa.list_(pa.string())] * 2, pa.int64(), pa.string()]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text, key in zip(*[c.to_pylist() for c in batch.columns]):
                spans = base_spans(text)
                counts = Counter(kind for kind, _, _ in spans)
                base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                entities = sorted({f"{k}:{text[a:b].lower()}" for k, a, b in spans})
                terms, kept = (sorted(terms_in(text)), text) if spans else ([], None)
                rows.append((doc_id, *[counts[k] for k in KINDS], base, entities, terms, key, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias("key")).mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, df): in how many distinct texts each of ``terms`` occurs; ``copied`` has the keys of repeated texts.

    Tasks count the terms that pass a sieve of fixed size, so a few others are among the rows; the join that
    uses the counts drops them. A task sends its counts when they are many, and at its end. What may be a copy
    is sent by text and term, which leaves one row of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sieve(terms.select(F.xxhash64("term").alias("key"))), sieve(copied)))

    def count(batches):
        known: dict[str, bool] = {}
        found: Counter[str] = Counter()
        wanted, repeated = shared.value

        def rows(copies, terms, numbers):
            columns = zip((copies, terms, numbers), (pa.int64(), pa.string(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["copy", "term", "n"])

        for batch in slices(batches):
            texts = [set(TERM.findall(text)) for text in batch.column(0).to_pylist()]
            new = list({w for words in texts for w in words if w not in known})
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list({w for words in texts for w in words})
            hashes = np.array([term_hash(w.lower()) for w in new], np.int64)
            known.update(zip(new, sifted(wanted, hashes).tolist() if new else ()))
            keys, copies = batch.column(1).to_numpy(), []
            for words, key, may_repeat in zip(texts, keys.tolist(), sifted(repeated, keys).tolist()):
                held = {w.lower() for w in words if known[w]}
                if may_repeat:
                    copies += [(key, w) for w in held]
                else:
                    found.update(held)
            if copies:
                yield rows(*zip(*copies), [1] * len(copies))
            if len(found) > KEPT_WORDS:
                yield rows([None] * len(found), list(found), list(found.values()))
                found.clear()
        yield rows([None] * len(found), list(found), list(found.values()))

    per_task = docs.select(text_of().alias("text"), F.xxhash64(text_of()).alias("key")).mapInArrow(count, "copy long, term string, n long")
    per_text = per_task.groupBy("copy", "term").agg(F.sum("n").alias("n"))
    return per_text.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("df"))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share): terms that reveal at least ``GENERALISE_FROM`` of an entity's information.

    N, n_e, n_te and df count distinct texts, so copies of a document are no evidence, for or against; a term
    needs ``LEAST_CONTEXTS`` texts with the entity. Words inside an entity count like any other.

    Before all texts are counted, df among the texts that hold entities rules pairs out: it is at most the
    whole df, and the share falls with df.
    """
    per_text = written(found.groupBy("key").agg(F.count("*").alias("copies")), "texts")
    total = float(max(per_text.count(), 2))
    near = written(found.filter("text is not null").select("key", "entities", "terms").dropDuplicates(["key"]), "contexts")
    held = near.select("key", F.explode("entities").alias("entity"))
    counts = held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= LEAST_CONTEXTS)
    counts = written(counts, "entities-repeated")
    held = held.join(counts, "entity").groupBy("key").agg(F.collect_list("entity").alias("entities"))
    pairs = near.select("key", "terms").join(held, "key").select(F.explode("entities").alias("entity"), "terms")
    pairs = pairs.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = pairs.filter(F.col("n_te") >= LEAST_CONTEXTS).join(counts, "entity")
    info = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.greatest("df", "n_te") * F.col("n_e")))
    share = F.when(info > 0, pmi / info).otherwise(0.0)
    among = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    pairs = written(pairs.join(among, "term").filter(share >= GENERALISE_FROM).drop("df"), "term-pairs")
    copied = per_text.filter("copies > 1").select("key")
    counted = pairs.join(document_frequencies(docs, pairs.select("term").distinct(), copied), "term")
    return counted.select("entity", "term", share.alias("share")).filter(F.col("share") >= GENERALISE_FROM)


def replace_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans and generalised terms replaced by their kind and removed terms left out."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "removed" else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """One row per document row (doc_id, text): counts and base spans, all spans, and the sanitised text.

    Spans are ``kind:start:end`` in code points, end exclusive; kinds email, ip, card, phone, then
    ``generalised`` and ``removed`` of the method. Base spans are always kept. A null text is empty and
    has none. Repeated rows are treated each. ``sanitised`` is null where nothing was found, as the text
    then stays as it is; texts without entities are never shuffled.
    """
    found = written(find_entities(docs), "entities").withColumn("row", F.monotonically_increasing_id())
    found = written(found, "entities-numbered")
    holders = found.filter("text is not null")
    revealing = written(disclosures(docs, found), "disclosures")
    held = holders.select("row", F.explode("entities").alias("entity"))
    terms = held.join(revealing, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))
    terms = terms.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    joined = holders.drop("terms").join(terms, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "terms", "text")

    def run(batches):
        for batch in slices(batches):
            spans, cleaned = [], []
            for base, terms, text in zip(*[c.to_pylist() for c in batch.columns[-3:]]):
                share = {t["term"]: t["share"] for t in terms or ()}
                own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))]
                more = []
                for m in TERM.finditer(text) if share else ():
                    if m[0].lower() in share and not any(a < m.end() and m.start() < b for _, a, b in own):
                        more.append(("removed" if share[m[0].lower()] >= REMOVE_FROM else "generalised", *m.span()))
                more.sort()
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in own + more))
                cleaned.append(replace_spans(text, own + more))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(spans, pa.string()), pa.array(cleaned, pa.string())],
                [*batch.schema.names[:6], "spans", "sanitised"],
            )

    fields = joined.drop("terms", "text").schema.add("spans", "string").add("sanitised", "string")
    rest = found.filter("text is null").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.col("base").alias("spans"), F.lit(None).cast("string").alias("sanitised")
    )
    return joined.mapInArrow(run, fields).unionByName(rest)


@query("op2_sanitise")
def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
