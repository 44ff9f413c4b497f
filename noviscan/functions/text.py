"""Text expressions. Everything here is a Column in, Column out: no shuffle, no Python worker.

A document is one row, so per-document work is array work inside that row and scales with the
number of rows; text itself is never exploded across an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when stripping, and line separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
#: A line break with the white space around it.
BROKEN_LINE = r"(?U)[\s\x1c-\x1e]*[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029][\s\x1c-\x1e]*"

# Patterns shared by several text operators.
SENTENCE_BREAK = r"(?U)\s(?<=[.!?]\s)\s*"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
DOT_LEADER = r"\.{4,}|(?:\.[ \t]+){2,}\."
SYMBOL_RUN = "[\u00b7\u2022\u25aa\u25cf\u25e6\u2023\u2219*_~=+#\\-\u2013\u2014]{3,}"
TABLE_LINE = r"(?U)^\|.*\|$|^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"
WORD = "[A-Za-z0-9']+"
LOWER_WORD = "[a-z0-9']+"

# Words without content for frequency scoring.
STOPWORDS = tuple(
    """a an the and or but if then else when at by for with about against between into
    through during before after above below to from up down in out on off over under
    again further once here there all any both each few more most other some such no nor
    not only own same so than too very can will just should now is are was were be been
    being have has had do does did of as it its it's this that these those i you he she
    they we me him her them my your his our their what which who whom whose how why one
    also may might must could would shall them then""".split()
)
ANY_STOPWORD = "^(?:" + "|".join(STOPWORDS) + ")$"
ABBREVIATION_END = r"(?iU)(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\.g|i\.e)|\b[A-Z])\.$"
#: The longest abbreviation with its dot and the character before it fit.
ABBREVIATION_CHARS = 8


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (keeps expression trees small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def split_lines(c: Column) -> Column:
    """Lines without terminators; a final terminator does not open another line."""
    return let(
        F.split(c, LINE_BREAK),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def nonempty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    return nonempty(F.split(c, SENTENCE_BREAK))


def paragraphs(c: Column) -> Column:
    return nonempty(F.split(c, PARAGRAPH_BREAK))


def sentences_keeping_abbreviations(c: Column) -> Column:
    """Sentences; a piece that ends in an abbreviation takes the next piece with it.

    An abbreviation holds no white space, so the last piece of a sentence alone shows whether it ends in one.
    """

    def join(pieces):
        def runs(starts):
            return F.transform(
                starts,
                lambda s, i: F.array_join(F.slice(pieces, s + 1, F.coalesce(F.get(starts, i + 1), F.size(pieces)) - s), " "),
            )

        tail = lambda p: F.substring(p, -ABBREVIATION_CHARS, ABBREVIATION_CHARS)
        ends = F.transform(pieces, lambda p, i: F.when(p.endswith(".") & tail(p).rlike(ABBREVIATION_END), -1).otherwise(i + 1))
        starts = F.filter(F.concat(F.array(F.lit(0)), ends), lambda at: (at >= 0) & (at < F.size(pieces)))
        return let(starts, runs)

    return let(sentences(c), join)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(LOWER_WORD), F.lit(0))


def content_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def word_key(c: Column) -> Column:
    """Sentence identity: lower-case words joined by single blanks."""
    return F.array_join(words(c), " ")


def truncate(c: Column, limit: int | Column) -> Column:
    """Strip and cut to ``limit`` characters, marking the cut with three dots."""
    n = F.lit(limit) if isinstance(limit, int) else limit

    def cut(text):
        short = F.substring(text, F.lit(1), n)
        dotted = F.concat(rstrip(F.substring(text, F.lit(1), n - 3)), F.lit("..."))
        return F.when(F.length(text) <= n, text).when(n <= 3, short).otherwise(dotted)

    return let(strip(c), cut)


def clip_with_mark(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters with a one-character ellipsis."""
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(rstrip(F.substring(c, 1, limit - 1)), F.lit("…"))
    )


def may_have_leader(c: Column) -> Column:
    """Cheap test that texts with a ``DOT_LEADER`` pass."""
    return c.contains("..") | c.contains(". .") | c.contains(".  ") | c.contains(".\t")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_extractive(c: Column) -> Column:
    """Unwrap hard line breaks, drop table rows, dot leaders and symbol runs; keep paragraphs."""

    def tidy(paragraph):
        # A table line holds a bar.
        lines = F.filter(split_lines(paragraph), lambda line: ~(line.contains("|") & strip(line).rlike(TABLE_LINE)))
        prose = F.when(paragraph.contains("|"), F.array_join(lines, "\n")).otherwise(paragraph)
        text = strip(F.regexp_replace(prose, BROKEN_LINE, " "))
        text = let(text, lambda t: F.when(may_have_leader(t), F.regexp_replace(t, DOT_LEADER, " ")).otherwise(t))
        text = F.regexp_replace(text, SYMBOL_RUN, " ")
        return let(text, lambda t: strip(F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]{2,}", " ")).otherwise(t)))

    parts = F.transform(F.split(c, PARAGRAPH_BREAK), tidy)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def hard_pieces(c: Column, limit: int) -> Column:
    """Fixed-width pieces, stripped, empties dropped."""
    return nonempty(F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % limit), F.lit(0)))


def word_pieces(c: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at the last blank in reach when there is one.

    The three alternatives are: the rest fits; longest run followed by a blank; no blank in reach.
    """
    if limit <= 1:
        return hard_pieces(c, 1)
    pattern = "(?s).{1,%d}\\z|.{1,%d}(?= )|.{%d}" % (limit, limit - 1, limit)
    return nonempty(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


# Prefixes and suffixes that do not belong to a title.
TITLE_NUMBERING = r"(?iU)^\s*(?:chapter|part|section|appendix|unit|lesson)\s+[\divxlcdm]+[\s:.\-–)]*"
TITLE_ENUM = r"(?U)^\s*(?:\d+(?:\.\d+)+[\s:.\-–)]*|\d+\s*[:.\-–)]+\s*)"
PART_SUFFIX = r"(?iU)\s*\((?:part\s*)?\d+\)\s*$"


# Letters whose upper case is several letters in Java, and their one-letter upper case (themselves, if none).
SEVERAL = [c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1]
SINGLE = ["\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in SEVERAL]


def upper_letter(letter: Column) -> Column:
    """Upper case of one letter as one letter, as in SQL."""
    upper = F.upper(letter)
    return F.when(F.length(upper) == 1, upper).otherwise(F.translate(letter, "".join(SEVERAL), "".join(SINGLE)))


def compose_title(c: Column, limit: int = 72) -> Column:
    """Clean concept title: markers, numbering and page numbers go, a part suffix stays."""
    def clean(bare):
        bare = strip(F.ltrim(strip(bare), F.lit("#>*-\u2022\u2013 \t")))
        bare = F.regexp_replace(bare, DOT_LEADER, " ")
        bare = F.regexp_replace(bare, r"(?U)\s+\d{1,4}$", "")
        bare = F.regexp_replace(F.regexp_replace(bare, TITLE_NUMBERING, ""), TITLE_ENUM, "")
        return F.btrim(F.regexp_replace(bare, r"(?U)\s{2,}", " "), F.lit(" .:-\u2013\t"))

    def clip(text):
        at_word = F.nullif(strip(F.regexp_replace(F.substring(text, 1, limit), "(?s) [^ ]*$", "")), F.lit(""))
        return F.when(F.length(text) <= limit, text).otherwise(
            F.coalesce(at_word, strip(F.substring(text, 1, limit)))
        )

    def capitalize(text):
        first = F.substring(text, 1, 1)
        return F.when(first.rlike(r"^\p{Ll}"), F.concat(upper_letter(first), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)

    def build(text):
        part = F.nullif(F.regexp_extract(F.regexp_extract(text, PART_SUFFIX, 0), r"\d+", 0), F.lit(""))
        suffix = F.coalesce(F.concat(F.lit(" (part "), part, F.lit(")")), F.lit(""))
        title = F.coalesce(F.nullif(clean(F.regexp_replace(text, PART_SUFFIX, "")), F.lit("")), F.lit("Untitled concept"))
        return F.concat(let(let(title, clip), capitalize), suffix)

    return let(strip(F.coalesce(c, F.lit(""))), build)


def first_line_title(c: Column, limit: int = 72) -> Column:
    """Title from the first line that is neither blank nor a heading."""
    candidates = F.filter(F.transform(split_lines(c), strip), lambda x: (x != "") & ~x.startswith("#"))
    picked = truncate(F.rtrim(F.try_element_at(candidates, F.lit(1)), F.lit(".")), limit)
    return F.coalesce(picked, F.nullif(truncate(c, limit), F.lit("")), F.lit("Untitled concept"))


def coherence(title: Column, body: Column) -> Column:
    """Jaccard overlap of content words."""
    return jaccard(F.array_distinct(content_words(title)), F.array_distinct(content_words(body)))


def jaccard(a: Column, b: Column) -> Column:
    def ratio(n):
        both = F.size(F.array_intersect(n["a"], n["b"]))
        return F.when((F.size(n["a"]) == 0) | (F.size(n["b"]) == 0), F.lit(0.0)).otherwise(
            both / (F.size(n["a"]) + F.size(n["b"]) - both)
        )

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def grounded(title_words: Column, body_words: Column, floor: float = 0.12) -> Column:
    """At least half of the title's distinct content words occur in the body, or Jaccard >= floor."""
    def test(n):
        both = F.size(F.array_intersect(n["a"], n["b"]))
        share = both / F.greatest(F.size(n["a"]), F.lit(1))
        return (F.size(n["b"]) > 0) & (F.size(n["a"]) > 0) & ((share >= 0.5) | (jaccard(n["a"], n["b"]) >= floor))

    return let(F.struct(title_words.alias("a"), body_words.alias("b")), test)


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def join_ordered(items: Column, separator: str) -> Column:
    """Join ``text`` fields of collected structs in the order of their first field."""
    return F.array_join(F.transform(F.sort_array(items), lambda s: s["text"]), separator)
