"""Text functions as columns: normalisation, tokens, stems, identifiers, sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab

TOKEN = r"/?[\p{L}\p{N}][\p{L}\p{N}_./:#-]*"
DELIMITERS = r"[_./:#-]+"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _unaccented(text: pd.Series) -> pd.Series:
    return text.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F), na_action="ignore")


def folded(text: Column, nfkc: bool = False) -> Column:
    """Lower case; with `nfkc`, compatibility forms are folded too (only rows beyond ASCII leave the JVM's own functions)."""
    if nfkc:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)
    return F.lower(text)


def search_text(text: Column, nfkc: bool = False) -> Column:
    """Folded text in which everything but letters, digits and _ . / : # - is one blank."""
    return F.trim(F.regexp_replace(folded(text, nfkc), r"[^\p{L}\p{N}_./:#-]+", " "))


def tokens(text: Column, nfkc: bool = False) -> Column:
    """All tokens of a text with their parts of two characters or more, repeats included."""
    whole = F.regexp_extract_all(folded(F.coalesce(text, F.lit("")), nfkc), F.lit(TOKEN), 0)
    parts = lambda t: F.concat(F.array(t), F.filter(F.split(t, DELIMITERS), lambda p: (F.length(p) >= 2) & (p != t)))
    # most tokens have no delimiter and so no parts
    return F.flatten(F.transform(whole, lambda t: F.when(t.rlike("[_./:#-]"), parts(t)).otherwise(F.array(t))))


def distinct_tokens(text: Column, nfkc: bool = False) -> Column:
    return F.array_distinct(tokens(text, nfkc))


def query_coverage(text: Column, query: Column) -> Column:
    """Share of the query's distinct tokens found in the text; 0 for an empty query."""
    wanted = distinct_tokens(query)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, distinct_tokens(text))) / F.size(wanted))


def slug(text: Column, empty: str = "item") -> Column:
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), _unaccented(text)).otherwise(text)
    out = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", empty).otherwise(out)


def stem(word: Column) -> Column:
    """First suffix of the lists that leaves three letters; words with digits or delimiters, and short ones, stay."""
    out = word
    for s in reversed([*vocab.ENGLISH_SUFFIXES, *vocab.ITALIAN_SUFFIXES]):
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.concat(cut, F.lit("y")) if s == "ies" else cut).otherwise(out)
    return F.when(word.rlike(r"[_./:#-]|[0-9]") | (F.length(word) < 4), word).otherwise(out)


def compact_identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def identifier_aliases(text: Column) -> Column:
    """Distinct joins of one to three neighbouring alphanumeric runs, two characters or longer."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)

    def joined(n: int) -> Column:
        return F.transform(runs, lambda _, i: F.array_join(F.slice(runs, i + 1, F.lit(n)), ""))

    joins = [joined(n) for n in (1, 2, 3)]
    return F.array_distinct(F.filter(F.concat(*joins), lambda x: F.length(x) >= 2))


def estimated_tokens(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 3)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))


def preview(text: Column, size: int = 180) -> Column:
    flat = squeezed(text)
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def excerpt(text: Column, size: int = 420) -> Column:
    return F.substring(squeezed(text), 1, size)


def passage_id(heading: Column, text: Column) -> Column:
    """Content-addressed id of a passage (headings and texts in NFC)."""
    return F.concat(F.lit("p-"), F.substring(F.sha2(F.concat(heading, F.lit("\0"), text), 256), 1, 16))


def wiki_links(text: Column) -> Column:
    """Targets of [[name]], [[name|label]] and of relative [label](path#anchor) links."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), 1), lambda x: F.trim(x))
    linked = F.filter(F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]*\]\(([^)#\s]+)"), 1), lambda x: ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#"))
    return F.array_distinct(F.concat(named, linked))


def file_variants(name: Column) -> Column:
    """Names that a link may mean: as written, and with blanks, underscores and hyphens exchanged."""
    low = F.lower(F.trim(name))
    return F.array_distinct(F.array(low, F.regexp_replace(low, "[ -]+", "_"), F.regexp_replace(low, "[ _]+", "-"), F.regexp_replace(low, "[_-]+", " ")))


def range_hash(content: Column, first: Column, last: Column) -> Column:
    """Hash of lines first..last (from 1) without trailing blanks and tabs; null if out of bounds."""
    lines = F.split(content, "\r?\n")
    wanted = F.transform(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), lambda x: F.regexp_replace(x, r"[\t ]+$", ""))
    return F.when((first >= 1) & (last >= first) & (last <= F.size(lines)), F.sha2(F.array_join(wanted, "\n"), 256))


def qualified_symbol(name: Column) -> Column:
    r"""`::`, `->`, `#` and `\` become dots; outer dots go."""
    return F.regexp_replace(F.regexp_replace(name, r"->|::|#|\\", "."), r"^\.+|\.+$", "")
