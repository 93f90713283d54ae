"""Line-first quality rules, in DataFrame functions only.

Each line is held against rules for punctuation (runs of marks, long lines without any sentence mark), navigation
(separators, runs of short lines without an end mark) and boilerplate (notices in English, French, German and
Spanish); failing lines are taken out. A document is rejected if it fails the base rules, if the lines that fail by
their shape hold over `max_lost_percent` of its characters, or if fewer than `min_words` words are left. A notice
is charged only by what it leaves: a short clean text stays under a long licence line, a page of nothing but
notices goes.

Defined results: null or empty text has no words and fails the base rules; null ids and repeated rows
are judged row by row; an empty table gives no rows; other columns pass through `clean` untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, WORD, table

#: Runs of marks that prose doesn't have.
MARKS = r"[!?]{2,}|[#*$%&]{2,}"
#: Phrases of notices and site furniture; letters with accents are left open, so that case doesn't matter.
PHRASES = {
    "en": "licensed under |released under the |all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|copyright (\\(c\\)|©|[0-9]{4})|enable javascript|sign up|subscribe to|click here",
    "fr": "sous licence |tous droits r.serv|politique de confidentialit|conditions (g.n.rales )?d.utilisation|mentions l.gales|accepter (tous )?les cookies|cliquez ici|s.abonner .|activer javascript",
    "de": "lizenziert unter |alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|cookies akzeptieren|cookie-einstellungen|klicken sie hier|newsletter abonnieren|javascript aktivieren",
    "es": "con licencia |bajo (la )?licencia |todos los derechos reservados|pol.tica de (privacidad|cookies)|aviso legal|aceptar (las |todas las )?cookies|haga clic aqu|suscr.bete|activar javascript",
}
NOTICES = "(?i)" + "|".join(PHRASES.values())
#: What ends a sentence or a clause.
ENDS = r"[.!?:;,…。！？]"
SEPARATORS = r"[|›•·]"
SYMBOLS = r"[#*$%&|<>]"
WORDY = r"[^\x20\x09-\x0D]"



def failing(line: Column, bare: int = 200) -> Column:
    """True if a line fails by its own shape: mark runs at least 3 and one in 30 characters; separators at least 2 and
    one in 40 characters; `bare` characters without any sentence mark."""
    size = F.length(line)
    marks = F.regexp_count(line, F.lit(MARKS))
    parts = size - F.length(F.regexp_replace(line, SEPARATORS, ""))
    return ((marks >= 3) & (marks * 30 >= size)) | ((parts >= 2) & (parts * 40 >= size)) | ((size >= bare) & ~line.rlike(ENDS))


def item(line: Column, longest: int = 30) -> Column:
    """True for a line with a word, of up to `longest` characters and without any sentence mark."""
    return (F.length(line) <= longest) & line.rlike(WORDY) & ~line.rlike(ENDS)


def in_menu(items: Column, i: Column, run: int = 4) -> Column:
    """True for line i of a run of at least `run` lines that are items."""
    at = lambda k: F.coalesce(F.when(i + k >= 0, F.get(items, i + k)), F.lit(False))
    found = F.lit(False)
    for first in range(1 - run, 1):
        here = F.lit(True)
        for k in range(first, first + run):
            here = here & at(k)
        found = found | here
    return F.get(items, i) & found


def notice(line: Column, longest: int = 300) -> Column:
    """True for a line of up to `longest` characters with a phrase of NOTICES."""
    return (F.length(line) <= longest) & line.rlike(NOTICES)


def measured(docs: DataFrame, text_col: str = "text", *, min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50) -> DataFrame:
    """Columns _doc (the row as a struct), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    line_chars, n_left_words, base_failed, kept, clean_text.

    Repeated 5-word windows are found inside each row: hashes of windows; only where they aren't all
    distinct are they sorted with their places and neighbours compared. No shuffle.
    """
    zero = F.lit(0)
    t = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.select("_doc", "_t", F.array_remove(F.split("_t", GAP), "").alias("_w"), F.split("_t", "\n").alias("_all"))
    t = t.select(
        "_doc", "_t", "_all",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.filter("_all", lambda x: x.rlike(WORDY)).alias("_lines"),
        F.transform("_all", lambda x: item(x)).alias("_items"),
    )
    t = t.withColumn("_good", F.filter("_all", lambda x, i: ~failing(x) & ~in_menu(F.col("_items"), i)))
    t = t.withColumn("_left", F.filter("_good", lambda x: ~notice(x)))
    h = F.col("_h")
    window = lambda i: F.xxhash64(*(h[i + k] for k in range(5)))
    t = t.withColumn("_g", F.when(F.size("_h") >= 5, F.transform(F.sequence(zero, F.size("_h") - 5), window)).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    t = t.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("_s")
    twin = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"]))
    t = t.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["p"]))))
    p = F.col("_p")
    cover = F.aggregate(F.transform("_p", lambda x, i: F.coalesce(F.least(F.lit(5), F.get(p, i + 1) - x), F.lit(5))), zero, lambda a, x: a + x)
    chars = lambda c: F.length(F.array_join(c, "")).cast("long")
    t = t.select(
        "_doc", "n_words", "word_chars",
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), cover).otherwise(zero).cast("long").alias("n_repeat_words"),
        chars("_all").alias("line_chars"),
        (chars("_all") - chars("_good")).alias("lost_chars"),
        F.array_join("_left", "\n").alias("clean_text"),
        F.when(F.size("_left") == F.size("_all"), F.col("n_words")).otherwise(F.regexp_count(F.array_join("_left", "\n"), F.lit(WORD))).cast("long").alias("n_left_words"),
    )
    t = t.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return t.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("line_chars")) & (F.col("n_left_words") >= min_words))


def clean(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The kept documents with their failing lines removed; columns as given."""
    # a column that isn't deterministic keeps Catalyst from copying the measures into the filter and below it
    kept = measured(docs, text_col, **rules).withColumn("_part", F.spark_partition_id()).filter("kept AND _part >= 0")
    return kept.select(*(F.col("clean_text").alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    t = measured(table(spark, sf_dir, "documents"))
    return t.select(F.col("_doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "n_left_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
m AS (SELECT doc_id, i, l, length(l) AS size, len(regexp_extract_all(l, '[!?]{2,}|[#*$%&]{2,}')) AS marks, length(l) - length(regexp_replace(l, '[|›•·]', '', 'g')) AS parts,
  length(l) <= 30 AND regexp_matches(l, '[^\x20\x09-\x0D]') AND NOT regexp_matches(l, '[.!?:;,…。！？]') AS item FROM ln),
z AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item ORDER BY i) AS run FROM m),
y AS (SELECT *, item AND count(*) OVER (PARTITION BY doc_id, item, run) >= 4 AS menu FROM z),
f AS (SELECT *, (menu OR (marks >= 3 AND marks * 30 >= size) OR (parts >= 2 AND parts * 40 >= size)
  OR (size >= 200 AND NOT regexp_matches(l, '[.!?:;,…。！？]'))) AS bad, length(l) <= 300 AND regexp_matches(l, '{NOTICES}') AS notice FROM y),
a AS (SELECT doc_id, sum(size) AS line_chars, coalesce(sum(size) FILTER (bad), 0) AS lost_chars,
  count(*) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) - count(DISTINCT l) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) AS n_dup_lines,
  coalesce(sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) FILTER (NOT bad AND NOT notice), 0) AS n_left_words FROM f GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, a.n_dup_lines::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  a.line_chars, a.lost_chars::BIGINT AS lost_chars, a.n_left_words::BIGINT AS n_left_words
  FROM w JOIN a USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= 50 * line_chars AND n_left_words >= 10 AS kept, lost_chars, n_left_words FROM b
""".replace("{NOTICES}", NOTICES.replace("'", "''"))
