"""Does the evidence answer the query? Concepts of a query, and what a result lacks of them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions import vocab
from . import fusion
from .kept import kept

# Verbs after a sentence's first word that make it prose, what a project or client name follows, and
# the least cosine by which a concept counts as found.
PROSE_VERBS = """allow allows carica caricano contain contains contiene contengono create creates crea creano delete deletes elimina eliminano
gestisce gestiscono handle handles include includes legge leggono load loads permette permettono provide provides read reads receive receives
restituisce restituiscono require requires return returns riceve ricevono run runs scrive scrivono send sends store stores support supports usa
usano use uses update updates write writes""".split()
_OWNER = re.compile(r"\b(?:client|cliente|project|progetto|system|sistema)\s+$", re.I | re.A)
_SUBJECT = re.compile(r"\b(?:funzionamento|comportamento|architettura|contesto|functioning|behavior|behaviour|architecture|context)\s+(?:di|del|della|dei|degli|delle|su|sui|sulle|of|about|for)\s+(?:the\s+)?([A-Za-z][A-Za-z0-9_.#/-]*)", re.I | re.A)
_TECHNICAL = re.compile(r"/?[A-Za-z][A-Za-z0-9]*(?:[-_./:#]+[A-Za-z0-9]+)+|\b[A-Z]{2,}[A-Z0-9]*\b|\b\d{2,}\b", re.A)
_CAPITAL = re.compile(r"\b[A-Z][a-zA-Z0-9]{2,}\b", re.A)
_INTRODUCED = re.compile(r"\b(?:il|lo|la|i|gli|le|un|una|the|a|an)\s+([A-Z][a-zA-Z]{2,})\b", re.A)
_PART = re.compile(r"[^\W_]+")
THRESHOLDS = {"facet": 0.72, "entity": 0.8, "type": 0.72}
TYPE_TEXTS = {"requirement": "requirement requirements specification requested behavior", "test_result": "test tests verification regression result", "implementation": "implementation component service code integration"}
TEST_TAGS = ["test", "tests", "verification", "regression", "verifica", "collaudo"]


def entities_of(text: str | None) -> list[str]:
    """Names and identifiers in a query, in the order subjects, technical terms, capitalised words, words after an article."""
    text = text or ""
    named = lambda m: not _OWNER.search(text[max(0, m.start() - 24) : m.start()])
    found = [m.group(1) for m in _SUBJECT.finditer(text)] + [m.group() for m in _TECHNICAL.finditer(text) if named(m)]
    for m in _CAPITAL.finditer(text):
        after = re.match(r"\s*([A-Za-z]+)", text[m.end() :])
        if named(m) and not (m.start() == 0 and after and after.group(1).lower() in PROSE_VERBS):
            found.append(m.group())
    found += [m.group(1) for m in _INTRODUCED.finditer(text)]
    generic = lambda x: x.lower() in vocab.STOP_WORDS and not (x[0].isupper() and x.lower() in ("system", "sistema"))
    return list(dict.fromkeys(x for x in found if not generic(x) and not (x == x.lower() and re.fullmatch("[A-Za-z]+/[A-Za-z]+", x))))


@F.pandas_udf(ArrayType(StringType()))
def query_entities(texts: pd.Series) -> pd.Series:
    return texts.map(entities_of)


@F.pandas_udf(ArrayType(StringType()))
def named_in(texts: pd.Series, entities: pd.Series) -> pd.Series:
    """Those of the entities that a text names: as a run of one to three of its words, written together."""
    def one(text, wanted):
        keys = {e: "".join(_PART.findall(unicodedata.normalize("NFKC", e).lower())) for e in wanted}
        words, runs = _PART.findall(unicodedata.normalize("NFKC", text or "").lower()), set()
        for n in (1, 2, 3):
            runs.update(map("".join, zip(*(words[i:] for i in range(n)))))
        return [e for e, k in keys.items() if len(k) >= 2 and k in runs]

    return pd.Series([one(t, e) for t, e in zip(texts, entities)])


def entity_text(entity: Column) -> Column:
    """An identifier as words: camel case and delimiters become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, "([a-z0-9])([A-Z])", "$1 $2"), "[_./:#-]+", " "), r"\s+", " "))


def type_text(page_type: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in TYPE_TEXTS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, page_type), F.regexp_replace(page_type, "[_-]+", " "))


def compact(value: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def exact_signal(text: Column) -> Column:
    """True if a query names something by an identifier or a number of two digits."""
    return text.rlike(r"\p{L}[\p{L}\p{N}]*[-_:/][\p{L}\p{N}._:/-]*[0-9]|[0-9]{2,}")


def satisfies(page_type: Column, tags: Column, wanted: Column) -> Column:
    """True if a page of a type (tags as one text) is what a query of the wanted type asks for."""
    return (
        (page_type == wanted)
        | ((wanted == "requirement") & page_type.isin("request", "candidate_request"))
        | ((wanted == "implementation") & page_type.isin(vocab.COMPONENT_TYPES))
        | ((wanted == "test_result") & (page_type == "analysis") & fusion.word_test(tags, TEST_TAGS))
    )


def requirements(queries: DataFrame) -> DataFrame:
    """queries (qid, text) with entities, facets, wanted (page types), least_sources, check_conflicts."""
    q = queries.withColumn("entities", query_entities("text"))
    own = F.flatten(F.transform("entities", lambda e: T.distinct_tokens(e)))
    stop = F.array(*map(F.lit, vocab.STOP_WORDS))
    return q.select(
        "qid", "text", "entities",
        F.filter(F.array_except(F.array_except(T.distinct_tokens(F.col("text")), stop), own), lambda t: F.length(t) >= 2).alias("facets"),
        fusion.required_types(F.col("text")).alias("wanted"),
        F.when(fusion.word_test(F.col("text"), ["sources", "fonti"]), 2).otherwise(0).alias("least_sources"),
        F.lower("text").rlike(r"(?<![a-z0-9_])(contradict|conflict|contradd|conflitt)").alias("check_conflicts"),
    )


def concepts(asked: DataFrame) -> DataFrame:
    """qid, id, kind, value, text of every facet, entity and wanted type (of `requirements`)."""
    def of(kind, column, text):
        rows = asked.select("qid", F.posexplode(column).alias("n", "value"))
        return rows.select("qid", F.concat(F.lit(kind + ":"), F.col("n").cast("string")).alias("id"), F.lit(kind).alias("kind"), "value", text(F.col("value")).alias("text"))

    return of("facet", "facets", lambda v: v).unionByName(of("entity", "entities", entity_text)).unionByName(of("type", "wanted", type_text))


def _words(hits: DataFrame, text: Column) -> DataFrame:
    w = hits.select("qid", F.explode(T.distinct_tokens(text)).alias("w")).distinct()
    return w.select("qid", F.explode(F.array_distinct(F.array("w", T.stem(F.col("w"))))).alias("key")).distinct()


def snapshot(asked: DataFrame, hits: DataFrame, semantic: DataFrame | None = None, minimum: float = 0.6, minimum_passage: float = 0.2) -> DataFrame:
    """qid, facet_coverage, passage_coverage, sources, missing_entities, missing_types, conflicts, gaps of hits
    (qid, path, title, type, tags, sources, request_id, heading, excerpt, body). `semantic` (qid, id, path, score, passage: does
    it hold for the shown passage) lets a concept count as found by its meaning."""
    c = kept(concepts(asked))
    whole = F.concat_ws(" ", "path", "title", "type", F.array_join("tags", " "), F.array_join("sources", " "), "request_id", "heading", "excerpt", "body")
    none = c.select("qid", "id").limit(0)
    near = near_passage = none
    if semantic is not None:
        least = F.create_map(*(x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))))
        s = semantic.join(hits.select("qid", "path").distinct(), ["qid", "path"], "left_semi").filter(F.col("score") >= F.element_at(least, F.substring_index("id", ":", 1)))
        near, near_passage = s.select("qid", "id").distinct(), s.filter("passage").select("qid", "id").distinct()
    facets = c.filter("kind = 'facet'").select("qid", "id", F.explode(F.array_distinct(F.array("value", T.stem(F.col("value"))))).alias("key"))

    def covered(text, meant, name):
        lexical = facets.join(_words(hits, text), ["qid", "key"]).select("qid", "id")
        return lexical.union(meant.filter("id LIKE 'facet:%'")).distinct().groupBy("qid").agg(F.count("*").alias(name))

    e = c.filter("kind = 'entity'")
    read = hits.join(asked.filter(F.size("entities") > 0).select("qid", "entities"), "qid").select("qid", F.explode(named_in(whole, F.col("entities"))).alias("value")).distinct()
    known = e.join(read, ["qid", "value"]).select("qid", "id").union(near.filter("id LIKE 'entity:%'"))
    entities = e.join(known.distinct(), ["qid", "id"], "left_anti").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.split("id", ":")[1].cast("int").alias("n"), "value"))), lambda x: x["value"]).alias("missing_entities"))
    t = c.filter("kind = 'type'")
    right = t.join(hits.select("qid", "type", "tags"), "qid").filter(satisfies(F.col("type"), F.array_join("tags", " "), F.col("value"))).select("qid", "id").union(near.filter("id LIKE 'type:%'"))
    types = t.join(right.distinct(), ["qid", "id"], "left_anti").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.split("id", ":")[1].cast("int").alias("n"), "value"))), lambda x: x["value"]).alias("missing_types"))
    groups = hits.filter("request_id IS NOT NULL").withColumn("request_id", F.struct("qid", "request_id"))
    conflicts = fusion.contradictions(groups).filter("contradiction").groupBy(F.col("request_id.qid").alias("qid")).agg(F.count("*").alias("conflicts"))
    sources = hits.select("qid", F.explode("sources").alias("s")).groupBy("qid").agg(F.countDistinct("s").alias("sources"))
    held = hits.groupBy("qid").agg(F.count("*").alias("held"))
    out = asked
    for part in (covered(whole, near, "page_facets"), covered(F.concat_ws(" ", "heading", "excerpt"), near_passage, "passage_facets"), entities, types, conflicts, sources, held):
        out = out.join(part, "qid", "left")
    size, empty = F.size("facets"), F.array().cast("array<string>")
    share = lambda n: F.when(size == 0, 1.0).otherwise(F.coalesce(F.col(n), F.lit(0)) / size)
    out = out.select(
        "qid", F.round(share("page_facets"), 6).alias("facet_coverage"), F.round(F.when(F.col("held").isNull(), 0.0).otherwise(share("passage_facets")), 6).alias("passage_coverage"),
        F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("missing_entities", empty).alias("missing_entities"), F.coalesce("missing_types", empty).alias("missing_types"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "least_sources", "check_conflicts",
    )
    named = F.array_compact(F.array(F.when(F.col("facet_coverage") < minimum, F.lit("query_facets")), F.when(F.col("passage_coverage") < minimum_passage, F.lit("passage_evidence")), F.when(F.col("sources") < F.col("least_sources"), F.lit("source_diversity"))))
    more = F.concat(F.transform("missing_entities", lambda x: F.concat(F.lit("entity:"), x)), F.transform("missing_types", lambda x: F.concat(F.lit("required_type:"), x)), F.array_compact(F.array(F.when(F.col("check_conflicts") & (F.col("conflicts") == 0), F.lit("contradiction_evidence")))))
    return out.withColumn("gaps", F.array_distinct(F.concat(named, more))).drop("least_sources", "check_conflicts")


def assess(asked: DataFrame, hits: DataFrame, shown: DataFrame, semantic: DataFrame | None = None, truncated: DataFrame | None = None) -> DataFrame:
    """snapshot of all hits with limited (gaps that only what is shown has) and sufficient (no gap in either). `truncated`
    (column qid): queries whose graph walk was cut off."""
    full, part = snapshot(asked, hits, semantic), snapshot(asked, shown, semantic).select("qid", F.col("gaps").alias("_shown"))
    if truncated is not None:
        full = full.join(truncated.select("qid", F.array(F.lit("truncated_frontier")).alias("_cut")).distinct(), "qid", "left").withColumn("gaps", F.concat("gaps", F.coalesce("_cut", F.array().cast("array<string>")))).drop("_cut")
    out = full.join(part, "qid").withColumn("limited", F.array_except("_shown", "gaps")).drop("_shown")
    return out.withColumn("sufficient", (F.size("gaps") == 0) & (F.size("limited") == 0))
