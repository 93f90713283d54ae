"""Queries on tokens, postings, BM25 and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import lexical, metrics
from ..sources import corpus
from .stored import best_pages, lexical_index, root

TOK = corpus.tokens_sql


def tokenize(spark, d):
    p = corpus.pages(spark, d)
    return p.select("path", F.array_join(T.distinct_tokens(F.col("body")), " ").alias("tokens"))


def term_frequency(spark, d):
    return corpus.pages(spark, d).select("path", F.explode(T.tokens(F.col("body"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))


def doc_frequency(spark, d):
    return lexical_index(spark, d).rows("path", "terms").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(spark, d):
    return lexical_index(spark, d).stats().select("n", F.round("avg_len", 6).alias("avg_len"))


def postings(spark, d):
    return lexical.postings(corpus.pages(spark, d))


def index_maintenance(spark, d):
    """Postings of an index that began with the pages of even ids in other words, then was brought up to date twice and compacted."""
    p = corpus.pages(spark, d)
    even = F.substring("path", 5, 9).cast("long") % 2 == 0
    index = lexical.LexicalIndex.create(p.filter(even).withColumn("body", F.concat(F.lit("older words "), "body")), f"{root(spark)}/lexical")
    index.refresh(p.filter(even).unionByName(p.filter(even).withColumn("path", F.concat(F.lit("gone/"), "path"))))
    index.refresh(p)
    index.compact()
    return index.postings()


def _bm25(profile, types=None):
    return lambda spark, d: lexical.bm25(lexical_index(spark, d), corpus.queries(spark, d), profile=profile, page_types=types)


def list_pages(spark, d):
    return lexical.list_pages(corpus.pages(spark, d))


def passage_ids(spark, d):
    return corpus.passages(corpus.pages(spark, d)).select("path", "pos", "passage_id")


def best_passage(spark, d):
    q, hits = corpus.queries(spark, d), best_pages(spark, d)
    # only the texts of pages that are hits are cut into passages
    p = corpus.pages(spark, d).join(F.broadcast(hits.select("path").distinct()), "path", "left_semi")
    return lexical.best_passages(corpus.passages(p), hits, q)


def query_coverage(spark, d):
    p, q = corpus.pages(spark, d), corpus.queries(spark, d)
    near = p.select("path", "body").join(F.broadcast(best_pages(spark, d).select("qid", "path").join(q, "qid")), "path")
    return near.select("qid", "path", F.round(F.size(F.array_intersect("terms", T.distinct_tokens(F.col("body")))) / F.size("terms"), 6).alias("coverage"))


def judgements(spark, d):
    """A page is relevant to a query if at least half of the query's terms are in its body; grade 2 for all of them."""
    found = lexical.shared(lexical_index(spark, d), corpus.queries(spark, d), 0.5)
    return found.select("qid", "path", F.when(F.col("hit") == F.col("asked"), 2).otherwise(1).alias("grade"))


def _metric(name, k=10):
    def run(spark, d):
        return metrics.evaluation(best_pages(spark, d, k=k), judgements(spark, d), k).select("qid", name)

    return run


def _scores_sql(profile, types=None, k=10):
    k1, b = vocab.PROFILES[profile]
    kept = f"WHERE type IN ({', '.join(repr(t) for t in types)})" if types else ""
    return f"""{corpus.PAGES_SQL}, {corpus.QUERIES_SQL},
bag AS (SELECT path, unnest({TOK('body')}) AS term, 0 AS field FROM pages_m
  UNION ALL SELECT path, unnest({TOK('title')}), 1 FROM pages_m
  UNION ALL SELECT path, unnest({TOK("concat_ws(' ', type, array_to_string(tags, ' '), array_to_string(sources, ' '), request_id, path)")}), 2 FROM pages_m),
posts AS (SELECT path, term, count(*) FILTER (field = 0) AS body_tf, count(*) FILTER (field = 1) AS title_tf, count(*) FILTER (field = 2) AS meta_tf FROM bag GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
lens AS (SELECT path, type, lower(title) AS title, lower(request_id) AS req, greatest(len(list_distinct({TOK('body')})), 1) AS len FROM pages_m),
stat AS (SELECT greatest(count(*), 1) AS n, greatest(sum(len) / count(*), 1.0) AS avg_len FROM lens),
qt AS (SELECT qid, len(terms) AS asked, unnest(terms) AS term FROM queries_m),
raw AS (SELECT qid, path, count(*) AS matched, any_value(asked) AS asked,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (body_tf + 2.5 * meta_tf + 5.0 * title_tf) * ({k1} + 1) / ((body_tf + 2.5 * meta_tf + 5.0 * title_tf) + {k1} * (1 - {b} + {b} * len / avg_len))) AS s,
  sum(CASE WHEN req = term OR title = term THEN 8.0 ELSE 0.0 END) AS e
  FROM posts JOIN (SELECT * FROM lens {kept}) USING (path) JOIN dfs USING (term) JOIN qt USING (term), stat GROUP BY qid, path),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM
  (SELECT qid, path, round((s + e) * (1 + matched::DOUBLE / asked), 6) AS score, matched FROM raw)) {f'WHERE rank <= {k}' if k else ''})"""


PASSAGES_SQL = "passages_m AS (SELECT path, pos - 1 AS pos, text, 'p-' || substr(sha256(chr(0) || text), 1, 16) AS passage_id FROM (SELECT path, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM pages_m) WHERE trim(text, ' ') <> '')"
JUDGED_SQL = f"""judged AS (SELECT qid, path, CASE WHEN hit = asked THEN 2 ELSE 1 END AS grade FROM (SELECT qid, path, count(*) AS hit, any_value(asked) AS asked FROM
  (SELECT path, unnest(list_distinct({TOK('body')})) AS term FROM pages_m) JOIN qt USING (term) GROUP BY qid, path) WHERE hit * 2 >= asked)"""
METRICS_SQL = """both_m AS (SELECT j.qid, j.grade, h.rank, row_number() OVER (PARTITION BY j.qid ORDER BY j.grade DESC, j.path) AS ideal FROM judged j LEFT JOIN hits h USING (qid, path)),
per AS (SELECT qid, count(*) AS relevant, count(rank) AS found, min(rank) AS first,
  sum(CASE WHEN rank IS NOT NULL THEN (pow(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= 10 THEN (pow(2.0, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM both_m GROUP BY qid),
shown AS (SELECT qid, count(*) AS shown FROM hits GROUP BY qid),
m AS (SELECT qid, round(coalesce(found::DOUBLE / shown, 0.0), 6) AS precision, round(coalesce(found::DOUBLE / relevant, 1.0), 6) AS recall,
  round(coalesce(1.0::DOUBLE / first, 0.0), 6) AS mrr, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg
  FROM (SELECT DISTINCT qid FROM judged) LEFT JOIN per USING (qid) LEFT JOIN shown USING (qid))"""


def _with(*parts):
    return "WITH " + ",\n".join(parts)


QUERIES = {
    "tokenize": tokenize, "term_frequency": term_frequency, "doc_frequency": doc_frequency, "corpus_stats": corpus_stats, "postings": postings,
    "bm25_balanced": _bm25("balanced"), "bm25_precision": _bm25("precision"), "bm25_coverage": _bm25("coverage"), "bm25_type_filter": _bm25("balanced", ["fr", "de"]),
    "index_maintenance": index_maintenance, "list_pages": list_pages, "passage_ids": passage_ids, "best_passage": best_passage, "query_coverage": query_coverage,
    "precision_at_k": _metric("precision"), "recall_at_k": _metric("recall"), "mrr": _metric("mrr"), "ndcg_at_k": _metric("ndcg"),
}
_TOP = "SELECT qid, path, score, matched, rank::INTEGER AS rank FROM hits"
ORACLES = {
    "tokenize": _with(corpus.PAGES_SQL, f"t AS (SELECT path, unnest({TOK('body')}) AS term, generate_subscripts({TOK('body')}, 1) AS i FROM pages_m)", "u AS (SELECT path, term, min(i) AS i FROM t GROUP BY ALL)") + " SELECT path, coalesce(string_agg(term, ' ' ORDER BY i), '') AS tokens FROM pages_m LEFT JOIN u USING (path) GROUP BY path",
    "term_frequency": _with(corpus.PAGES_SQL) + f" SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({TOK('body')}) AS term FROM pages_m) GROUP BY ALL",
    "doc_frequency": _with(_scores_sql("balanced")) + " SELECT term, df FROM dfs",
    "corpus_stats": _with(_scores_sql("balanced")) + " SELECT n, round(avg_len, 6) AS avg_len FROM stat",
    "postings": _with(_scores_sql("balanced")) + " SELECT path, term, body_tf, title_tf, meta_tf FROM posts",
    "index_maintenance": _with(_scores_sql("balanced")) + " SELECT path, term, body_tf, title_tf, meta_tf FROM posts",
    "bm25_balanced": _with(_scores_sql("balanced")) + "\n" + _TOP, "bm25_precision": _with(_scores_sql("precision")) + "\n" + _TOP,
    "bm25_coverage": _with(_scores_sql("coverage")) + "\n" + _TOP, "bm25_type_filter": _with(_scores_sql("balanced", ["fr", "de"])) + "\n" + _TOP,
    "list_pages": _with(corpus.PAGES_SQL) + " SELECT path, title, type FROM pages_m ORDER BY path LIMIT 50",
    "passage_ids": _with(corpus.PAGES_SQL, PASSAGES_SQL) + " SELECT path, pos::INTEGER AS pos, passage_id FROM passages_m",
    "best_passage": _with(_scores_sql("balanced"), PASSAGES_SQL) + f" SELECT qid, path, passage_id, matched::INTEGER AS matched, excerpt FROM (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY matched DESC, pos) AS rn FROM (SELECT qid, path, pos, passage_id, len(list_intersect(terms, {TOK('text')})) AS matched, substr(trim(regexp_replace(text, '[\\x09-\\x0D\\x20]+', ' ', 'g'), ' '), 1, 420) AS excerpt FROM hits JOIN queries_m USING (qid) JOIN passages_m USING (path))) WHERE rn = 1",
    "query_coverage": _with(_scores_sql("balanced")) + f" SELECT qid, path, round(len(list_intersect(terms, {TOK('body')}))::DOUBLE / len(terms), 6) AS coverage FROM hits JOIN queries_m USING (qid) JOIN pages_m USING (path)",
} | {key: _with(_scores_sql("balanced"), JUDGED_SQL, METRICS_SQL) + f" SELECT qid, {name} FROM m" for key, name in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("mrr", "mrr"), ("ndcg_at_k", "ndcg"))}
