"""Task context: evidence categories, ordering by intent, impact, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from . import fusion
from .kept import kept

# Categories of an intent, most wanted first.
PRIORITIES = {
    "understand": ["currentState", "implementationEvidence", "decisions", "dependencies", "requirements"],
    "implement": ["requirements", "invariants", "constraints", "dependencies", "implementationEvidence", "decisions", "tests"],
    "modify": ["affectedComponents", "implementationEvidence", "dependencies", "requirements", "decisions", "invariants", "tests", "incidents", "risks"],
    "debug": ["incidents", "tests", "implementationEvidence", "dependencies", "decisions", "risks"],
    "review": ["requirements", "invariants", "decisions", "tests", "risks", "contradictions"],
    "document": ["requirements", "invariants", "constraints", "decisions", "currentState", "risks", "tests", "contradictions"],
}
# Words of the categories, and the types of pages that describe how things are.
WORDS = {
    "invariants": ["invariant", "invariante", "must always", "must never", "deve sempre", "non deve mai", "only after"],
    "constraints": ["constraint", "constraints", "vincolo", "vincoli", "restriction", "restricted", "limit", "limite", "cannot", "must not", "non pu[oò]", "non deve", "at most", "no more than"],
    "dependencies": ["dependency", "dependencies", "dipendenz[a-z0-9_]*", "interface", "interfaces", "endpoint", "schema", "contract", "contratto"],
    "incidents": ["incident", "incidente", "outage", "failure", "failures", "guasto", "postmortem", "known failure", "regression"],
    "tests": ["test", "tests", "verification", "regression", "verifica", "collaudo"],
    "risks": ["risk", "risks", "rischio", "rischi"],
    "contradictions": ["contradiction", "contradictory", "conflict", "contraddizione", "conflitto"],
    "conflicts": ["not marked superseded", "unresolved contradict[a-z0-9_]*", "contradicts?", "conflicting (?:claim|decision|evidence|requirement|rule)", "in conflitto con", "contraddice[a-z0-9_]*", "evidenz[ae] contraddittori[ae]"],
}
CURRENT_TYPES = ["entity", "concept", "summary", "comparison", "overview", "analysis", "client_source", "meeting_note", *vocab.COMPONENT_TYPES]


def categories(type_: Column, tags: Column, text: Column) -> Column:
    """Evidence categories of a page by type, tags and text, in a fixed order."""
    word = fusion.word_test
    tests = [
        ("currentState", type_.isin(CURRENT_TYPES)),
        ("requirements", type_.isin("requirement", "request", "candidate_request")),
        ("decisions", type_ == "decision"),
        ("affectedComponents", type_.isin(vocab.COMPONENT_TYPES)),
        ("implementationEvidence", type_.isin(vocab.COMPONENT_TYPES)),
        ("tests", (type_ == "test_result") | word(tags, WORDS["tests"])),
        ("invariants", word(text, WORDS["invariants"])),
        ("constraints", word(text, WORDS["constraints"])),
        ("dependencies", type_.isin("api", "integration", "data_model", "automation") | word(text, WORDS["dependencies"])),
        ("incidents", (type_ == "analysis") & word(text, WORDS["incidents"])),
        ("risks", (type_ == "risk") | word(tags, WORDS["risks"])),
        ("contradictions", word(tags, WORDS["contradictions"]) | word(text, WORDS["conflicts"])),
    ]
    return F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in tests)))


def buckets(hits: DataFrame) -> DataFrame:
    """qid, category, path, rank of hits (qid, path, rank, type, tags, body)."""
    return hits.select("qid", "path", "rank", F.explode(categories(F.col("type"), F.array_join("tags", " "), F.col("body"))).alias("category"))


def ordered(hits: DataFrame, intent: str) -> DataFrame:
    """qid, path, place of hits with a categories column: for each wanted category in turn the best hit not taken yet, unless a
    taken one covers it; then the rest by rank. At most a few dozen hits per query: one small group each."""
    wanted = PRIORITIES[intent]

    def order(key, part: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, set(c)) for p, c in part.sort_values("rank")[["path", "categories"]].itertuples(index=False)]
        taken: list = []
        for w in wanted:
            if not any(w in c for _, c in taken):
                best = next((r for r in rows if w in r[1] and r not in taken), None)
                if best is not None:
                    taken.append(best)
        taken += [r for r in rows if r not in taken]
        return pd.DataFrame({"qid": [key[0]] * len(taken), "path": [p for p, _ in taken], "place": range(1, len(taken) + 1)})

    return hits.select("qid", "path", "rank", "categories").groupBy("qid").applyInPandas(order, "qid long, path string, place int")


def impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, direction, kind, node: edges out of and into each root (column root)."""
    r = roots.select("root").distinct()
    out = edges.join(r, F.col("src") == F.col("root")).select("root", F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("node"))
    return out.unionByName(edges.join(r, F.col("dst") == F.col("root")).select("root", F.lit("incoming").alias("direction"), "kind", F.col("src").alias("node")))


def dependencies(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, path of hits that another hit of the query is linked with."""
    h = hits.select("qid", "path", F.concat(F.lit("page:"), "path").alias("node"))
    a = edges.join(h.select("qid", F.col("node").alias("src")), "src").join(h.select("qid", F.col("node").alias("dst"), F.col("path").alias("path")), ["qid", "dst"])
    return a.select("qid", "path").distinct()


def levels(maximum: dict, initial: dict) -> list[dict]:
    """Budgets of the widening levels: initial; seeds and nodes doubled, depth one more, evidence and tokens by half; then the maximum."""
    grown = {"seeds": 2 * initial["seeds"], "nodes": 2 * initial["nodes"], "depth": initial["depth"] + 1, "evidence": max(initial["evidence"] + 1, int(initial["evidence"] * 1.5)), "tokens": max(initial["tokens"] + 1, int(initial["tokens"] * 1.5))}
    return [initial, {k: min(v, maximum[k]) for k, v in grown.items()}, dict(maximum)]


def widened(queries: DataFrame, attempt, enough, budgets: list[dict]) -> DataFrame:
    """Runs attempt(queries, budget) level by level on the queries that aren't satisfied yet; enough(hits) gives the satisfied qids."""
    open_, out = queries, None
    for level, budget in enumerate(budgets):
        hits = attempt(open_, budget).withColumn("level", F.lit(level))
        last = level == len(budgets) - 1
        done = kept(enough(hits).select("qid").distinct())
        settled = hits if last else hits.join(done, "qid", "left_semi")
        out = settled if out is None else out.unionByName(settled)
        open_ = open_.join(done, "qid", "left_anti")
        if not last and open_.isEmpty():
            break
    return out

