"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target
stops at `cap` times its source's size and the excess is reshared by weight (water filling in closed
form). Rates: the closest rates (in relative entropy) to one copy each that meet a source's target are
min(cap, exp(lambda * size)); lambda solves the dual by Newton steps, each a distributed sum over the
histogram of (source, size), kept inside a bracket. Copies: rates are rounded over the histogram so that
their running sum is kept, a few passes settle what is left of each target, and within one (source, size)
the documents with the lowest hashes take the odd copies.

Defined results: null or empty text has size 0, rate 1 and takes no words; a source of no words has target
0; null ids are kept; rows that repeat are documents each for itself; an empty table gives no rows; other
columns pass through `mixed` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Workspace, saved, table

#: Documents of one (source, size) that one task ranks.
SHARE = 1_000


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """_src, source_size, n, target; one row per source."""
    s = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n"))
    # one row per source from here on
    s = s.withColumn("_weight", (F.row_number().over(W.orderBy("_src")) - 1) % 3 + 1)
    s = s.withColumn("_ratio", cap * F.col("source_size") / F.col("_weight"))
    order = W.orderBy("_ratio", "_src")
    every = W.partitionBy(F.lit(0))
    s = s.withColumn("_caps", F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_used", F.coalesce(F.sum("_weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.col("_caps")) / (F.sum("_weight").over(every) - F.col("_used")))
    # the first source, by cap over weight, that stays under its cap sets the level for all after it
    s = s.withColumn("_tau", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(every)["_level"])
    target = F.when(F.col("_tau").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(F.least((cap * F.col("source_size")).cast("double"), F.col("_tau") * F.col("_weight")))
    return s.select("_src", "source_size", "_n", target.alias("target"))


def tilted(hist: DataFrame, targets: DataFrame, cap: int = 3, tolerance: float = 1e-9, most: int = 300, ws: Workspace | None = None) -> DataFrame:
    """targets with _lambda and _scale: safeguarded Newton on the dual of each source, all sources at once.

    A source is done at its target, or when its bracket can't be halved any more. Raises if `most` steps are not enough.
    """
    ws = ws or Workspace(hist.sparkSession, "mix")
    state = ws.saved(
        targets.filter("source_size > 0").withColumn("_scale", F.col("source_size") / F.col("_n"))
        .withColumns({"_lambda": F.lit(0.0), "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double"), "_done": F.col("target") >= cap * F.col("source_size")}),
        "mix-dual",
    )
    for k in range(most):
        x = F.col("_size") / F.col("_scale")
        rate = F.exp(F.least(F.col("_lambda") * x, F.lit(50.0)))
        free = rate < cap
        sums = (
            hist.join(state.filter("NOT _done").select("_src", "_scale", "_lambda"), "_src")
            .groupBy("_src")
            .agg(F.sum(F.col("_count") * F.col("_size") * F.least(rate, F.lit(float(cap)))).alias("_f"), F.sum(F.when(free, F.col("_count") * F.col("_size") * x * rate).otherwise(0.0)).alias("_df"))
        )
        s = state.join(sums, "_src", "left")
        low = F.col("_f") < F.col("target")
        met = F.abs(F.col("_f") - F.col("target")) <= tolerance * F.col("target")
        lo = F.when(low, F.col("_lambda")).otherwise(F.col("_lo"))
        hi = F.when(~low, F.col("_lambda")).otherwise(F.col("_hi"))
        step = F.col("_lambda") + (F.col("target") - F.col("_f")) / F.when(F.col("_df") > 0, F.col("_df"))
        split = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(low, F.col("_lambda") * 2 + 1).otherwise(F.col("_lambda") * 2 - 1)
        good = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step - F.col("_lambda")) <= 4 + F.abs(F.col("_lambda")))
        moved = F.when(F.col("_done") | met, F.col("_lambda")).when(good, step).otherwise(split)
        narrow = F.coalesce(hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)), F.lit(False))
        state = s.select("_src", "source_size", "_n", "target", "_scale", moved.alias("_lambda"), F.coalesce(lo, "_lo").alias("_lo"), F.coalesce(hi, "_hi").alias("_hi"), (F.col("_done") | met | narrow).alias("_done"))
        if k % 3 == 2:  # three steps make one table
            state = ws.saved(state, "mix-dual", over=True)
            if state.filter("NOT _done").isEmpty():
                return state
    raise RuntimeError(f"the dual has not converged in {most} steps")


def copies_by_size(hist: DataFrame, state: DataFrame, cap: int = 3, passes: int = 4, ws: Workspace | None = None) -> DataFrame:
    """hist with _copies: copies that the documents of one (source, size) take together."""
    ws = ws or Workspace(hist.sparkSession, "mix")
    w = W.partitionBy("_src").orderBy("_size")
    rate = F.when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("_lambda") * F.col("_size") / F.col("_scale"), F.lit(50.0)))))
    h = hist.join(state.select("_src", "source_size", "target", "_lambda", "_scale"), "_src").withColumn("_sum", F.sum(F.col("_count") * rate).over(w))
    taken = F.floor(F.col("_sum") + 0.5) - F.floor(F.coalesce(F.lag("_sum").over(w), F.lit(0.0)) + 0.5)
    h = ws.saved(h.select("_src", "_size", "_count", "target", F.greatest(F.lit(0), F.least(taken, cap * F.col("_count"))).cast("long").alias("_copies")), "mix-copies")
    for k in range(passes):
        left = h.groupBy("_src").agg((F.first("target") - F.sum(F.col("_copies") * F.col("_size"))).alias("_left"))
        open_rows = h.join(left, "_src").filter((F.col("_size") > 0) & (F.col("_size") <= F.abs("_left")) & F.when(F.col("_left") > 0, F.col("_copies") < cap * F.col("_count")).otherwise(F.col("_copies") > 0))
        pick = open_rows.groupBy("_src").agg(F.max("_size").alias("_size"), F.first("_left").alias("_left"))
        room = F.when(F.col("_left") > 0, cap * F.col("_count") - F.col("_copies")).otherwise(F.col("_copies"))
        change = F.signum("_left") * F.least(F.floor(F.abs("_left") / F.col("_size")), room)
        h = h.join(pick, ["_src", "_size"], "left").select("_src", "_size", "_count", "target", (F.col("_copies") + F.coalesce(change, F.lit(0))).cast("long").alias("_copies"))
        if k % 2 or k == passes - 1:
            h = ws.saved(h, "mix-copies", over=True)
    return h


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int):
    """doc_id, _src, _size and _hash (of id and text) as columns."""
    key = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(id_col).cast("long").alias("doc_id"), key.alias("_src"), size.alias("_size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_hash")]


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: int, seed: int) -> DataFrame:
    """doc_id, _src, _size, _hash, source_size, target, copies for every row, written."""
    ws = Workspace(docs.sparkSession, "mix")
    sizes = ws.saved(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-sizes")
    hist = ws.saved(sizes.groupBy("_src", "_size").agg(F.count("*").alias("_count")), "mix-histogram")
    targets = ws.saved(source_targets(sizes, cap), "mix-targets")
    copies = copies_by_size(hist.filter("_size > 0"), tilted(hist, targets, cap, ws=ws), cap, ws=ws).select("_src", "_size", "_count", "_copies")
    # a hot (source, size) is ranked in shares; each share takes its part of the odd copies
    d = sizes.join(copies, ["_src", "_size"], "left").join(targets.select("_src", "source_size", "target"), "_src")
    shares = F.ceil(F.col("_count") / SHARE)
    d = d.withColumn("_share", F.coalesce(F.pmod(F.col("_hash"), shares), F.pmod(F.col("_hash"), F.lit(64))))
    rank = F.row_number().over(W.partitionBy("_src", "_size", "_share").orderBy("_hash", "doc_id"))
    odd = F.col("_copies") % F.col("_count")
    quota = F.floor(odd * (F.col("_share") + 1) / shares) - F.floor(odd * F.col("_share") / shares)
    each = F.floor(F.col("_copies") / F.col("_count")) + F.when(rank <= quota, 1).otherwise(0)
    return ws.result(d.select("doc_id", "_src", "_size", "_hash", "source_size", "target", F.coalesce(each, F.lit(1)).cast("int").alias("copies")), "mix-decided")


def decided(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row."""
    d = _decided(docs, id_col, text_col, source_col, cap, seed)
    return d.select("doc_id", F.when(F.col("_src") != "2", F.substring("_src", 2, 1 << 30)).alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: every document as many times as it has copies; columns as given, whatever their names.

    Rows that repeat id, text and source share the copies decided for them: some of them take one more than the others.
    """
    key = ["doc_id", "_src", "_size", "_hash"]
    plan = _decided(docs, id_col, text_col, source_col, cap, seed).groupBy(key).agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("n")).filter("all > 0")
    plan = saved(plan.select(*(F.col(c).alias(f"p{c}") for c in key), "least", (F.col("all") - F.col("n") * F.col("least")).alias("more"), "n"), "mix-plan")
    rows = docs.select(F.struct("*").alias("doc"), *_sized(docs, id_col, text_col, source_col, seed))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"p{c}"))
    alone = rows.join(plan.filter("more = 0").hint("merge"), same).select("doc", F.col("least").cast("int").alias("copies"))
    some = plan.filter("more > 0")
    if not some.isEmpty():
        place = F.row_number().over(W.partitionBy(*key).orderBy("_hash"))
        alone = alone.unionByName(rows.join(some, same).select("doc", (F.col("least") + F.when(place <= F.col("more"), 1).otherwise(0)).cast("int").alias("copies")).filter("copies > 0"))
    found = alone.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' share in the mix."""
    d = decided(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
