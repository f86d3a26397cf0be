"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Of all document rates between 0 and 2 whose token sums meet the targets, entropy balancing takes those nearest to 1 in relative entropy. The dual has one multiplier per source, and a document's rate is tilted by its
own size: rate = min(2, exp(lambda of the source * size)). Newton's method solves the dual: in each iteration one distributed aggregation per source gives the token sum at the present multipliers, the gradient, and its derivative,
the Hessian; a step that leaves the bracket of the solution is replaced by a bisection. Documents of one size and source share their rate, so the iterations read a table of sizes.

Rates become copies by systematic rounding over the documents of a source ordered by falling size, so the error of a source is at most half its largest document. Repair rounds then
change one copy of one document per source and round, the one that brings the source nearest to its target, until none would.
Ranks are sums over (source, size, hash slice), so one large source, or one size that most documents have, is spread over many tasks.

Null texts have size 0 and take nothing; null sources form one source, ordered last; rows that are equal are separate documents; an empty table gives no
rows. Only the id, text and source columns are read by the query. The order of documents comes from sizes and hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import prefix_sums, row_digest, saved, whole_text
from terraloom.llm.registry import query, table
from terraloom.runtime import salted_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SLICES = 64
#: Newton steps at most, and the relative error of a source's tokens that ends them.
STEPS, CLOSE = 60, 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def source_targets(units: DataFrame) -> DataFrame:
    """(g, tokens, target) per source: weights 5, 2, 1 in code point order share 150 % of all tokens, none above twice its own.

    Proportional shares with a ceiling: sources in order of ceiling / weight fill up to some point; the level there serves the rest.
    """
    sources = units.groupBy("g").agg(F.sum("size").alias("tokens")).withColumn("one", F.lit(1))
    ranked = prefix_sums(sources, [F.col("g")], ["one"])
    turn = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before_one") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.select("g", "tokens", turn.cast("long").alias("w"), (F.col("tokens") * CAP).alias("ceiling"))
    ranked = saved(ranked.withColumn("full_at", F.col("ceiling") / F.col("w")), "sources")
    sums = ranked.agg(F.sum("tokens").alias("t"), F.sum("w").alias("w"))
    level = prefix_sums(ranked.select("full_at", "w", "tokens"), [F.col("full_at")], ["w", "tokens"])
    level = level.withColumn(
        "level", (F.lit(SHARE) * sums.select("t").scalar() - CAP * F.col("before_tokens")) / (sums.select("w").scalar() - F.col("before_w"))
    ).where("level <= full_at").agg(F.min_by("level", F.struct("full_at", "level")).alias("level"))
    return saved(
        ranked.select("g", "tokens", F.least(F.col("ceiling"), F.col("w") * F.coalesce(level.scalar(), F.lit(float("inf")))).alias("target")), "targets"
    )


def balanced_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, size, n, target, source_size, rate) from ``sizes`` (g, size, n) and ``targets`` (g, tokens, target)."""
    means = sizes.where("size > 0").groupBy("g").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    state = targets.join(means, "g", "left").select("g", "tokens", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"))
    sizes = saved(sizes, "sizes")
    full = F.col("target") >= CAP * F.col("tokens") * (1 - 1e-12)  # every rate is 2, at any multiplier beyond
    x = F.col("size") / F.col("mean")  # in units of the source's mean, so that multipliers are near 1
    tilt = lambda lam: F.exp(F.least(lam * x, F.lit(700.0)))
    for _ in range(STEPS):
        state = saved(state, "dual")
        rate = tilt(F.col("lam"))
        met = sizes.where("size > 0").join(state.where(~full & (F.col("target") > 0)), "g").groupBy("g").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(CAP))).alias("f"),
            F.sum(F.when(rate < CAP, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        state = saved(state.join(met, "g", "left"), "step")
        worst = state.agg(F.max(F.abs(F.col("f") / F.col("target") - 1))).first()[0]
        if worst is None or worst <= CLOSE:
            break
        over = F.col("f") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(F.col("f") - F.col("target"), F.col("slope"))
        ok = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step) < 1e6)
        safe = F.when(lo.isNull(), hi - 1 - F.abs(hi)).when(hi.isNull(), lo + 1 + F.abs(lo)).otherwise((lo + hi) / 2)
        moved = F.when(F.col("f").isNull(), F.col("lam")).when(ok, step).otherwise(safe)
        state = state.select("g", "tokens", "target", "mean", moved.alias("lam"), lo.alias("lo"), hi.alias("hi"))
    solved = state.select("g", "tokens", "target", "mean", "lam")
    rate = F.when((F.col("target") <= 0) | (F.col("size") <= 0), 0.0).when(full, CAP).otherwise(F.least(tilt(F.col("lam")), F.lit(CAP)))
    return saved(sizes.join(solved, "g").select("g", "size", "n", "target", F.col("tokens").alias("source_size"), rate.alias("rate")), "rates")


def rounded_copies(units: DataFrame, rates: DataFrame) -> DataFrame:
    """``units`` (row, h, g, size, ...) with target, source_size and the whole number of copies."""
    part = F.col("rate") - F.floor("rate")
    falling = Window.partitionBy("g").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per size
    starts = rates.select("g", "size", "target", "source_size", "rate", F.coalesce(F.sum(F.col("n") * part).over(falling), F.lit(0.0)).alias("start"))
    spread = units.withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    cells = spread.groupBy("g", "size", "slice").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("g", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("g", "size", "slice", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("first")).join(starts, ["g", "size"])
    ranked = spread.withColumn("k", F.row_number().over(Window.partitionBy("g", "size", "slice").orderBy("h", "row")))
    ranked = salted_join(saved(ranked, "ranked"), cells, ["g", "size", "slice"], "row")
    at = F.col("first") + F.col("k")
    extra = F.floor(F.col("start") + at * part + 0.5) - F.floor(F.col("start") + (at - 1) * part + 0.5)
    copies = F.when(F.col("rate") > 0, F.floor("rate") + extra).otherwise(0).cast("long")
    now = saved(ranked.withColumn("copies", copies).drop("first", "k", "rate", "slice", "start"), "copies")
    while True:
        gap = now.groupBy("g").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        able = salted_join(now, gap, ["g"], "row").where(
            (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap"))
            & F.when(F.col("gap") > 0, F.col("copies") < int(CAP)).otherwise(F.col("copies") > 0)
        )
        best = F.min(F.struct(F.abs(F.col("size") - F.abs("gap")).alias("off"), "h", "row", F.signum("gap").alias("step")))
        change = saved(able.groupBy("g").agg(best.alias("x")).select("x.row", F.col("x.step").cast("long").alias("step")), "change")
        if change.isEmpty():
            return now
        now = saved(now.join(change, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step"), "copies")


def mix_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: dict | None = None) -> DataFrame:
    """(row, doc_id, g, size, source_size, target, copies, ...) of every row; ``extra`` adds columns computed from ``docs``."""
    group = F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("w"))  # the null source sorts last
    units = docs.select(
        F.col(id_col).alias("doc_id"), group.alias("g"), word_count(whole_text(text_col)).alias("size"),
        F.xxhash64(F.col(id_col)).alias("h"), *[c.alias(k) for k, c in (extra or {}).items()],
    )
    units = saved(units.withColumn("row", F.monotonically_increasing_id()), "units")
    sizes = units.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n"))
    return rounded_copies(units, balanced_rates(sizes, source_targets(units)))


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    """Contract query; ``copies`` tells how often the mix repeats the document."""
    return mix_units(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or 2 times).

    Rows are matched by a digest of all their columns. Equal rows are one unit with the sum of their copies, so they are exchangeable.
    """
    units = mix_units(docs, id_col, text_col, source_col, {"digest": row_digest(docs)})
    copies = units.groupBy("digest").agg(F.sum("copies").alias("copies")).where("copies > 0").select(F.col("digest").alias("_digest"), F.col("copies").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_digest(docs).alias("_digest"))
    # a row without words is not taken by any target; it has no tokens to mix
    once = rows.join(copies, "_digest").dropDuplicates(["_digest"])
    return once.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_doc.*")
