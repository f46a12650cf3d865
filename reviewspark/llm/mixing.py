"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the number of times the mix takes it. Among all rates between 0 and `cap` that give each source
its target of words, entropy balancing takes those closest (in relative entropy) to taking every document once. They have
the form min(cap, exp(lambda * z)), z being the document's size over its source's size-weighted mean; the multiplier
lambda of a source solves one equation, the derivative of the convex dual, by safeguarded Newton steps. All documents of a
source and size have one rate, so Newton runs on counts per (source, size), aggregated once; all sources take their steps
together in one small job per step.

Rates become whole copies by systematic rounding along (source, size): the running sum of rates is rounded, and a document
takes what its rate adds to it. Sizes ascend along the sum, so the words taken differ from the target by less than the
longest document of the source; of `OFFSETS` starting points of the sum each source uses the one that comes nearest. Places
within a source and size follow a hash of the id and come from one range exchange, so a group of copies, of repeated ids or
of rows without id that holds a third of all rows is spread over many tasks.

Sums that decide are exact (decimals, integers), so reruns agree in any partitioning.

Defined results: null or empty text has size 0, is never taken and counts for nothing; null is a source of its own, last;
repeated rows are documents of their own; an empty table gives an empty table; a source whose target is its cap is taken
`cap` times whole; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import numbered, packed, saved, unpacked

WORD = r"[^\x20\x09-\x0D]+"
OFFSETS = 64
STEPS = 60
UNIT = 1_000_000_000  # rates are kept in billionths


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: source_no (from 0), source_size, target. ``sizes``: source, size, n. One row per source is windowed."""
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size") * F.col("size") * F.col("n")).cast("double").alias("squares"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("source_no", number)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = totals.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")))
    totals = totals.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # sources fill up in the order of cap over weight: one is full if the level at its turn reaches its cap
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / weights_left
    totals = totals.withColumn("level", level).withColumn("open", F.col("most") / F.col("weight") > F.col("level"))
    common = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything)
    target = F.when(F.col("open") & common.isNotNull(), F.col("weight") * common).otherwise(F.col("most"))
    return totals.select("source", "source_no", "source_size", "squares", target.alias("target"))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def multipliers(sizes: DataFrame, sources: DataFrame, cap: float, steps: int = STEPS, tolerance: float = 1e-10) -> DataFrame:
    """Per source: scale and lambda. ``sizes``: source_no, size, n (positive sizes); ``sources``: source_no, source_size, squares, target."""
    log_cap = F.log(F.lit(float(cap)))
    state = sources.where("source_size > 0").select("source_no", "source_size", "target", (F.col("squares") / F.col("source_size")).alias("scale"))
    state = state.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12))
    # at `high` every size reaches the cap; at `low` even the shortest documents give too little
    state = state.withColumn("high", log_cap * F.col("scale"))
    state = state.withColumn("low", -(F.abs(F.log(F.col("source_size") / F.col("target"))) + 1) * F.col("scale"))
    state = state.withColumn("lam", F.when(F.col("full"), F.col("high")).otherwise(F.lit(0.0))).withColumn("gap", F.lit(1.0))
    state = checkpoint(state)
    for _ in range(steps):
        z = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * z))
        joined = sizes.join(state.where(~F.col("full")), "source_no")
        terms = joined.groupBy("source_no").agg(
            _exact(F.col("n") * z * rate).alias("words"),
            _exact(F.when(rate < float(cap), F.col("n") * z * z * rate).otherwise(F.lit(0.0))).alias("slope"),
        )
        moved = state.join(terms, "source_no", "left")
        gap = F.col("words") - F.col("target") / F.col("scale")
        moved = moved.withColumn("gap", F.coalesce(gap * F.col("scale") / F.col("target"), F.lit(0.0)))
        moved = moved.withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high")))
        moved = moved.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")))
        step = F.col("lam") - (F.col("gap") * F.col("target") / F.col("scale")) / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        next_lam = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("full") | (F.abs("gap") <= tolerance)
        moved = moved.withColumn("lam", F.when(done, F.col("lam")).otherwise(next_lam))
        state = checkpoint(moved.select(*state.columns))
        if not state.where(~F.col("full") & (F.abs("gap") > tolerance)).take(1):
            break
    return state.select("source_no", "scale", "lam", "full")


def _offsets(bins: DataFrame) -> DataFrame:
    """Per source the start of the running sum whose rounding takes the words nearest to the target."""
    half = UNIT // (2 * OFFSETS)
    tried = bins.withColumn("offset", F.explode(F.sequence(F.lit(half), F.lit(UNIT - half), F.lit(2 * half))))
    words = F.expr(f"size * ((before + n * rate + offset) div {UNIT} - (before + offset) div {UNIT})")
    totals = tried.groupBy("source_no", "offset", "target").agg(F.sum(words).alias("words"))
    best = F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "offset"))
    return totals.groupBy("source_no").agg(best.alias("best")).select("source_no", F.col("best.offset").alias("offset"))


def _copies(narrow: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds source_size, target and copies. ``narrow``: row_no, id, source, size, already written."""
    counts = saved(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = checkpoint(source_targets(counts, weights, share, cap))
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    listed = checkpoint(counts.alias("c").join(sources.alias("s"), same).select("s.source_no", "c.source", "size", "n"))
    solved = multipliers(listed.where("size > 0").select("source_no", "size", "n"), sources, cap)
    rated = listed.join(solved, "source_no", "left")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    rated = rated.withColumn("rate", F.round(rate * UNIT).cast("bigint"))
    along = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    bins = rated.withColumn("before", F.coalesce(F.sum((F.col("n") * F.col("rate")) % UNIT).over(along), F.lit(0)) % UNIT)
    bins = bins.join(sources.select("source_no", "source_size", "target"), "source_no")
    bins = checkpoint(bins.select("source", "source_no", "size", "n", "rate", "before", "source_size", "target"))
    bins = bins.join(_offsets(bins), "source_no")
    same = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.size") == F.col("b.size"))
    placed = narrow.alias("d").join(bins.alias("b"), same).select("d.id", "d.row_no", F.xxhash64("d.id").alias("draw"), "b.source_no", "d.size", "rate", "before", "offset", "source_size", "target")
    # row numbers only tell rows of one id apart, whichever of them is taken
    ranked = numbered(placed, ["source_no", "size"], ["draw", "id", "row_no"], "mix-places")
    upto = lambda pos: F.expr(f"(before + {pos} * rate + offset) div {UNIT}")
    copies = (upto("(pos + 1)") - upto("pos")).cast("bigint")
    ranked = ranked.withColumn("copies", copies)
    return ranked.select("row_no", "id", "size", "source_size", F.col("target").cast("double").alias("target"), "copies")


def _sizes(id_col: str, source_col: str, text_col: str) -> list[Column]:
    return [
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"), F.monotonically_increasing_id().alias("row_no"),
    ]


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), copies, taken."""
    ranked = _copies(saved(docs.select(*_sizes(id_col, source_col, text_col)), "mix-sizes"), weights, share, cap)
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixed corpus: every row as often as its copies. Rows are told apart by number, so ids may repeat or be null."""
    rows = saved(packed(docs, *_sizes(id_col, source_col, text_col), text_col=text_col), "mix-rows")
    plan = _copies(rows.select("row_no", "id", "source", "size"), weights, share, cap).where("copies > 0").select("row_no", "copies")
    again = rows.join(plan, "row_no").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(again, docs.columns, text_col)
