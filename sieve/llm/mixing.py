"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

A source's budget is met by complete epochs of all its documents first; the rest is sampled without replacement:
each document draws the key -ln(u) / w, with u from a hash of the seed and its id and w its quality weight, and documents are taken
by rising key until their words fill what is left of the budget.

Since everything before one key is taken and nothing after it, all that must be found for a source is that key. Words are summed
by key bucket, a prefix sum over the buckets (a bounded number for each source) finds the bucket the budget ends in, and only that
bucket's documents are sorted. Documents then need no shuffle: each is compared with its source's cut, a broadcast row.

Cases: a null text has size 0; a null source is a source of its own, the last one; a document with a null id is keyed by its text;
rows that repeat both id and text share one key and are cut together, in equal parts; an empty table gives an empty result; other columns pass through
``mix`` untouched, unless they have the name of one it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for, join_staged, stage

#: Sources are configured by name and weight; more than this is taken for a wrong column.
MAX_SOURCES = 100_000
#: The columns mix() adds; columns of the input with these names are replaced (``mixed_documents`` keeps them).
OWN = ("size", "source_size", "target", "taken", "copies")
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by label: documents marked good are drawn as if twice, those marked bad as if half; the rest once.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """id and ``__mx_w``, one row per labelled document (the best label where one is labelled twice)."""
    best = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__mx_id")).agg(F.max(quality_col).alias("q"))
    return best.select("__mx_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(UNKNOWN).alias("__mx_w"))


def _keyed(docs: DataFrame, weights: DataFrame | None, seed: int) -> DataFrame:
    """All columns and: __mx_size, __mx_key, __mx_tie. What depends on the text is computed before the join with the weights, so a
    result that leaves the text out does not shuffle it."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), ident).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    rows = docs.select("*", word_count("text").alias("__mx_size"), F.col("doc_id").alias("__mx_id"),
                       F.xxhash64("doc_id", "text").alias("__mx_tie"), (-F.log(unit)).alias("__mx_draw"))
    rows = join_staged(rows, weights, ["__mx_id"]) if weights is not None else rows.withColumn("__mx_w", F.lit(UNKNOWN))
    weight = F.coalesce(F.col("__mx_w"), F.lit(UNKNOWN))
    return rows.withColumn("__mx_key", F.col("__mx_draw") / weight).drop("__mx_id", "__mx_w", "__mx_draw")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources share the budget by weight, none above ``most`` times its size: there is one level at which the targets
    min(cap, level * weight) use up the budget, found by a running sum over sources ordered by cap / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
                       F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("capped"),
                       F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_left"))
    level = (F.col("budget") - F.col("capped")) / F.col("w_left")
    rows = rows.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("cap"), level)).over(whole))
    # No level at all: the budget exceeds all caps.
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix_cuts(keyed: DataFrame, source_weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source: source, source_size, target, epochs, and the cut: key, tie, words taken of it, its size."""
    units = stage(keyed.groupBy("source", F.col("__mx_key").alias("key"), F.col("__mx_tie").alias("tie"))
                  .agg(F.sum("__mx_size").alias("size")), "mix-units")
    sources = stage(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.max("key").alias("top")),
                    "mix-sources")
    found = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n"), F.max("top").alias("top")).first()
    if found["sources"] > MAX_SOURCES:
        raise ValueError(f"{found['sources']} sources; at most {MAX_SOURCES}")
    targets = source_targets(sources.select("source", "source_size"), source_weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = stage(targets.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")
    n = buckets_for(found["n"] or 0)
    # exp(-key * BAD) falls evenly enough with the key for all weights from BAD up: the fullest bucket has GOOD / BAD times the mean.
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.lit(BAD))) * n), F.lit(n - 1))
    units = units.withColumn("b", bucket)
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = units.groupBy("source", "b").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    small = F.broadcast(targets.select(F.col("source").alias("s"), "left"))
    ends = (sums.join(small, F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).select("s", "b", "before", "left"))
    inside = units.join(F.broadcast(ends.withColumnRenamed("b", "eb")), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("eb")))
    run = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    cut = inside.where((F.col("at") < F.col("left")) & (F.col("at") + F.col("size") >= F.col("left")))
    cut = cut.select("s", F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie"), (F.col("left") - F.col("at")).alias("cut_words"),
                     F.col("size").alias("cut_size"))
    return stage(targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"), "mix-cuts")


def mix(docs: DataFrame, *, quality: DataFrame | None = None, source_weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
        most: float = 2.0, seed: int = 11, cut: str = "words", read_text: bool = True) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source and any others) with ``size``, ``source_size``, ``target``, ``taken`` (words) and
    ``copies`` (whole documents taken).

    cut: ``words`` takes of the last document of a source just the words still due; ``documents`` takes it whole or not at all,
    whichever ends nearer the budget. Without ``read_text`` the result leaves out ``text``."""
    keep = [c for c in docs.columns if c.lower() not in OWN]
    weights = stage(quality_weights(quality), "mix-weights") if quality is not None else None
    rows = docs.select(*keep)
    if not read_text:
        keep = [c for c in keep if c != "text"]
        keyed = rows = stage(_keyed(rows, weights, seed).select(*keep, "__mx_size", "__mx_key", "__mx_tie"), "mix-keyed")
    else:
        rows = _keyed(rows, weights, seed)
        keyed = rows.select("source", "__mx_size", "__mx_key", "__mx_tie")
    cuts = mix_cuts(keyed, source_weights, share, most)
    cuts = F.broadcast(cuts.select(*[F.col(c).alias(f"__mx_{c}") for c in cuts.columns]))
    at, cut_at = F.struct("__mx_key", "__mx_tie"), F.struct(F.col("__mx_cut_key"), F.col("__mx_cut_tie"))
    words = F.floor(F.col("__mx_cut_words") * F.col("__mx_size") / F.col("__mx_cut_size"))
    whole = F.col("__mx_cut_words") * 2 >= F.col("__mx_cut_size")
    if cut == "documents":
        words = F.when(whole, F.col("__mx_size")).otherwise(F.lit(0))
    some = F.col("__mx_cut_key").isNotNull()
    part = F.when(some & (at < cut_at), F.col("__mx_size")).when(some & (at == cut_at), words).otherwise(F.lit(0))
    once = F.when(some & ((at < cut_at) | ((at == cut_at) & whole)), 1).otherwise(0)
    return (rows.join(cuts, F.col("source").eqNullSafe(F.col("__mx_source")))
            .select(*keep, F.col("__mx_size").alias("size"), F.col("__mx_source_size").alias("source_size"), F.col("__mx_target").alias("target"),
                    (F.col("__mx_epochs") * F.col("__mx_size") + part).cast("long").alias("taken"),
                    (F.col("__mx_epochs") + once).cast("int").alias("copies")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it is taken, whole, with the columns of ``docs``."""
    aside = {c: f"__mx_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in OWN}
    taken = mix(docs.withColumnsRenamed(aside), cut="documents", **options).where(F.col("copies") > 0)
    copied = taken.withColumn("__mx_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
