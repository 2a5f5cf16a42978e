"""Mixing sources to target weights by Pareto order sampling (operator 1)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.llm.shared import ready, stored, word_count

#: Bits of the sampling order that one refinement looks at.
BITS = 10
#: A document's copies, and a source's target, at most this many times its size.
MOST = 3
SEED = "mix-1"


def source_targets(sizes, weights=(1, 2, 3), share=1.0, most=MOST):
    """Target words per source: source, n_docs, source_size, weight, target.

    ``sizes`` has source and size. Sources in code point order (null last) take the weights
    in turn; together they get ``share`` of all words in proportion to their weights. No
    target exceeds ``most`` times the source's size: what exceeds it goes to the others by
    weight until none is above. The level at which this settles is found by sorting the
    sources by the level they can bear; the two windows see one row per source.
    """
    table = sizes.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("source_size"), F.sum("preferred").alias("preferred_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("bigint")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumn("weight", weight).withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
        "open": F.sum("weight").over(after),
    })
    # a source is full if the level reached when all before it are full is more than it bears
    capped = F.col("source_size") * most * F.col("open") <= (F.col("total") - F.col("full")) * F.col("weight")
    table = table.withColumn("capped", capped)
    left = table.agg(
        (F.first("total") - F.sum(F.when(F.col("capped"), F.col("source_size") * most).otherwise(0))).alias("left_words"),
        F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).alias("left_weight"))
    # one row joins: the totals over all sources
    target = F.when(F.col("capped"), F.col("source_size").cast("double") * most).otherwise(
        F.col("left_words") * F.col("weight") / F.col("left_weight"))
    return table.join(F.broadcast(left), F.lit(True)).select(
        "source", "n_docs", "source_size", "preferred_size", "weight", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def _uniform(*cols):
    """A number in (0, 1) from 52 bits of an MD5, the same in every run."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def with_copies(docs, weights=(1, 2, 3), share=1.0, id_col="doc_id", text_col="text", source_col="source"):
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Every document is first taken floor(target / source_size) times for certain. The rest of
    a source's target is a fixed-size sample without replacement with unequal probabilities:
    each document's inclusion probability is proportional to 1 + floor(sqrt(size)), and
    documents are ranked by the odds of a random number divided by the odds of inclusion
    (Pareto order). Documents are taken in that order until the words come nearest to the
    target, so a source misses its target by at most half of one document (or of one group
    of rows that agree in id, source and size, which are taken together).

    The cut in the order is found by counting, not by sorting a source in one task: words
    are summed per source and leading bits of the order, the slot that holds the cut is
    refined three times, and ties at the end stay together. So a source with a third of
    all rows is spread like any other, and what is gathered is bounded by 2 ** BITS slots
    per source.

    Null or blank texts have size 0 and taken 0; null sources form a source of their own; a
    null id is a value like others; an empty table gives no rows; extra columns are ignored.
    """
    ready(docs)
    size = word_count(F.col(text_col).cast("string"))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = stored(rows.withColumn("preference", F.floor(F.sqrt("size")) + 1).withColumn(
        "preferred", F.col("preference") * F.col("size")))
    targets = source_targets(rows, weights, share)
    whole = F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("bigint"))
    targets = stored(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of_source"))
    chance = F.col("rest") * F.col("preference") / F.col("preferred_size")
    chance = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.coalesce(chance, F.lit(0.5))))
    u = _uniform("doc_id", "source", "size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    # odds / (1 + odds) grows with the odds: its first 3 * BITS bits give the slots
    place = F.floor(odds / (1 + odds) * float(1 << 3 * BITS)).cast("bigint")
    ranked = stored(
        rows.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("of_source")))
        .select(*rows.columns, "source_size", "target", "whole", "rest", odds.alias("odds"),
                F.least(place, F.lit((1 << 3 * BITS) - 1)).alias("place")))
    cut = _cuts(ranked.filter("size > 0"))
    chosen = F.struct("place", "odds") <= F.struct("cut_place", "cut_odds")
    copies = F.col("whole") + F.when(F.coalesce(chosen, F.lit(False)) & (F.col("size") > 0), 1).otherwise(0)
    return (
        ranked.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "size", "source", "source_size", "target", "taken", "copies"))


def _cuts(ranked):
    """Last (place, odds) that each source takes: one row per source that takes any."""
    inside, at = ranked.withColumn("words_before", F.lit(0).cast("bigint")), None
    for step in (2, 1, 0):
        inside = inside.withColumn("slot", F.shiftright("place", step * BITS))
        at = _slot_of_cut(inside, ["slot"]).select(
            F.col("source").alias("at_source"), F.col("slot").alias("at_slot"), F.col("before").alias("at_before"))
        # the slots of a source are at most 2 ** BITS, and one row per source is kept
        inside = inside.join(F.broadcast(at), F.col("source").eqNullSafe(F.col("at_source")) & (F.col("slot") == F.col("at_slot"))).withColumn(
            "words_before", F.col("at_before")).drop("at_source", "at_slot", "at_before", "slot")
    # what is left shares 30 bits of the order: single documents and their ties
    groups = inside.groupBy("source", "place", "odds", "rest", "words_before").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("place", "odds")
    upto = F.col("words_before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a group is taken while half of it still lies before the target
    groups = groups.withColumn("taken", upto - F.col("words") / 2 <= F.col("rest"))
    first_left = Window.partitionBy("source").orderBy("place", "odds").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("all_taken", F.min(F.col("taken").cast("int")).over(first_left))
    last = groups.filter("all_taken = 1").groupBy("source").agg(F.max(F.struct("place", "odds")).alias("last"))
    start = at.select(
        F.col("at_source").alias("cut_source"), (F.col("at_slot") - 1).alias("place_before"))
    return start.join(last, F.col("cut_source").eqNullSafe(F.col("source")), "left").select(
        "cut_source", F.coalesce("last.place", "place_before").alias("cut_place"),
        F.coalesce("last.odds", F.lit(float("inf"))).alias("cut_odds"))


def _slot_of_cut(rows, by):
    """Per source the first slot whose words reach the target (else the last), and the words before it."""
    slots = rows.groupBy("source", "rest", "words_before", *by).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(*by)
    upto = F.col("words_before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    reached = F.when(F.col("upto") >= F.col("rest"), F.struct(F.lit(0).alias("o"), F.col(by[0]).alias("s")))
    key = F.coalesce(reached, F.struct(F.lit(1).alias("o"), (-F.col(by[0])).alias("s")))
    return slots.groupBy("source").agg(F.min_by(F.struct(*by, "before"), key).alias("m")).select("source", "m.*")


def mix(docs, id_col="doc_id", text_col="text", source_col="source", **options):
    """The mixed documents themselves: every row as often as the mix takes it, all columns kept.

    Rows that agree in id, source and size are taken equally often.
    """
    keys = [F.col(id_col).cast("bigint"), F.col(source_col).cast("string"), word_count(F.col(text_col).cast("string"))]
    taken = with_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    key = lambda cols: F.xxhash64(*cols)
    left = docs.select(F.struct("*").alias("_row"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    left = left.withColumn("_h", key(["_k0", "_k1", "_k2"]))
    right = taken.withColumn("_h2", key(["doc_id", "source", "size"]))
    same = (F.col("_h") == F.col("_h2")) & F.col("_k0").eqNullSafe(F.col("doc_id")) & F.col("_k1").eqNullSafe(
        F.col("source")) & (F.col("_k2") == F.col("size"))
    return left.join(right, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")
