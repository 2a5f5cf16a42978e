"""Sharding by proportional stratified interleaving (operator 8); DataFrame functions only."""

from pyspark.sql import functions as F

from vacantia.llm.shared import stored
from vacantia.operators.joins import lookup_join
from vacantia.operators.order import with_row_numbers

SEED = "shard-1"


def assign(docs, shards=24, id_col="doc_id", text_col="text", source_col="source"):
    """Shard and slot of every document: doc_id, source, size, text_crc32, shard, slot.

    Within each source rows are shuffled by a seeded MD5 of their id and ranked; rank r of n
    gets the fraction (2r + 1) / 2n. Sorted by fraction the sources interleave in proportion,
    and cutting that order into equal runs gives every shard the mixture of the whole, with
    row counts at most one apart. ``slot`` is the place in the shard, from 0.

    Both orders are sorted across the cluster in ranges that end in a number of the row's own, so
    a source, an id or wholly equal rows with much of the table are cut like any other rows.

    Null ids are shuffled as one more value, rows with equal ids are ordered by checksum and
    length of their texts; rows equal in all of that are interchangeable. Null sources form a
    source of their own; a null text has size 8 and checksum 0; an empty table gives no rows;
    extra columns are ignored. Texts are only measured and never travel, so a very long one
    costs its own scan.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(rows.withColumns({
        "shuffle": F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        "stratum": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "row": F.monotonically_increasing_id(),
    }))
    by_shuffle = ["shuffle", "text_crc32", "size", "row"]
    ordered = with_row_numbers(rows, ["stratum", *by_shuffle])
    strata = ordered.groupBy("stratum").agg(F.min("row_number").alias("first"), F.count("*").alias("in_source"))
    rank = F.col("row_number") - F.col("first")
    ranked = lookup_join(ordered, strata, "stratum").withColumn("fraction", (2 * rank + 1) / (2 * F.col("in_source")))
    ranked = stored(ranked.drop("row_number", "first", "in_source"))
    placed = with_row_numbers(ranked, ["fraction", F.col("source").asc_nulls_last(), *by_shuffle]).withColumnRenamed("row_number", "place")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return (
        placed.join(total, F.lit(True))
        # whole-number cuts: shard s starts at the first place p with p * shards >= s * total
        .withColumn("shard", F.expr(f"(place * {int(shards)}L) div total").cast("int"))
        .withColumn("slot", F.expr(f"place - (shard * total + {int(shards)}L - 1) div {int(shards)}L"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot"))
