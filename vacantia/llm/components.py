"""Connected components by local contraction."""

from pyspark.sql import functions as F

from vacantia.llm.shared import stored
from vacantia.operators.joins import lookup_join


def components(links):
    """Root of every node of ``links`` (columns u, v of one orderable type): node, root.

    Each round every node moves to the first node of its closed neighbourhood, first by the
    nodes' own order (which settles stars at once), then by an order that a hash deals anew.
    Links between nodes that moved together vanish, so the number of nodes falls by a
    constant factor a round. A hub's links are reduced inside the map tasks and joined by a
    shuffle that can be split; links stay in stored tables, never on the driver.
    """
    links = stored(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    moves, turn = [], 0
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select("v", "u"))
        key = lambda c, turn=turn: F.struct((F.xxhash64(F.lit(turn), c) if turn else F.lit(0)).alias("h"), F.col(c).alias("n"))
        first = both.groupBy("u").agg(F.min(key("v")).alias("m"))
        move = stored(first.select(F.col("u").alias("node"), F.least(key("u"), F.col("m"))["n"].alias("root")))
        moves.append(move)
        for end in ("u", "v"):
            links = lookup_join(links, move.withColumnRenamed("node", end), end, "inner").drop(end).withColumnRenamed("root", end)
        links = stored(
            links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        turn += 1
    if not moves:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = lookup_join(out, step, "root").select("node", F.coalesce("next", "root").alias("root"))
    return stored(out)
