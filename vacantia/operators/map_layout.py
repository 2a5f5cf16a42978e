"""Postings stored along a space-filling curve, so that a box of the map reads few files."""

from pyspark.sql import functions as F

from vacantia.operators import order_index
from vacantia.operators.facets import in_viewport

#: Bits of either coordinate in the code: cells of some 20 by 10 metres at the equator.
BITS = 21


def _spread(x):
    """Bits of ``x`` with a free bit after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(lat, lng):
    """Code whose order keeps near points near: bits of latitude and longitude in turn; null without a point."""
    def cell(value, low, span):
        part = F.floor((value - low) / span * (1 << BITS)).cast("bigint")
        return F.when(part.isNotNull(), F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), part)))

    return F.shiftleft(_spread(cell(lat, -90, 180)), 1).bitwiseOR(_spread(cell(lng, -180, 360)))


def write_map(postings, path, ties=("url",), rows=order_index.RANGE_ROWS):
    """Store the postings that have a point in the order of the curve; the index has each range's box."""
    placed = postings.filter("coords IS NOT NULL").withColumn("_code", morton(F.col("coords.lat"), F.col("coords.lng")))
    lat, lng = F.col("coords.lat"), F.col("coords.lng")
    order_index.write_order(
        placed, ["_code", *ties], path, rows,
        stats={"south": F.min(lat), "north": F.max(lat), "west": F.min(lng), "east": F.max(lng)})


def viewport(spark, path, schema, south, west, north, east):
    """Stored postings inside the box; only ranges whose own box meets it are read, then every point is tested."""
    index = spark.read.parquet(f"{path}/index")
    meets = (F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west)
    ranges = [r["_range"] for r in index.filter(meets).select("_range").collect()]
    return order_index.read_ranges(spark, path, schema, ranges).filter(in_viewport(south, west, north, east))
