"""Hard negatives by exact integer scores from a residue-number-system product (operator 11)."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.llm.shared import ready, stored
from vacantia.llm.vectors import components_of, matrix
from vacantia.operators.joins import lookup_join

#: Moduli: primes below 256, whose centred residues are at most 125. Fixed values.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
#: Products of 1,024 centred residues add up to less than 2 ** 24, exact in float32.
INNER = 1024
#: Anchors and rows of a tile of scores.
TILE, ROWS = 256, 4096
#: Components on either side of a cell: 65,536 vectors of 64 components.
CELL = 1 << 22
#: Rows that are worth a slice of their own on a small table.
LEAST_SLICE = 1024
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def moduli(bound):
    """The first primes whose product exceeds four times ``bound``."""
    for n in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:n]) > 4 * bound:
            return PRIMES[:n]
    raise ValueError(f"scores up to {bound} need more primes")


def residues(numbers, primes):
    """Centred residues of whole numbers, one float32 matrix a prime."""
    out = []
    for prime in primes:
        rest = np.mod(numbers, prime)
        out.append(np.where(rest > prime // 2, rest - prime, rest).astype(np.float32))
    return out


def exact_scores(left, right, primes):
    """Inner products (int64) of two sets of vectors given by their ``residues``.

    A float32 product of at most ``INNER`` components is exact for each prime. Chinese
    remaindering by mixed-radix digits puts them together; as scores fill less than a
    quarter of the range on either side of 0, the leading digit tells the sign.
    """
    digits = []
    for prime, a, b in zip(primes, left, right):
        digit = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], INNER):
            digit += (a[:, at : at + INNER] @ b[:, at : at + INNER].T).astype(np.int64)
        for smaller, before in zip(primes, digits):
            digit = (digit - before) * pow(smaller, -1, prime) % prime
        digits.append(digit % prime)
    score = digits[-1]
    for prime, digit in zip(primes[-2::-1], digits[-2::-1]):
        score = score * prime + digit  # may run over, and runs back by the next line
    whole = math.prod(primes)
    over = (whole + (1 << 63)) % (1 << 64) - (1 << 63)
    return np.where(2 * digits[-1] > primes[-1], score - np.int64(over), score)


def part_of(scores, percent):
    """floor(percent * score / 100) without running over."""
    return percent * (scores // 100) + percent * (scores % 100) // 100


class Cell:
    """The anchors of a cell and the best rows of each of their windows so far.

    ``low`` and ``high`` (anchors x windows) bound the scores that count. Rows must come in
    the order that decides ties.
    """

    def __init__(self, rows, labels, vectors, low, high, best, same):
        self.rows, self.labels, self.low, self.high, self.best, self.same = rows, labels, low, high, best, same
        self.vectors, self.primes = vectors, ()
        self.norm = math.sqrt(float((vectors.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self.score = np.full((*low.shape, best), LOWEST)
        self.id = np.zeros((*low.shape, best), np.int64)
        self.known = np.zeros((*low.shape, best), bool)  # the row has an id

    def add(self, rows, labels, vectors, ids, known):
        width = min(vectors.shape[1], self.vectors.shape[1])
        norm = math.sqrt(float((vectors.astype(np.float64) ** 2).sum(1).max(initial=0)))
        primes = moduli(int(self.norm * norm * (1 + 1e-9)) + 1)
        if len(primes) > len(self.primes):
            self.primes, self.left = primes, residues(self.vectors, primes)
        right = residues(vectors[:, :width], primes)
        for a in range(0, len(self.rows), TILE):
            b = min(a + TILE, len(self.rows))
            scores = exact_scores([m[a:b, :width] for m in self.left[: len(primes)]], right, primes)
            allowed = (self.labels[a:b, None] == labels) == self.same
            if self.same:
                allowed &= self.rows[a:b, None] != rows
            for window in range(self.low.shape[1]):
                least = np.maximum(self.low[a:b, window], self.score[a:b, window, -1] + 1)
                hit, column = np.nonzero(allowed & (scores >= least[:, None]) & (scores <= self.high[a:b, window, None]))
                if len(hit):
                    self._merge(window, hit + a, scores[hit, column], ids[column], known[column])

    def _merge(self, window, anchor, score, row_id, known):
        touched = np.unique(anchor)
        old = np.repeat(touched, self.best)
        anchor = np.append(old, anchor)
        score = np.append(self.score[touched, window].ravel(), score)
        row_id = np.append(self.id[touched, window].ravel(), row_id)
        known = np.append(self.known[touched, window].ravel(), known)
        order = np.lexsort((-1 - score, anchor))  # stable: earlier rows win ties
        first = np.searchsorted(anchor[order], anchor[order])
        place = np.arange(len(order)) - first
        order, place = order[place < self.best], place[place < self.best]
        self.score[anchor[order], window, place] = score[order]
        self.id[anchor[order], window, place] = row_id[order]
        self.known[anchor[order], window, place] = known[order]

    def found(self):
        """Anchor, window, row id (0 where unknown), has id, score of every row kept."""
        anchor, window, place = np.nonzero(self.score > LOWEST)
        return anchor, window, self.id[anchor, window, place], self.known[anchor, window, place], self.score[anchor, window, place]


def _dealt(anchors, rows, groups, slices):
    """Anchors and rows of every cell together: a cell meets a group of anchors and a slice of rows.

    Both sides carry ``part``. Each anchor goes to all slices and each row to all groups of
    its part, so what travels is the table once for every 65,536 anchors.
    """
    zero = F.lit(0).cast("bigint")
    left = anchors.select(
        "part", F.pmod(F.xxhash64("row"), groups).alias("g"), F.explode(F.sequence(zero, slices - 1)).alias("s"),
        F.lit(0).alias("kind"), "row", "vec_id", "label", "width", "parts", "found")
    right = rows.select(
        "part", F.explode(F.sequence(zero, groups - 1)).alias("g"), F.pmod(F.xxhash64("row", F.lit(1)), slices).alias("s"),
        F.lit(1).alias("kind"), "row", "vec_id", "label", "width", "parts", F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("found"))
    return left.unionByName(right).repartition("part", "g", "s").sortWithinPartitions(
        "part", "g", "s", "kind", F.col("vec_id").asc_nulls_last(), "row")


def _best(cells, best, same, low=None, high=None):
    """Per anchor and window of each cell the ``best`` rows: row, anchor_id, window, score and id of
    the positive that the window belongs to, row id and score.

    Without ``low`` and ``high`` an anchor has one window, open on both sides.
    """

    def started(held):
        columns = [[v for b in held for v in b.column(c).to_pylist()] for c in ("row", "vec_id", "label", "width", "parts", "found")]
        rows, ids, labels, widths, parts, found = columns
        found = [f or [] for f in found]
        if low is None:
            lows, highs = np.full((len(rows), 1), LOWEST), np.full((len(rows), 1), HIGHEST)
        else:
            n = max(map(len, found))
            lows, highs = np.full((len(rows), n), HIGHEST), np.full((len(rows), n), LOWEST)
            for k, some in enumerate(found):
                score = np.array([f["score"] for f in some], np.int64)
                lows[k, : len(some)], highs[k, : len(some)] = -part_of(-score, low), part_of(score, high)
        return Cell(np.array(rows), np.array(labels), matrix(widths, parts), lows, highs, best, same), rows, ids, found

    def add(cell, held):
        batch = pa.Table.from_batches(held)
        ids = batch["vec_id"]
        cell[0].add(batch["row"].to_numpy(), batch["label"].to_numpy(), matrix(batch["width"].to_pylist(), batch["parts"].to_pylist()),
                    ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy())

    def ended(cell):
        state, rows, ids, found = cell
        anchor, window, row_id, known, score = state.found()
        of = [found[a][w] if low is not None else {"id": None, "score": None} for a, w in zip(anchor.tolist(), window.tolist())]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[a] for a in anchor.tolist()], pa.int64()), pa.array([ids[a] for a in anchor.tolist()], pa.int64()),
            pa.array(window, pa.int32()), pa.array([f["id"] for f in of], pa.int64()), pa.array([f["score"] for f in of], pa.int64()),
            pa.array(row_id, pa.int64(), mask=~known), pa.array(score, pa.int64())],
            ["row", "anchor_id", "window", "positive_id", "positive_score", "id", "score"])

    def run(batches):
        key, cell, anchors, held, size = None, None, [], [], 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "g", "s", "kind")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                piece, now = batch.slice(i, j - i), tuple(keys[i, :3].tolist())
                if now != key:
                    if held:
                        add(cell, held)
                    if cell:
                        yield ended(cell)
                    key, cell, anchors, held, size = now, None, [], [], 0
                if keys[i, 3] == 0:
                    anchors.append(piece)
                    continue
                if cell is None:
                    if not anchors:
                        continue
                    cell = started(anchors)
                held.append(piece)
                size += j - i
                if size >= ROWS:
                    add(cell, held)
                    held, size = [], 0
        if held:
            add(cell, held)
        if cell:
            yield ended(cell)

    return cells.mapInArrow(
        run, "row bigint, anchor_id bigint, window int, positive_id bigint, positive_score bigint, id bigint, score bigint")


def _ranked(found, keys, best):
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= best)


def mine(vectors, every=50, positives=5, negatives=3, low=50, high=95, id_col="vec_id", label_col="label", vector_col="embedding"):
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, both scores.

    Anchors are the rows whose id ``every`` divides. A score is the inner product of the
    vectors' whole numbers floor(256 * x); higher scores come first, equal ones by the smaller
    id. The positives of an anchor are the first other rows of its label; the negatives of a
    positive are the first rows of another label with a score of ``low`` to ``high`` percent
    of the positive's.

    Scores come from one float32 matrix product for each of a few primes, put together
    exactly. Anchors meet rows in cells of a group of anchors and a slice of rows, both
    hashed, so a label that holds much of the table is cut like any other; positives are sought among
    the cells of one label only. A cell keeps the best rows of each window, and windows over
    anchors, limited inside the map tasks, make the final choice. All rows count: no cap.

    Rows with a null label, a null vector or null or non-finite components take no part, nor
    do vectors whose squared length in whole numbers reaches 2 ** 60, as scores must fit a
    long. Missing components of shorter vectors count as 0. A row without an id is no anchor
    and loses ties. Rows with equal ids, and repeated rows, are rows of their own. An empty
    table, or one without anchors, gives no rows; extra columns are ignored.
    """
    ready(vectors)
    rows = stored(
        components_of(vectors.filter(F.col(label_col).isNotNull()), id_col, label_col, vector_col)
        .withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max("width")).first()
    per_cell = max(1, CELL // max(1, width or 0))

    def sized(count, least=1):
        return F.greatest(F.lit(1), F.lit(least), F.ceil(count / per_cell)).cast("bigint")

    cut = max(1, min(spark.sparkContext.defaultParallelism, n // LEAST_SLICE))
    sizes = lookup_join(
        anchors.groupBy("label").agg(F.count("*").alias("anchors")), rows.groupBy("label").agg(F.count("*").alias("rows")), "label", "inner")
    sizes = stored(sizes.select("label", sized(F.col("anchors")).alias("groups"), sized(F.col("rows")).alias("slices")))
    of_label = lambda df: lookup_join(df, sizes, "label", "inner").withColumn("part", F.col("label"))
    none = F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("found")
    cells = _dealt(of_label(anchors.select("*", none)), of_label(rows), F.col("groups"), F.col("slices"))
    near = _ranked(_best(cells, positives, True), ["row"], positives)
    wanted = stored(near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("found")).select(
        "row", F.transform("found", lambda f: F.struct(f["score"].alias("score"), f["id"].alias("id"))).alias("found")))

    chosen = lookup_join(anchors, wanted, "row", "inner").withColumn("part", F.lit(0).cast("bigint"))
    cells = _dealt(
        chosen, rows.withColumn("part", F.lit(0).cast("bigint")), sized(F.lit(anchors.count())), sized(F.lit(n), cut))
    out = _ranked(_best(cells, negatives, False, low, high), ["row", "window"], negatives)
    return out.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
