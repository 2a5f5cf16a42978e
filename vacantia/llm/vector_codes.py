"""Vector code compression with Orchard's search in every codebook (operator 13)."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vacantia.llm.shared import ready, stored
from vacantia.llm.vectors import components_of, matrix
from vacantia.operators.joins import lookup_join

#: Squared length of a vector, so that squared distances and their sums of parts fit a long.
LARGEST = 1 << 58


class Codebook:
    """One part's entries, and for each of them all entries sorted by their distance from it."""

    def __init__(self, entries):
        self.entries = entries  # int64, one row an entry
        apart = entries[:, None] - entries[None]
        far = (apart * apart).sum(2)
        # lower indexes first among equally far ones; each list starts with entries at distance 0
        self.lists = np.argsort(far, axis=1, kind="stable")
        self.far = np.take_along_axis(far, self.lists, 1)
        self.by_first = np.argsort(entries[:, 0], kind="stable") if entries.shape[1] else np.arange(len(entries))

    def start(self, points):
        """The entry whose first component is the next one up: a cheap first guess."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64)
        at = np.searchsorted(self.entries[self.by_first, 0], points[:, 0])
        return self.by_first[np.minimum(at, len(self.entries) - 1)]

    def nearest(self, points):
        """Nearest entry of each point and its squared distance, the lower index at ties.

        Orchard's search, all points a step at a time: a point walks the list of its best
        entry so far, jumps to the list of every better one, computes no marked entry twice
        and stops where the list is beyond twice its distance (four times, squared): all that
        follows is farther than the best by the triangle inequality. Equality goes on, so that
        no tie is lost.
        """
        n = len(points)
        best = self.start(points)
        apart = points - self.entries[best]
        least = (apart * apart).sum(1)
        marked = np.zeros((n, len(self.entries)), bool)
        marked[np.arange(n), best] = True
        open_, at = np.arange(n), np.zeros(n, np.int64)
        while len(open_):
            own = best[open_]
            going = (at[open_] < len(self.entries)) & (self.far[own, np.minimum(at[open_], len(self.entries) - 1)] <= 4 * least[open_])
            open_, own = open_[going], own[going]
            entry = self.lists[own, at[open_]]
            at[open_] += 1
            new = ~marked[open_, entry]
            point, entry = open_[new], entry[new]
            marked[point, entry] = True
            apart = points[point] - self.entries[entry]
            distance = (apart * apart).sum(1)
            better = (distance < least[point]) | (distance == least[point]) & (entry < best[point])
            point = point[better]
            best[point], least[point], at[point] = entry[better], distance[better], 0
        return best, least


def _assigned(table, books, width):
    """Batches of (columns, codes, errors): the nearest entries of every part, parts side by side."""
    parts = len(books)

    def run(batches):
        made = [Codebook(entries) for entries in books]
        for batch in batches:
            numbers = matrix(batch["width"].to_pylist(), batch["parts"].to_pylist(), width * parts).astype(np.int64)
            codes, errors = np.zeros((len(numbers), parts), np.int64), np.zeros(len(numbers), np.int64)
            for k, book in enumerate(made):
                codes[:, k], far = book.nearest(numbers[:, k * width : (k + 1) * width])
                errors += far
            yield batch, numbers, codes, errors

    return run


def _moved(table, books, width):
    """Sums and counts of the parts of every entry: part, entry, place (-1 for the count), total."""
    assigned, parts, size = _assigned(table, books, width), len(books), len(books[0])

    def run(batches):
        total = np.zeros((parts, size, width + 1), np.int64)
        for _, numbers, codes, _ in assigned(batches):
            for k in range(parts):
                np.add.at(total[k, :, -1], codes[:, k], 1)
                np.add.at(total[k, :, :-1], codes[:, k], numbers[:, k * width : (k + 1) * width])
        part, entry = np.nonzero(total[:, :, -1])
        some = total[part, entry]
        place = np.tile(np.append(np.arange(width), -1), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()),
             pa.array(place, pa.int32()), pa.array(some.ravel())], ["part", "entry", "place", "total"])

    sums = table.select("width", "parts").mapInArrow(run, "part int, entry int, place int, total bigint")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def _coded(table, books, width):
    assigned = _assigned(table, books, width)

    def run(batches):
        for batch, _, codes, errors in assigned(batches):
            raw = codes.astype(np.uint8).tobytes().hex()
            size = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.string()), pa.array(errors)],
                ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def codebooks(table, entries=64, parts=16, rounds=2):
    """The codebooks of a table of ``components_of`` after ``rounds`` of assigning and averaging.

    The driver holds the entries only, ``entries`` vectors; a round sends it one row for each of their
    components. Sums are added up inside the tasks first.
    """
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("width", "parts").collect()
    width = -(-(table.agg(F.max("width")).first()[0] or 0) // parts)
    numbers = matrix([r["width"] for r in first], [r["parts"] for r in first], width * parts).astype(np.int64)
    books = [numbers[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds if first else 0):
        sums, counts = {}, {}
        for part, entry, place, total in _moved(table, books, width).collect():
            if place < 0:
                counts[part, entry] = total
            else:
                sums[part, entry, place] = total
        books = [book.copy() for book in books]
        for (part, entry, place), total in sums.items():
            books[part][entry, place] = total // counts[part, entry]
    return books, width


def compress(vectors, entries=64, parts=16, rounds=2, id_col="vec_id", label_col="label", vector_col="embedding"):
    """Codes of all vectors: vec_id, code, error, label_error, codebooks_sha256.

    Vectors are the whole numbers floor(256 * x), cut into ``parts`` equal pieces. The codebook of each
    place starts as the pieces of the ``entries`` smallest ids and moves ``rounds`` times to
    the floor of the mean of its pieces; an entry without pieces stays. ``code`` has two hex digits a
    part, ``error`` is the squared distance to the coded vector, ``label_error`` its sum over
    the label (rows without one together), ``codebooks_sha256`` the hash of all entries.

    Every search is Orchard's, exact, with the lower index at ties. Codebooks are as large as
    ``entries`` vectors, whatever the table holds, and travel with the tasks.

    Vectors that are null or hold null or non-finite components are dropped, as are those
    whose squared length in whole numbers reaches 2 ** 58 (distances must fit a long).
    Shorter vectors, and lengths that ``parts`` does not divide, are filled up with 0. Ids may
    be null (they start no codebook while others can) and repeat (equal ids start in the order
    of their numbers); repeated rows are rows of their own. An empty table gives no rows;
    extra columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    ready(vectors)
    table = stored(components_of(vectors, id_col, label_col, vector_col, LARGEST))
    books, width = codebooks(table, entries, parts, rounds)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    coded = stored(_coded(table, books, width)).select(
        "*", F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("label_key"))
    of_label = coded.groupBy("no_label", "label_key").agg(F.sum("error").alias("label_error"))
    return lookup_join(coded, of_label, ["no_label", "label_key"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
