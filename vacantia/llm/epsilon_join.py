"""Near-duplicate embeddings by an epsilon grid order join (operator 5)."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from vacantia.llm.components import components
from vacantia.llm.shared import ready, stored
from vacantia.operators.joins import lookup_join

LEAST = 0.95
#: Vectors that fit the principal axes; the axes change only how much is skipped.
SAMPLE = 10_000
#: Leading principal dimensions of the grid.
AXES = 6
#: Vectors of a block, and of an interval that is compared without further cutting.
BLOCK, LEAF = 4096, 256


def _units(vectors):
    """vec_id, key (16 bytes, equal for equal directions bit by bit), dim, unit (float64 bytes)."""

    def run(batches):
        for batch in batches:
            keys, dims, units = [], [], []
            for values in batch.column(1).to_pylist():
                v = np.array([] if values is None else values, np.float64)
                usable = v.size and np.isfinite(v).all() and v.any()
                if usable:
                    v = v / np.abs(v).max()  # the square of very large numbers would overflow
                    v = v / math.sqrt(float(v @ v))
                units.append(v.tobytes() if usable else None)
                dims.append(len(v) if usable else None)
                keys.append(hashlib.md5(units[-1]).digest() if usable else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                ["vec_id", "key", "dim", "unit"])

    return vectors.mapInArrow(run, "vec_id bigint, key binary, dim int, unit binary")


def principal_axes(units, axes=AXES, sample=SAMPLE):
    """Leading principal axes per vector length, from at most ``sample`` vectors in hash order."""
    rows = units.orderBy(F.xxhash64("key"), "key").limit(sample).select("dim", "unit").collect()
    by_dim = {}
    for row in rows:
        by_dim.setdefault(row["dim"], []).append(np.frombuffer(row["unit"]))
    out = {}
    for dim, some in by_dim.items():
        some = np.array(some)
        _, vectors = np.linalg.eigh(np.cov(some.T).reshape(dim, dim) if len(some) > 1 else np.eye(dim))
        out[dim] = vectors[:, ::-1][:, :axes].copy()
    return out


def _grid(units, axes, eps):
    """Add ``cells``: the grid cell of a vector as bytes whose order is that of the cells."""

    def run(batches):
        for batch in batches:
            cells = []
            for dim, unit in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v, axis = np.frombuffer(unit), axes.get(dim)
                place = v @ axis if axis is not None else v[:AXES]
                cells.append((np.floor(place / eps).astype(np.int32) + (1 << 20)).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], ["key", "dim", "unit", "copies", "cells"])

    return units.select("key", "dim", "unit", "copies").mapInArrow(
        run, "key binary, dim int, unit binary, copies bigint, cells binary")


def _blocks(ordered, axes, size):
    """Runs of the grid order: id, dim, low, high (bounds on the axes), keys, copies, units, n."""

    def run(batches):
        part, count, held = TaskContext.get().partitionId(), 0, []

        def block():
            dim = held[0][1]
            v = np.array([np.frombuffer(r[2]) for r in held])
            place = v @ axes[dim] if dim in axes else v[:, :AXES]
            return pa.RecordBatch.from_arrays([
                pa.array([part << 20 | count]), pa.array([dim], pa.int32()), pa.array([len(held)], pa.int32()),
                pa.array([place.min(0).tolist()], pa.list_(pa.float64())), pa.array([place.max(0).tolist()], pa.list_(pa.float64())),
                pa.array([b"".join(r[0] for r in held)], pa.binary()),
                pa.array([np.array([r[3] for r in held], np.int64).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                ["id", "dim", "n", "low", "high", "keys", "copies", "units"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield block()
                    held, count = [], count + 1
                held.append(row)
        if held:
            yield block()

    schema = "id bigint, dim int, n int, low array<double>, high array<double>, keys binary, copies binary, units binary"
    return ordered.mapInArrow(run, schema)


def _near_blocks(blocks, eps):
    """Pairs (i, j) of blocks that are not provably farther apart than ``eps``.

    The recursion over intervals of the sequence runs level by level from the whole: the
    parts of two near intervals are compared by their bounds on the axes, and far ones end
    there with all their parts.
    """
    level = blocks.select("id", "dim", "low", "high")
    levels, top = [level], blocks.agg(F.max("id")).first()[0] or 0
    extreme = lambda f, c: f(F.array(*[F.get(c, F.lit(k)) for k in range(AXES)]))  # noqa: E731,F841
    while top:
        top >>= 5
        bounds = [F.min(F.get("low", F.lit(k))).alias(f"l{k}") for k in range(AXES)]
        bounds += [F.max(F.get("high", F.lit(k))).alias(f"h{k}") for k in range(AXES)]
        level = level.groupBy(F.shiftright("id", 5).alias("id"), "dim").agg(*bounds).select(
            "id", "dim", F.array(*[f"l{k}" for k in range(AXES)]).alias("low"), F.array(*[f"h{k}" for k in range(AXES)]).alias("high"))
        levels.append(stored(level))
    near = levels[-1].select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("dim"))
    for level in levels[-2::-1]:
        side = lambda s, level=level: level.select(
            F.shiftright("id", 5).alias(f"parent_{s}"), F.col("dim").alias(f"dim_{s}"), F.col("id").alias(f"id_{s}"),
            F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
        gaps = F.zip_with(
            F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y),
            lambda x, y: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
        far = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
        near = (
            near.join(side("a"), (F.col("i") == F.col("parent_a")) & (F.col("dim") == F.col("dim_a")))
            .join(side("b"), (F.col("j") == F.col("parent_b")) & (F.col("dim") == F.col("dim_b")))
            .filter((F.col("id_a") <= F.col("id_b")) & (far <= eps * eps))
            .select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), "dim"))
    return near


def join_intervals(a, b, pa_, pb, eps, least, leaf=LEAF):
    """Recursive join of two intervals: blocks of a boolean matrix as (row, column, hits)."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if gap @ gap > eps * eps:
            continue
        if j - i > leaf or m - k > leaf:
            rows = [(i, j)] if j - i <= leaf else [(i, (i + j) // 2), ((i + j) // 2, j)]
            columns = [(k, m)] if m - k <= leaf else [(k, (k + m) // 2), ((k + m) // 2, m)]
            stack += [(*r, *c) for r in rows for c in columns]
            continue
        hits = a[i:j] @ b[k:m].T >= least
        if hits.any():
            yield i, k, hits


def _links(pairs, blocks, axes, eps, least):
    """Per pair of blocks: linked copies of each vector, and its root inside the pair."""
    side = lambda s: blocks.select(
        F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("keys", "copies", "units")])
    joined = pairs.join(side("i"), "i").join(side("j"), "j").select(
        "i", "j", "dim", "keys_i", "copies_i", "units_i", "keys_j", "copies_j", "units_j")

    def run(batches):
        for batch in batches:
            for i, j, dim, keys_i, copies_i, units_i, keys_j, copies_j, units_j in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(units_i).reshape(-1, dim), np.frombuffer(units_j).reshape(-1, dim)
                weight_a, weight_b = np.frombuffer(copies_i, np.int64), np.frombuffer(copies_j, np.int64)
                project = (lambda v: v @ axes[dim]) if dim in axes else (lambda v: v[:, :AXES])
                n, same, parts = len(a), i == j, []
                links, other = np.zeros(n, np.int64), np.zeros(len(b), np.int64)
                for row, column, hits in join_intervals(a, b, project(a), project(b), eps, least):
                    if same:
                        hits = hits & (np.arange(row, row + hits.shape[0])[:, None] != np.arange(column, column + hits.shape[1]))
                    links[row : row + hits.shape[0]] += hits @ weight_b[column : column + hits.shape[1]]
                    other[column : column + hits.shape[1]] += weight_a[row : row + hits.shape[0]] @ hits
                    parts.append((row, column, hits))
                # least label that reaches each vector inside the pair
                label_a = np.arange(n)
                label_b = label_a.copy() if same else np.arange(n, n + len(b))
                big = n + len(b)
                while parts:
                    before = label_a.copy(), label_b.copy()
                    for row, column, hits in parts:
                        u, v = label_a[row : row + hits.shape[0]], label_b[column : column + hits.shape[1]]
                        np.minimum(v, np.where(hits, u[:, None], big).min(0), out=v)
                        np.minimum(u, np.where(hits, v, big).min(1), out=u)
                    if same:
                        label_a = label_b = np.minimum(label_a, label_b)
                    if (before[0] == label_a).all() and (before[1] == label_b).all():
                        break
                key = [k[p : p + 16] for k in ((keys_i,) if same else (keys_i, keys_j)) for p in range(0, len(k), 16)]
                count = links if same else np.append(links, other)
                root = label_a if same else np.append(label_a, label_b)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[k] for k in at.tolist()], pa.binary()), pa.array(count[at]),
                    pa.array([key[k] for k in root[at].tolist()], pa.binary())], ["key", "links", "root"])

    return joined.mapInArrow(run, "key binary, links bigint, root binary")


def near_vectors(vectors, least=LEAST, id_col="vec_id", vector_col="embedding", block=BLOCK):
    """Vectors linked by a cosine of ``least`` or more: vec_id, n_links, component_id, kept.

    On unit vectors that cosine means a distance of eps = sqrt(2 - 2 * least) or less. The
    vectors are sorted by their cells (of width eps) on the leading principal dimensions and
    cut into blocks; pairs of blocks, and inside them of intervals, that lie farther apart
    than eps on these dimensions are skipped, all others are compared in double precision.

    Vectors that agree bit by bit after scaling are joined once, with the number of copies;
    a pair of blocks sends one row per linked vector, not its links. Vectors that are null,
    empty, zero or hold null or non-finite numbers have no links and are kept; vectors of
    different lengths are never linked; a null id is never the smallest; rows with equal ids
    are vectors of their own; an empty table gives no rows; extra columns are ignored.
    """
    spark = ready(vectors)
    eps = math.sqrt(2 - 2 * least) * (1 + 1e-9) + 1e-12
    units = stored(_units(vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))))
    usable = units.filter("key is not null")
    single = stored(usable.groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("dim").alias("dim"), F.first("unit").alias("unit")))
    axes = principal_axes(single)
    parts = max(1, math.ceil(single.count() / block))
    ordered = _grid(single, axes, eps).repartitionByRange(parts, "dim", "cells", "key").sortWithinPartitions("dim", "cells", "key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    blocks = stored(_blocks(ordered, axes, block))
    pairs = stored(_near_blocks(blocks, eps))
    links = stored(_links(pairs.repartition("i", "j"), blocks, axes, eps, least))
    roots = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    owners = lookup_join(single.select("key", "copies", "first_id"), counts, "key")
    owners = lookup_join(owners, roots.withColumnRenamed("node", "key"), "key").withColumn("root", F.coalesce("root", "key"))
    smallest = owners.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owners = lookup_join(owners, smallest, "root").select(
        "key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = lookup_join(units.select("vec_id", "key"), owners, "key")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
