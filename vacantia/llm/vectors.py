"""Vectors as whole numbers: the components of operators 11 and 13."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Bytes of a component, smallest first; the last holds any whole number a double can be.
TYPES = (("<i2", 1 << 15), ("<i4", 1 << 31), ("<f8", float("inf")))

SCHEMA = "vec_id bigint, label bigint, width int, parts binary"


def components_of(vectors, id_col="vec_id", label_col="label", vector_col="embedding", largest=None):
    """vec_id, label, width, parts: the components floor(256 * x) of each usable vector.

    ``parts`` has ``width`` little-endian numbers of 2, 4 or 8 bytes (then doubles). Vectors
    that are null, hold null or non-finite components or whose squared length in these whole
    numbers reaches ``largest`` (2 ** 60, so that scores and squared distances fit a long)
    are dropped. An empty vector has no parts and stays.
    """
    largest = float(largest or 1 << 60)

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            offsets = column.offsets.to_numpy()
            raw = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            with np.errstate(all="ignore"):
                whole = np.floor(SCALE * raw)
                bad = np.append(0, np.cumsum(~np.isfinite(whole)))
                whole[~np.isfinite(whole)] = 0
                rows = np.repeat(np.arange(len(column)), np.diff(offsets))
                size = np.bincount(rows, whole * whole, len(column))
            usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (size < largest)
            top = np.abs(whole).max(initial=0) + 1
            coded = whole.astype(next(t for t, limit in TYPES if top < limit))
            at = np.flatnonzero(usable)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(keep), batch.column(1).take(keep), pa.array(np.diff(offsets)[at], pa.int32()),
                pa.array([coded[i:j].tobytes() for i, j in zip(offsets[at].tolist(), offsets[at + 1].tolist())], pa.binary())],
                ["vec_id", "label", "width", "parts"])

    return vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, SCHEMA)


def matrix(widths, parts, width=None):
    """The numbers of many vectors, one row each, shorter ones filled up with 0."""
    width = max(widths, default=0) if width is None else width
    sizes = {(w, len(p)) for w, p in zip(widths, parts)}
    if len(sizes) == 1 and (one := next(iter(sizes)))[0] == width > 0:
        kind = next(t for t, _ in TYPES if t[-1] == str(one[1] // width))
        numbers = np.frombuffer(b"".join(parts), kind).reshape(-1, width)
        return numbers.astype(np.float64 if kind == "<f8" else np.int64)
    out = np.zeros((len(parts), width))
    for k, (w, p) in enumerate(zip(widths, parts)):
        if w:
            out[k, :w] = np.frombuffer(p, next(t for t, _ in TYPES if t[-1] == str(len(p) // w)))
    return out
