"""Near-duplicate documents by circulant MinHash (operator 6)."""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from vacantia.llm import texts
from vacantia.llm.components import components
from vacantia.llm.shared import documents, ready, stored, text_key
from vacantia.operators.joins import first_per_group, lookup_join

U = np.uint64
STEP = U(texts.STEP)
#: Bands and coordinates per band: a pair at similarity 0.8 misses all 32 bands of 5 with
#: probability (1 - 0.8 ** 5) ** 32 < 4e-6.
BANDS, ROWS = 32, 5
#: Rounds of comparing the members of a bucket with one of them.
STARS = 2
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Chance with which a pair at the threshold may miss all bands.
MISS = 4e-6
#: Coordinates of the sketch that tells which open pairs are worth an exact check.
SKETCH = 320


def banding(percent, bands=BANDS, rows=ROWS):
    """Bands and coordinates per band for a threshold: as many coordinates as MISS allows, then more bands."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent has to be from 1 to 100, not {percent}")
    while rows > 1 and (1 - (percent / 100) ** rows) ** bands > MISS:
        rows -= 1
    while (1 - (percent / 100) ** rows) ** bands > MISS:
        bands += 1
    return bands, rows


def sketch_least(percent):
    """Share of the sketch that has to agree: four and a half standard deviations under the threshold."""
    p = percent / 100
    return p - 4.5 * math.sqrt(p * (1 - p) / SKETCH)


def shingles(data, offsets, size):
    """Sorted distinct hashes of the word shingles of each text, A-Z lower-cased.

    A text of fewer words has one shingle, its whole sequence; without words it has none.
    """
    data = texts.lower(data)
    starts, ends = texts.word_spans(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, U)] * n
    words = texts.span_hash(texts.prefix_sums(data), starts, ends, 3)
    cuts = np.searchsorted(starts, offsets).tolist()
    runs = words[: max(0, len(words) - size + 1)]
    for k in range(1, size):
        runs = texts.mix(runs * STEP + words[k : len(words) - size + 1 + k])
    out = []
    for i, j in zip(cuts, cuts[1:]):
        if j - i >= size:
            out.append(np.unique(runs[i : j - size + 1]))
        elif j > i:
            whole = words[i]
            for k in range(i + 1, j):
                whole = texts.mix(whole * STEP + words[k : k + 1])[0]
            out.append(texts.mix(np.array([whole ^ U(j - i)]) + STEP))
        else:
            out.append(np.zeros(0, U))
    return out


def _permute(x, out, help_):
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=help_)
        np.bitwise_xor(x, help_, out=out)
        np.multiply(out, np.uint32(factor), out=out)
        x = out
    np.right_shift(out, np.uint32(16), out=help_)
    np.bitwise_xor(out, help_, out=out)
    return out


def signatures(sets, n):
    """``n`` MinHash coordinates of each non-empty set from two permutations.

    The first permutation scatters the elements over the 32-bit circle; coordinate k is the
    least value of the second permutation when it is circularly shifted by k.
    """
    out = np.empty((len(sets), n), np.uint32)
    row = 0
    while row < len(sets):
        end, size = row, 0
        while end < len(sets) and (end == row or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[row:end]) >> U(32)).astype(np.uint32)
        starts = np.append(0, np.cumsum([len(s) for s in sets[row : end - 1]])).astype(np.int64)
        value, help_ = np.empty_like(x), np.empty_like(x)
        place = _permute(x * np.uint32(0x9E3779B1) + np.uint32(77), np.empty_like(x), help_).copy()
        for k in range(n):
            np.add(place, np.uint32(k), out=value)
            out[row:end, k] = np.minimum.reduceat(_permute(value, value, help_), starts)
        row = end
    return out


def sketches(docs, shingle, bands=BANDS, rows=ROWS):
    """One row per document: doc_id, text_key, set_key, n_shingles, bands, sketch, packed text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row, data, offsets in texts.chunks(batch.column(1)):
                sets = shingles(data, offsets, shingle)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                some = [sets[k] for k in full.tolist()]
                keys, lists, heads = [None] * len(sets), [[]] * len(sets), [b""] * len(sets)
                if some:
                    signed = signatures(some, max(SKETCH, bands * rows))
                    start = np.append(0, np.cumsum([len(s) for s in some[:-1]])).astype(np.int64)
                    flat = np.concatenate(some)
                    pair = np.stack([np.add.reduceat(texts.mix(flat), start), np.add.reduceat(texts.mix(flat ^ STEP), start)], 1)
                    banded = np.zeros((len(some), bands), U)
                    for r in range(rows):
                        banded = texts.mix(banded * STEP + signed[:, r : bands * rows : rows] + np.arange(1, bands + 1, dtype=U))
                    for k, at in enumerate(full.tolist()):
                        keys[at], heads[at] = pair[k].tobytes(), (signed[k, :SKETCH] & 255).astype(np.uint8).tobytes()
                        lists[at] = banded[k].view(np.int64).tolist()
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(sets)), batch.column(2).slice(row, len(sets)),
                    pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())), pa.array(heads, pa.binary()),
                    pa.array([pack.compress(raw[i:j]) for i, j in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary()),
                ], ["doc_id", "text_key", "set_key", "n_shingles", "bands", "sketch", "packed"])

    schema = ("doc_id bigint, text_key binary, set_key binary, n_shingles bigint, bands array<bigint>, "
              "sketch binary, packed binary")
    return docs.withColumn("text_key", text_key(F.col("text"))).mapInArrow(run, schema)


def verified(pairs, packed, shingle, percent):
    """Those of ``pairs`` (x, y: set keys) whose full sets are similar enough, judged exactly."""
    left = packed.select(F.col("set_key").alias("x"), F.col("packed").alias("px"), F.col("n_shingles").alias("nx"))
    right = packed.select(F.col("set_key").alias("y"), F.col("packed").alias("py"), F.col("n_shingles").alias("ny"))
    near = lambda a, b: F.col(a) * 100 >= F.col(b) * percent
    sizes = packed.select("set_key", "n_shingles")
    pairs = pairs.join(sizes.select(F.col("set_key").alias("x"), F.col("n_shingles").alias("nx")), "x").join(
        sizes.select(F.col("set_key").alias("y"), F.col("n_shingles").alias("ny")), "y")
    pairs = pairs.filter(near("nx", "ny") & near("ny", "nx")).select("x", "y")
    texts_of = pairs.join(left, "x").join(right, "y").select("x", "y", "px", "py")

    def run(batches):
        unpack, known = zstandard.ZstdDecompressor(), {}

        def sets_of(keys, blobs):
            new = {k: b for k, b in zip(keys, blobs) if k not in known}
            raw = [unpack.decompress(b) for b in new.values()]
            data = np.frombuffer(b"".join(raw), np.uint8)
            offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
            known.update(zip(new, shingles(data, offsets, shingle)))

        for batch in batches:
            x, y, px, py = (batch.column(k).to_pylist() for k in range(4))
            for i in range(0, len(x), 256):
                known = {k: v for k, v in known.items() if k in set(y[i : i + 256])}
                part = slice(i, i + 256)
                sets_of(x[part] + y[part], px[part] + py[part])
                good = []
                for a, b in zip(x[part], y[part]):
                    a_set, b_set = known[a], known[b]
                    common = len(np.intersect1d(a_set, b_set, assume_unique=True))
                    good.append(100 * common >= percent * (len(a_set) + len(b_set) - common))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, g in zip(x[part], good) if g], pa.binary()),
                     pa.array([b for b, g in zip(y[part], good) if g], pa.binary())], ["u", "v"])

    return texts_of.mapInArrow(run, "u binary, v binary")


def _left_over(buckets, roots, packed, shingle, percent):
    """Links among the pairs of a bucket that no star decided: in different components.

    A bucket is cut into blocks of about BLOCK members and each pair of blocks is one group,
    so a hot bucket is spread. Pairs whose sketches agree enough are judged on their full
    sets where they meet first, and only links leave the task.
    """
    rows = lookup_join(buckets, roots.select(F.col("node").alias("x"), "root"), "x")
    rows = rows.withColumn("root", F.coalesce("root", "x"))
    mixed = rows.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("band")
    # pairs with the bucket's first head are decided
    rows = lookup_join(rows.filter("members > 2 and x <> head"), mixed, "band", "inner")
    facts = packed.select(F.col("set_key").alias("x"), "sketch", "n_shingles", "bands", "packed")
    rows = lookup_join(rows, facts, "x", "inner")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("b", F.pmod(F.hash("x"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "band", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.col("b"), "x", "root", "sketch",
        "n_shingles", "bands", "packed")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "x")

    least = sketch_least(percent)

    def compare(members):
        band, alike, n = members[0][0], members[0][1] == members[0][2], len(members)
        x, root = [m[4] for m in members], np.unique([m[5] for m in members], return_inverse=True)[1]
        if root.max() == 0:
            return
        block, size = np.array([m[3] for m in members]), np.array([m[7] for m in members])
        signed = np.frombuffer(b"".join(m[6] for m in members), np.uint8).reshape(n, -1)
        bands = np.array([m[8] for m in members])
        unpack, known = zstandard.ZstdDecompressor(), {}

        def set_of(k):
            if k not in known:
                raw = np.frombuffer(unpack.decompress(members[k][9]), np.uint8)
                known[k] = shingles(raw, np.array([0, len(raw)]), shingle)[0]
            return known[k]

        for k in range(n - 1):
            ok = (root[k + 1 :] != root[k]) & (100 * np.minimum(size[k + 1 :], size[k]) >= percent * np.maximum(size[k + 1 :], size[k]))
            if not alike:
                ok &= block[k + 1 :] != block[k]
            at = np.flatnonzero(ok) + k + 1
            at = at[(signed[at] == signed[k]).mean(1) >= least]
            if not len(at):
                continue
            shared = bands[at] == bands[k]
            at = at[bands[k][shared.argmax(1)] == band]  # of the buckets a pair shares the first counts
            for other in at.tolist():
                a, b = set_of(k), set_of(other)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    yield x[k], x[other]

    def run(batches):
        group = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:3] != row[:3]:
                    found += compare(group)
                    group = []
                group.append(row)
            yield _pairs(found)
        yield _pairs(list(compare(group)) if group else [])

    return rows.mapInArrow(run, "u binary, v binary")


def _pairs(found):
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], ["u", "v"])


def near_duplicates(docs, shingle=5, percent=80, bands=None, rows=None, id_col="doc_id", text_col="text", with_key=False):
    """Components of documents whose word-shingle sets have a Jaccard similarity of percent / 100.

    Returns one row per document: doc_id, n_shingles, component_id (smallest doc_id reachable
    by links, itself included), kept (doc_id = component_id).

    1. Every text gets a circulant MinHash signature, cut into bands that fit percent (``banding``). Equal sets are one node.
    2. Documents that share a band value share a bucket. Each is compared with the member
       that shares the most buckets; those that are not in its component then are compared
       with one of them in the same way. Every comparison is exact, on the full sets.
    3. Pairs of a bucket that this leaves open (still in different components) are compared
       by sketch inside blocks, and exactly if the sketches agree.

    So every pair that meets in a bucket is decided, while equal or similar copies cost one
    comparison each. A text with no words has no shingles and no links (component_id is its
    own id); a null id is never the smallest and, alone, gets a null component; rows with
    equal ids are kept alike; an empty table gives no rows; extra columns are ignored.
    """
    ready(docs)
    fitting = banding(percent)
    bands, rows = bands or fitting[0], rows or fitting[1]
    # computed once: the mapper runs over whole texts
    made = stored(sketches(documents(docs, id_col, text_col), shingle, bands, rows))
    filled = made.filter("n_shingles > 0")
    banded = filled.select(F.col("set_key").alias("x"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low <> high")
    buckets = stored(lookup_join(banded, shared.select("band"), "band", "inner").select("band", "x").distinct())
    sizes = buckets.groupBy("band").agg(F.count("*").alias("members"))
    buckets = lookup_join(buckets, sizes, "band", "inner")
    # what most others resemble shares the most buckets: it is the best one to compare with
    degrees = buckets.groupBy("x").agg(F.sum(F.col("members") - 1).alias("degree"))
    buckets = stored(lookup_join(buckets, degrees, "x", "inner").select("band", "x", "members", "degree"))
    packed = filled.groupBy("set_key").agg(
        F.first("packed").alias("packed"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands"))
    wanted = buckets.select(F.col("x").alias("set_key")).distinct()
    packed = stored(packed.join(wanted, "set_key", "left_semi"))
    links, open_rows, first_heads = None, buckets, None
    for _ in range(STARS):
        heads = open_rows.groupBy("band").agg(F.max(F.struct("degree", "x")).alias("top"), F.count("*").alias("n"))
        heads = stored(heads.filter("n > 1").select("band", F.col("top.x").alias("head")))
        first_heads = heads if first_heads is None else first_heads
        stars = lookup_join(open_rows, heads, "band", "inner")
        pairs = stars.filter("x <> head").select(F.least("x", "head").alias("x"), F.greatest("x", "head").alias("y")).distinct()
        found = stored(verified(pairs, packed, shingle, percent))
        links = found if links is None else links.union(found)
        roots = components(links)
        # those that are not with the head yet
        of = lambda name, roots=roots: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        stars = lookup_join(lookup_join(stars, of("x"), "x"), of("head"), "head")
        open_rows = stored(stars.filter(
            F.coalesce("root_x", "x") != F.coalesce("root_head", "head")).select("band", "x", "members", "degree"))
    more = stored(_left_over(lookup_join(buckets, first_heads, "band", "inner"), roots, packed, shingle, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    owners = filled.groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    rooted = lookup_join(owners, roots.withColumnRenamed("node", "set_key"), "set_key").withColumn("root", F.coalesce("root", "set_key"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = lookup_join(rooted.select("set_key", "root"), smallest, "root").select("set_key", "root", "component_id")
    out = lookup_join(made.select("doc_id", "text_key", "set_key", "n_shingles"), component, "set_key")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *["text_key", "root"] * with_key)


def deduplicate(docs, id_col="doc_id", text_col="text", **options):
    """The rows of one document of each group, all columns kept: the smallest id's, null last, then the smallest text key's.

    Rows equal in id and text are one document and give one row. Texts without words are in
    no group and stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, with_key=True, **options)
    first = found.filter("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    kept = first.select("first.doc_id", "first.text_key").union(found.filter("root is null").select("doc_id", "text_key"))
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_key").alias("_text"))
    rows = docs.withColumns({
        "_id": F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("")), "_text": text_key(F.col(text_col).cast("string"))})
    rows = first_per_group(rows, ["_id", "_text"], [F.lit(0)])
    return rows.join(kept.distinct(), ["_id", "_text"], "left_semi").drop("_id", "_text")
