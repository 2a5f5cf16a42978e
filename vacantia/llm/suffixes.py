"""Removal of repeated byte strings by sorted suffixes (operator 7).

A suffix matters only up to ``least`` (200) bytes: two suffixes that share so many are a
repeat. Suffixes are sampled into *slices* so that not every one of them has to travel: of
all 32-byte grams of a 200-byte window the one with the least hash is its anchor, and the
windows that follow each other with the same anchor form one slice. Equal windows have equal
anchors, so an anchor that occurs once rules out all its windows, and slices whose bytes
agree decide all theirs. What is left undecided goes to buckets: suffixes are
range-partitioned by their leading bytes at sampled splitters, and every bucket sorts its
windows by multikey quicksort, eight bytes at a time.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from vacantia.llm import texts
from vacantia.llm.shared import documents, ready, stored
from vacantia.operators.joins import lookup_join

U = np.uint64
LEAST = 200
GRAM = 32
#: Longest stretch of one text that is hashed at a time.
STRETCH = 1 << 22
#: Windows that a bucket sorts at a time, if anchors allow.
WINDOWS = 300_000
#: Slices that may share an anchor before their windows travel one by one.
HOT = 1500


def slices(data, offsets, least=LEAST):
    """Slices of all texts: first and last window start, anchor place, anchor and slice hash."""
    if len(data) > STRETCH and len(offsets) == 2:
        parts = []
        for at in range(0, len(data) - least + 1, STRETCH):
            part = data[at : at + STRETCH + least - 1]
            first, last, place, anchor, value = slices_of(part, np.array([0, len(part)]), least)
            parts.append((first + at, last + at, place + at, anchor, value))
        return [np.concatenate(column) for column in zip(*parts)]
    return slices_of(data, offsets, least)


def slices_of(data, offsets, least):
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 2
    if len(data) < least:
        return none
    sums = texts.prefix_sums(data)
    _, inverse = texts.powers(len(sums))
    n = len(data) - GRAM + 1
    gram = texts.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n])
    low = U((1 << 23) - 1)
    window = (gram & ~low) | np.arange(n, dtype=U)
    width, step = least - GRAM + 1, 1
    while step * 2 <= width:
        window = np.minimum(window[:-step], window[step:])
        step *= 2
    window = np.minimum(window[: len(window) - (width - step)], window[width - step :])
    # starts whose window ends inside their text
    valid = np.ones(len(window), bool)
    for end in offsets[1:-1].tolist():
        valid[max(0, end - least + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    place = (window[starts] & low).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(starts)) - 1
    place, first, last = place[first], starts[first], starts[last]
    return [first, last, place, gram[place], texts.span_hash(sums, first, last + least, 11)]


def _with_keys(docs):
    """Name of a text: 64 bits of one hash and 16 of another."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tk"), F.crc32(text.cast("binary")).bitwiseAND(F.lit(0xFFFF)).alias("tx"), text.alias("text"))


def _slice_rows(docs, least):
    """tk, tx, first (window start), spread (last start, anchor, both from first), anchor, slice."""

    def run(batches):
        for batch in batches:
            keys, more = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in texts.chunks(batch.column(2)):
                first, last, place, anchor, value = slices(data, offsets, least)
                text = texts.owner(offsets, first)
                start = first - offsets[text]
                spread = (last - first) << 16 | (place - first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[row + text], pa.int64()), pa.array(more[row + text], pa.int64()), pa.array(start, pa.int64()),
                    pa.array(spread.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(value.view(np.int64))],
                    ["tk", "tx", "first", "spread", "anchor", "slice"])

    schema = "tk bigint, tx bigint, first bigint, spread int, anchor bigint, slice bigint"
    return docs.select("tk", "tx", "text").mapInArrow(run, schema)


def _packed(docs):
    """tk, tx, doc_id, packed text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = batch.column(3).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([pack.compress(t) for t in text], pa.binary())], ["doc_id", "tk", "tx", "packed"])

    return docs.mapInArrow(run, "doc_id bigint, tk bigint, tx bigint, packed binary")


def _suffix_rows(packed, wanted, least, hot):
    """Bytes of the wanted slices, to be sorted in buckets.

    Rows: lead (bytes that decide the bucket), anchored (bytes before the anchor, -1 for a
    single window), repeated (known to occur elsewhere), tk, tx, first, bytes. Slices of hot
    anchors are sent window by window, equal ones of a batch only once; windows that the
    batch alone proves to be repeated come back as rows without bytes.
    """
    wanted = wanted.groupBy("tk", "tx").agg(F.collect_list(F.struct("first", "spread", "repeated", "hot")).alias("wanted"))
    joined = packed.join(wanted, ["tk", "tx"]).select("tk", "tx", "packed", "wanted")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, windows = [], {}
            for tk, tx, blob, parts in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unpack.decompress(blob)
                for part in parts:
                    first, last, before = part["first"], part["first"] + (part["spread"] >> 16), part["spread"] & 0xFFFF
                    if not part["hot"]:
                        lead = raw[first + before : first + before + GRAM]
                        rows.append((lead, before, part["repeated"], tk, tx, first, raw[first : last + least]))
                        continue
                    for at in range(first, last + 1):
                        window = raw[at : at + least]
                        seen = windows.get(window)
                        if seen is None:
                            windows[window] = [part["repeated"], None if part["repeated"] else (tk, tx, at)]
                        else:
                            for found in (seen[1], None if part["repeated"] else (tk, tx, at)):
                                if found:
                                    rows.append((None, -1, True, *found, None))
                            seen[:] = [True, None]
            rows += [(w, -1, known, *(found or (0, 0, 0)), w) for w, (known, found) in windows.items()]
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["lead", "anchored", "repeated", "tk", "tx", "first", "bytes"])

    schema = "lead binary, anchored int, repeated boolean, tk bigint, tx bigint, first bigint, bytes binary"
    return joined.mapInArrow(run, schema)


def multikey_repeats(words, starts, groups, least=LEAST):
    """Which of the suffixes at ``starts`` share ``least`` bytes with another of their group.

    ``words`` holds at every byte the eight bytes from there on as one number. Segments of
    suffixes that agree so far are sorted by their next eight bytes, all segments at once;
    a segment of one is done, and one whose suffixes all agree to the end is a repeat.
    """
    steps = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
    out = np.zeros(len(starts), bool)
    order = np.argsort(groups, kind="stable")
    segment = groups[order]
    for depth, step in enumerate([None, *steps]):
        if not len(order):
            return out
        if step is not None:
            word = words[starts[order] + step]
            inner = np.lexsort((word, segment))
            order, segment, word = order[inner], segment[inner], word[inner]
            new = np.append(True, (segment[1:] != segment[:-1]) | (word[1:] != word[:-1]))
        else:
            new = np.append(True, segment[1:] != segment[:-1])
        segment = np.cumsum(new) - 1
        size = np.bincount(segment)[segment]
        order, segment = order[size > 1], segment[size > 1]
        if not len(order):
            return out
        # segments that agree with their first suffix in all that is left
        head = np.append(True, segment[1:] != segment[:-1])
        pivot = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        same = np.ones(len(order), bool)
        for rest in steps[depth:]:
            at = np.flatnonzero(same)
            same[at] = words[starts[order[at]] + rest] == words[starts[pivot[at]] + rest]
        number = np.cumsum(head) - 1
        whole = (np.bincount(number, ~same) == 0)[number]
        out[order[whole]] = True
        order, segment = order[~whole], segment[~whole]
    out[order] = True
    return out


def eight_bytes(data):
    padded = np.append(data, np.zeros(8, np.uint8)).astype(U)
    word = np.zeros(len(data), U)
    for k in range(8):
        word = (word << U(8)) | padded[k : k + len(data)]
    return word


def _bucket(rows, least):
    """Repeated windows among sorted suffix rows: (tk, tx, from, to) byte ranges."""
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    size = np.array([len(r[6]) for r in rows])
    base = np.append(0, np.cumsum(size)[:-1])
    count = size - least + 1
    row = np.repeat(np.arange(len(rows)), count)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lead = np.cumsum([k > 0 and a[0] != b[0] for k, (a, b) in enumerate(zip(rows, [rows[0], *rows]))])
    anchored = np.array([r[1] for r in rows])
    # windows can only agree if their anchors do, at the same distance from their starts
    group = lead[row] * 4096 + np.where(anchored[row] < 0, 4095, anchored[row] - shift)
    found = multikey_repeats(eight_bytes(data), base[row] + shift, group, least)
    known = np.array([r[2] for r in rows])
    found &= ~known[row]
    at = np.flatnonzero(found)
    if not len(at):
        return
    cut = np.flatnonzero((row[at][1:] != row[at][:-1]) | (shift[at][1:] != shift[at][:-1] + 1)) + 1
    for i, j in zip(np.append(0, cut).tolist(), (np.append(cut, len(at)) - 1).tolist()):
        r = rows[row[at[i]]]
        yield r[3], r[4], r[5] + int(shift[at[i]]), r[5] + int(shift[at[j]]) + least


def _sorted_buckets(suffixes, least):
    """Ranges found by sorting: suffixes with equal leading bytes meet in one bucket.

    The splitters are sampled from the leading bytes themselves, so rows that agree in them
    never lie on two sides of a boundary; the neighbours across one always differ there.
    """
    rows = suffixes.filter("lead is not null").repartitionByRange("lead").sortWithinPartitions("lead", "anchored", "tk", "first")

    def run(batches):
        def ranges(found):
            columns = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tk", "tx", "from", "to"])

        held, windows = [], 0
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if windows >= WINDOWS and row[0] != held[-1][0]:
                    found += _bucket(held, least)
                    held, windows = [], 0
                held.append(row)
                windows += len(row[6]) - least + 1
            yield ranges(found)
        yield ranges(list(_bucket(held, least)) if held else [])

    known = suffixes.filter("lead is null").select(
        "tk", "tx", F.col("first").alias("from"), (F.col("first") + least).alias("to"))
    return rows.mapInArrow(run, "tk bigint, tx bigint, from bigint, to bigint").union(known)


def repeated_ranges(keyed, packed, least=LEAST, hot=HOT):
    """Byte ranges of repeated windows per text: tk, tx, ranges (array of from << 32 | to)."""
    rows = _slice_rows(keyed, least)
    anchors = rows.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("slice").alias("s1"), F.max("slice").alias("s2")).filter("n > 1")
    anchors = anchors.select("anchor", (F.col("s1") != F.col("s2")).alias("mixed"))
    met = stored(lookup_join(rows, anchors, "anchor", "inner"))
    mixed = met.filter("mixed")
    classes = mixed.groupBy("anchor", "slice").agg(
        F.count("*").alias("n"), F.min(F.struct("tk", "tx", "first", "spread")).alias("at"))
    classes = stored(classes)
    total = classes.groupBy("anchor").agg(F.count("*").alias("classes"))
    wanted = lookup_join(classes, total, "anchor", "inner").select(
        "at.*", (F.col("n") > 1).alias("repeated"), (F.col("classes") > hot).alias("hot"))
    texts_once = packed.groupBy("tk", "tx").agg(F.first("packed").alias("packed"))
    suffixes = stored(_suffix_rows(texts_once, wanted, least, hot))
    agreed = lookup_join(mixed, classes.filter("n > 1").select("anchor", "slice"), ["anchor", "slice"], "inner")
    decided = met.filter("not mixed").select("tk", "tx", "first", "spread").union(
        agreed.select("tk", "tx", "first", "spread"))
    decided = decided.select(
        "tk", "tx", F.col("first").alias("from"), (F.col("first") + F.shiftright("spread", 16) + least).alias("to"))
    ranges = decided.union(_sorted_buckets(suffixes, least)).withColumn(
        "range", F.shiftleft("from", 32).bitwiseOR(F.col("to"))).select("tk", "tx", "range")
    # copies of a text name the same ranges; once is enough
    return ranges.distinct().groupBy("tk", "tx").agg(F.collect_list("range").alias("ranges"))


def _cut(raw, ranges):
    """(kept bytes, removed bytes, removed runs)"""
    if not ranges:
        return raw, 0, 0
    ranges = np.sort(np.array(ranges, np.int64))
    start, end = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
    kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
    return kept, len(raw) - len(kept), len(start)


def without_repeats(docs, least=LEAST, text_col="text", length_col="n_chars"):
    """The documents with their repeated bytes removed, all columns kept, the length column renewed.

    A row's text is looked up by what it was, so ids may be null or repeated.
    """
    ready(docs)
    keyed = _with_keys(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    found = repeated_ranges(keyed, stored(_packed(keyed)), least)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("_row"), F.xxhash64(text).alias("tk"),
        F.crc32(text.cast("binary")).bitwiseAND(F.lit(0xFFFF)).alias("tx"))
    rows = lookup_join(rows, found, ["tk", "tx"]).select("_row", "ranges")

    def run(batches):
        for batch in batches:
            kept = [None if t is None else t if not r else _cut(t.encode(), r)[0].decode("utf-8", "ignore")
                    for t, r in zip(batch.column(0).field(text_col).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["_row", "_kept"])

    row_type = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_row {row_type}, _kept string")
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {text_col: F.col("_kept")}
    if length_col in docs.columns:
        columns[length_col] = F.length("_kept").cast(docs.schema[length_col].dataType)
    return out.select(*[value.alias(name) for name, value in columns.items()])


def remove_repeats(docs, least=LEAST, id_col="doc_id", text_col="text", with_text=False):
    """Every byte covered by a ``least``-byte string that also starts anywhere else is removed.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``with_text``, the remaining text (parts of characters that a cut leaves are dropped).
    Matches never cross texts; overlapping ones inside one text count; all are judged on the
    input. A null text counts as empty; texts under ``least`` bytes lose nothing; copies of a
    text, and repeated rows, lose all of it; null ids stay null; an empty table gives no
    rows; extra columns are ignored.
    """
    ready(docs)
    keyed = _with_keys(documents(docs, id_col, text_col))
    packed = stored(_packed(keyed))
    found = repeated_ranges(keyed, packed, least)
    joined = lookup_join(packed, found, ["tk", "tx"]).select("doc_id", "packed", "ranges")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, kept_texts = [], []
            for blob, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = unpack.decompress(blob)
                kept, removed, spans = _cut(raw, ranges)
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()),
                 *([pa.array(kept_texts, pa.string())] if with_text else [])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(run, schema)
