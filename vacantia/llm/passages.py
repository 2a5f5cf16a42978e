"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds (operator 2)."""

from difflib import SequenceMatcher
from itertools import accumulate
from operator import gt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from vacantia.llm import texts
from vacantia.llm.shared import documents, ready, text_key
from vacantia.operators.joins import lookup_join
from vacantia.session import drop_path, scratch_path

U = np.uint64
#: Words of a seed. Every run of so many words is one: of 50 columns with 10 differences, 40 matches
#: fall into 11 runs at most, so 7 seeds are common at least.
SEED = 4
#: Words of a key, by which texts meet. Of 50 columns with 10 differences, 18 keys are common at least.
KEY = 3
#: A passage has at least so many words, of which so many in a hundred agree.
LEAST_WORDS, PERCENT = 50, 80
#: Documents and bytes of a pack, whose seeds travel together, and packs of an Arrow batch.
PACK, PACK_BYTES, PACKS = 128, 2_000_000, 32
#: Packs for which one more bucket of seeds is used, and the least number of buckets.
PER_BUCKET, BUCKETS = 32, 64
#: Every so many matches in a row of one diagonal are chained, with the first and the last.
THIN = 16
#: Lengths of a passage's part that are tried with one window.
WIDER = 10
#: Places from one tried window of keys to the next.
STRIDE = 8
#: Holders of a seed in one block where all pairs of them meet.
BLOCK = 256
#: Words of unpacked texts that a task keeps, at 24 bytes.
KNOWN = 1 << 21
#: Texts and bytes of a block, of which two make a cell, and the most files that hold blocks: a task compares two of them.
CELL, CELL_BYTES, TASKS = 4096, 4_000_000, 1000
#: Meetings of keys in a cell that are worked on at once, and rows of a batch of passages.
MEETINGS, FOUND = 1 << 21, 10_000
#: The setting by which shuffle files go when a query ends, and bytes of a row group of a stored table.
CLEANUP, ROW_GROUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", 16_000_000
#: Words left out of either text at a difference, with the larger of both, and words times words that are aligned exactly.
SKIPS = ((1, 1, 1), (1, 0, 1), (0, 1, 1), (2, 2, 2), (2, 1, 2), (1, 2, 2), (2, 0, 2), (0, 2, 2))
SMALL = 2500
#: What a chain loses for each word it skips, in words.
GAP = 0.04
#: A passage ends where its score (1 a match, -4 a difference) has fallen by this much.
DROP = 40


def word_hashes(data, offsets):
    """Hash of every word (A-Z lower-cased) of the texts, and the texts' cuts in them."""
    data = texts.lower(data)
    starts, ends = texts.word_spans(data, offsets)
    words = texts.span_hash(texts.prefix_sums(data), starts, ends, 5) if len(starts) else np.zeros(0, U)
    return words, np.searchsorted(starts, offsets)


def seeds(words, size=SEED):
    """Hash of the run of ``size`` words at every place of one text."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, U)
    run = words[:n].copy()
    for k in range(1, size):
        run = texts.mix(run * U(texts.STEP) + words[k : n + k])
    return run


def needed(least=LEAST_WORDS, percent=PERCENT, size=SEED):
    """Runs of ``size`` words that two texts share at least in ``least`` columns, ``percent`` of them matches."""
    matches = -(-least * percent // 100)
    return max(1, matches - (size - 1) * (least - matches + 1))


def dense(shared, least, percent, size=SEED):
    """Which of the shared seeds (runs of ``size`` words) of a text have enough others around them to be in a passage.

    A passage of 2 * least columns or more holds a part of least to 2 * least columns that is
    as much alike, so a window of that width around a passage's seeds holds ``needed`` ones.
    """
    at = np.flatnonzero(shared)
    n = needed(least, percent, size)
    if len(at) < n:
        return np.zeros(0, np.int64)
    full = at[n - 1 :] - at[: len(at) - n + 1] <= 2 * least
    keep = np.zeros(len(at) + 1, np.int64)
    np.add.at(keep, np.flatnonzero(full), 1)
    np.add.at(keep, np.flatnonzero(full) + n, -1)
    return at[np.cumsum(keep)[:-1] > 0]


def rarest(rank, least, percent, size=KEY):
    """Places of a text whose keys are enough for it to meet every text it shares a passage with.

    ``rank`` grows with the number of texts that hold a key, differs from key to key, is the same
    in all texts, and is 0 where only one text holds the key. A passage has a part of ``least`` to
    2 * least columns that is as much alike, and a part of n columns holds ``needed(n)`` common
    keys within n words of either text. So the rarest common one has needed(n) - 1 others of
    higher or equal rank around it, in both texts. Places without are left out, such as those of
    a line that very many texts hold but that is short of a passage. Windows are tried STRIDE
    places apart and wider by as much, which keeps some places too many, never one too few.
    """
    at = dense(rank > 0, least, percent, size)
    if not len(at):
        return at
    held, out = np.zeros(len(rank), np.int64), []
    held[at] = rank[at]
    for near in np.split(at, np.flatnonzero(np.diff(at) > 2 * least) + 1):
        part = held[near[0] : near[-1] + 1]
        blocks = -(-len(part) // STRIDE)
        best = np.zeros(blocks, np.int64)
        for low in range(least, 2 * least + 1, WIDER):
            high = min(low + WIDER - 1, 2 * least)
            need = min(needed(n, percent, size) for n in range(low, high + 1))
            width = high - size + STRIDE
            padded = np.append(part, np.zeros((blocks - 1) * STRIDE + width, np.int64))
            windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: blocks * STRIDE : STRIDE]
            limit = np.partition(windows, width - need, axis=1)[:, width - need]
            # a place is in the windows that start in its block or in one of the blocks before
            reach = -(-width // STRIDE)
            limit = np.append(np.zeros(reach - 1, np.int64), limit)
            best = np.maximum(best, np.lib.stride_tricks.sliding_window_view(limit, reach).max(axis=1))
        out.append(near[0] + np.flatnonzero((part > 0) & (part <= np.repeat(best, STRIDE)[: len(part)])))
    return np.concatenate(out)


def promising(pairs_a, pairs_b, least=LEAST_WORDS, percent=PERCENT, there=None):
    """Whether a passage is possible between two texts, by the word pairs of both (``there``: those of b, sorted).

    A passage has a part of least to 2 * least columns that is as much alike, and a part of n
    columns holds ``needed(n)`` common word pairs within n words of the first text. A False is
    certain; it takes a sixth of the time of chaining.
    """
    if not len(pairs_a) or not len(pairs_b):
        return needed(least, percent, 2) <= 1
    there = np.sort(pairs_b) if there is None else there
    at = np.searchsorted(there, pairs_a)
    at[at == len(there)] = 0
    met = np.append(0, np.cumsum(there[at] == pairs_a))
    for low in range(least, 2 * least + 1, WIDER):
        high = min(low + WIDER - 1, 2 * least)
        width = min(high, len(met) - 1)
        if (met[width:] - met[: len(met) - width]).max() >= min(needed(n, percent, 2) for n in range(low, high + 1)):
            return True
    return False


def roomy(words, there, least=LEAST_WORDS, percent=PERCENT):
    """Whether a passage is possible by the words of a text and ``there``, the sorted words of another.

    A part of n columns, least to 2 * least, has its matches one to one within n words of the first
    text. So of a row of one word no more of them match than the other text holds, and a text that
    says one word very often has no passage in common with all that say it a few times. A row adds
    to the windows around it a rise, a level and a fall. A False is certain.
    """
    head = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(words)))
    held = np.searchsorted(there, words[head], "right") - np.searchsorted(there, words[head], "left")
    head, size, held = head[held > 0], size[held > 0], held[held > 0]
    for low in range(least, 2 * least + 1, WIDER):
        width = min(low + WIDER - 1, 2 * least)
        most = np.minimum(np.minimum(size, held), width)
        rise, fall = head, head + size - most + width
        bend = sum(sign * np.bincount(at, minlength=len(words) + width + 1)
                   for sign, at in ((1, rise), (-1, rise + most), (-1, fall), (1, fall + most)))
        if np.cumsum(np.cumsum(bend)).max() >= needed(low, percent, 1):
            return True
    return False


def matches(ha, hb, possible=None):
    """Places (x, y) where two texts have equal seeds, at every place of either.

    Where a seed stands at several places, they are only put together if ``possible()`` holds.
    """
    order = np.argsort(hb, kind="stable")
    left, right = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    n = right - left
    if possible and (n > 1).any() and not possible():
        n[:] = 0
    x = np.repeat(np.arange(len(ha)), n)
    y = order[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)]
    # in a row of matches on one diagonal the words between are equal: a few of them are enough
    by = np.lexsort((x, x - y))
    x, y = x[by], y[by]
    first = np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1))[: len(x)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    keep = first | np.append(first[1:], True)[: len(x)] | ((np.arange(len(x)) - start) % THIN == 0)
    return x[keep], y[keep]


def chain(x, y, weight=SEED, gap=GAP):
    """Best chains of matches (x[k], y[k]): lists of indices, both places growing, best first.

    A match adds ``weight``; going on from match j to i costs ``gap`` for every word between
    them on either side. That cost falls apart into a part of i and a part of j, so the best
    match to go on from is a prefix maximum over y, kept in a Fenwick tree.
    """
    n = len(x)
    order = np.lexsort((-y, x)).tolist()
    rank = np.unique(y, return_inverse=True)[1].tolist()
    xs, ys = x.tolist(), y.tolist()
    size = max(rank) + 2
    tree, by = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    for k in order:
        best, before, at = -1e18, -1, rank[k]
        while at > 0:
            if tree[at] > best or tree[at] == best and by[at] > before:
                best, before = tree[at], by[at]
            at &= at - 1
        here = xs[k] + ys[k]
        gain = best - gap * here
        score[k], back[k] = (weight + gain, before) if gain > 0 else (float(weight), -1)
        put, at = score[k] + gap * here, rank[k] + 1
        while at <= size:
            if put > tree[at] or put == tree[at] and k > by[at]:
                tree[at], by[at] = put, k
            at += at & -at
    used, out = [False] * n, []
    for k in sorted(range(n), key=score.__getitem__, reverse=True):
        path = []
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(k)
            k = back[k]
        if path:
            out.append(path[::-1])
    return out


def _columns(a, b, i, j, k, m):
    """Alignment of a[i:j] and b[k:m]: (match, place in a, place in b) per column."""
    if j - i == m - k and (a[i:j] == b[k:m]).all():
        return [(True, i + d, k + d) for d in range(j - i)]
    if (j - i) * (m - k) <= SMALL:
        return _fewest(a, b, i, j, k, m)
    out = []
    blocks = SequenceMatcher(None, a[i:j].tolist(), b[k:m].tolist(), autojunk=False).get_matching_blocks()
    p = q = 0
    for at, bt, size in blocks:
        for d in range(max(at - p, bt - q)):
            out.append((False, i + min(p + d, at), k + min(q + d, bt)))
        out += [(True, i + at + d, k + bt + d) for d in range(size)]
        p, q = at + size, bt + size
    return out


def _fewest(a, b, i, j, k, m):
    """Alignment of a[i:j] and b[k:m] with the best score: 1 a match, -4 a difference."""
    if i == j or k == m:
        return [(False, i + min(d, j - i), k + min(d, m - k)) for d in range(max(j - i, m - k))]
    x, y = a[i:j].tolist(), b[k:m].tolist()
    rows = [[-4 * q for q in range(len(y) + 1)]]
    for p, word in enumerate(x):
        above, here = rows[-1], [-4 * (p + 1)]
        for q, other in enumerate(y):
            here.append(max(above[q] + (1 if word == other else -4), above[q + 1] - 4, here[q] - 4))
        rows.append(here)
    p, q, out = len(x), len(y), []
    while p or q:
        same = bool(p and q and x[p - 1] == y[q - 1])
        if p and q and rows[p][q] == rows[p - 1][q - 1] + (1 if same else -4):
            p, q = p - 1, q - 1
        elif p and rows[p][q] == rows[p - 1][q] - 4:
            p, same = p - 1, False
        else:
            q, same = q - 1, False
        out.append((same, i + p, k + q))
    return out[::-1]


def _grow(a, b, i, k, step):
    """Extend from (i, k) while the score does not fall too far: columns outward, a match last.

    ``a`` and ``b`` are lists. At a difference the words to leave out are those after which most
    words agree; a way that cannot be better by the one word that decides it is not counted out.
    Where no word is common to both in the reach of the differences allowed, nothing follows.
    """
    reach = DROP // 4 + 3
    n, m = (len(a) - i, len(b) - k) if step > 0 else (i + 1, k + 1)
    out, p, q, score, best, end = [], 0, 0, 0, 0, 0
    while p < n and q < m and best - score <= DROP:
        if a[i + step * p] == b[k + step * q]:
            while p < n and q < m and a[i + step * p] == b[k + step * q]:
                out.append((True, i + step * p, k + step * q))
                p, q, score = p + 1, q + 1, score + 1
            end = len(out)
            best = max(best, score)
            continue
        if score == best:
            x, y = ((a[i + p : i + p + reach], b[k + q : k + q + reach]) if step > 0 else
                    (a[max(0, i - p - reach + 1) : i - p + 1], b[max(0, k - q - reach + 1) : k - q + 1]))
            if set(x).isdisjoint(y):
                break
        skip, value = (1, 1, 1), -5
        for d, e, wide in SKIPS:
            least = value + 4 * wide + 1
            s, t = p + d, q + e
            if least and (least > 9 or s + least > n or t + least > m or a[i + step * (s + least - 1)] != b[k + step * (t + least - 1)]):
                continue
            run = 0
            while run < 9 and s + run < n and t + run < m and a[i + step * (s + run)] == b[k + step * (t + run)]:
                run += 1
            if run >= least:
                skip, value = (d, e, wide), run - 4 * wide
        d, e, wide = skip
        out.append((False, i + step * p, k + step * q))
        if wide == 2:
            out.append((False, i + step * (p + min(1, d)), k + step * (q + min(1, e))))
        p, q, score = p + d, q + e, score - 4 * wide
    return out[:end]


def passages(a, b, least=LEAST_WORDS, percent=PERCENT):
    """Passages two texts share: (start and end in a, start and end in b, words, matches)."""
    possible = lambda: roomy(a, np.sort(b), least, percent) and roomy(b, np.sort(a), least, percent)
    x, y = matches(seeds(a), seeds(b), possible)
    if not len(x):
        return []
    paths, out = chain(x, y), []
    first, last = (np.array([p[k] for p in paths]) for k in (0, -1))
    box = x[first], x[last] + SEED, y[first], y[last] + SEED
    covered = np.zeros(len(paths), bool)
    words = a.tolist(), b.tolist()
    for turn, path in enumerate(paths):
        if covered[turn]:
            continue
        i, k = int(x[path[0]]), int(y[path[0]])
        columns = _grow(*words, i - 1, k - 1, -1)[::-1]
        for at in path:
            xs, ys = int(x[at]), int(y[at])
            if xs >= i and ys >= k:
                columns += _columns(a, b, i, xs, k, ys)
                i, k = xs, ys
            skip = max(0, i - xs, k - ys)
            columns += [(True, xs + d, ys + d) for d in range(skip, SEED)] if xs + skip == i and ys + skip == k else []
            if columns:
                i, k = columns[-1][1] + 1, columns[-1][2] + 1
        columns += _grow(*words, i, k, 1)
        covered |= (box[0] >= columns[0][1]) & (box[1] <= columns[-1][1] + 1) & (box[2] >= columns[0][2]) & (box[3] <= columns[-1][2] + 1)
        out += _cut(columns, least, percent)
    return out


def _cut(columns, least, percent):
    """The stretches of an alignment that hold: long enough and alike enough.

    These are the stretches of highest score; where none is long enough, the longest ones
    that are still alike enough.
    """
    if len(columns) < least:
        return
    if all(match for match, _, _ in columns):
        yield columns[0][1], columns[-1][1] + 1, columns[0][2], columns[-1][2] + 1, len(columns), len(columns)
        return
    surplus = list(accumulate((100 * match - percent for match, _, _ in columns), initial=0))
    # the highest surplus from each place on: none is above the surplus at a place without a stretch that holds
    later = list(accumulate(reversed(surplus), max))[::-1]
    if all(map(gt, surplus, later[least:])):
        return
    at = 0
    for i, j in [*_peaks(columns, least, percent), (len(columns), len(columns))]:
        for p, q in [*_longest(columns, at, i, least, percent, surplus, later), (i, j)]:
            if q > p:
                part = columns[p:q]
                yield part[0][1], part[-1][1] + 1, part[0][2], part[-1][2] + 1, len(part), sum(m for m, _, _ in part)
        at = j


def _longest(columns, at, end, least, percent, surplus, later):
    """The longest stretches of columns[at:end] alike enough, from match to match, left to right."""
    while at <= end - least:
        score = best = met = 0
        last = at
        for k in range(at, end if columns[at][0] and surplus[at] <= later[at + least] else at):
            met += columns[k][0]
            score += 1 if columns[k][0] else -4
            best = max(best, score)
            if best - score > DROP:
                break
            if columns[k][0] and 100 * met >= percent * (k + 1 - at):
                last = k + 1
        if last - at >= least:
            yield at, last
            at = last
        else:
            at += 1


def _peaks(columns, least, percent):
    score = best = 0
    start = peak = None
    for at, (match, _, _) in enumerate([*columns, *[(False, 0, 0)] * (DROP // 4 + 1)]):
        if match and start is None:
            start, score, best, peak = at, 0, 0, at
        if start is None:
            continue
        score += 1 if match else -4
        if score >= best:
            best, peak = score, at
        if best - score > DROP or score < 0:
            part = columns[start : peak + 1]
            matches = sum(m for m, _, _ in part)
            if len(part) >= least and 100 * matches >= percent * len(part):
                yield start, peak + 1
            start = None


def _words(blobs):
    """Word hashes of packed texts, one array each."""
    unpack = zstandard.ZstdDecompressor()
    raw = [unpack.decompress(b) for b in blobs]
    words, cuts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))
    return [words[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


class _Known(dict):
    """Words, word pairs and sorted word pairs of packed texts; the latest ones, KNOWN words in all, are kept."""

    held = 0

    def __missing__(self, packed):
        words = _words([packed])[0]
        pairs = seeds(words, 2)
        while self and self.held + len(words) > KNOWN:
            self.held -= len(self.pop(next(iter(self)))[0])
        self.held += len(words)
        self[packed] = words, pairs, np.sort(pairs)
        return self[packed]


def _packs(single):
    """``single`` with many documents in a row: pack, members (rep, first_id, packed, n_words)."""
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("first_id", pa.int64()), ("packed", pa.binary()), ("n_words", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows, part, size = batch.to_pylist(), [], 0
            for row in [*rows, None]:
                if part and (row is None or len(part) == PACK or size + len(row["packed"]) > PACK_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([part[0]["rep"]]), pa.array([part], kind)], ["pack", "members"])
                    part, size = [], 0
                if row is not None:
                    part.append(row)
                    size += len(row["packed"])

    return single.select("rep", "first_id", "packed", "n_words").mapInArrow(
        run, "pack bigint, members array<struct<rep: bigint, first_id: bigint, packed: binary, n_words: bigint>>")


def _distinct_keys(members, buckets):
    """Keys of a pack: per place which distinct one, cuts between members, the distinct ones and their buckets.

    The last two are in order of bucket, then value; the places refer to them. Also how many
    members hold each.
    """
    each = [seeds(w, KEY) for w in _words([m["packed"] for m in members])]
    cuts = np.append(0, np.cumsum([len(e) for e in each]))
    once, place = np.unique(np.concatenate(each), return_inverse=True)
    held = np.bincount(np.concatenate([np.unique(place[i:j]) for i, j in zip(cuts.tolist(), cuts[1:].tolist())]), minlength=len(once))
    bucket = ((once >> U(40)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[place], cuts, once[order], bucket[order], held[order]


def _held_keys(packs, buckets):
    """A byte per pack, bucket and distinct key of the pack: how many texts hold the key, 0 for one, else by its logarithm.

    40 bits of a key and its bucket stand for it; what they take for shared by chance only
    costs time. A key comes once from a pack, so one that all documents hold stays small.
    A pack sends rows for the buckets its keys fall into, never more than it has keys.
    """
    def send(batches):
        for batch in batches:
            for pack, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, once, bucket, held = _distinct_keys(members, buckets)
                used, starts = np.unique(bucket, return_index=True)
                cuts = [*starts.tolist(), len(once)]
                short = np.ascontiguousarray(once).view(np.uint8).reshape(-1, 8)[:, :5]
                blobs = [[part[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for part in (short, held.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array([pack] * len(used), pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]], ["bucket", "pack", "short", "held"])

    def decide(bucket, rows):
        long = []
        for _, blob, _ in rows:
            value = np.zeros((len(blob) // 5, 8), np.uint8)
            value[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            long.append(value.view(U).ravel())
        value, place = np.unique(np.concatenate(long), return_inverse=True)
        texts_with = np.bincount(place, weights=np.frombuffer(b"".join(r[2] for r in rows), np.uint8))
        level = np.where(texts_with > 1, np.minimum(255, 8 * np.log2(np.maximum(texts_with, 1))), 0).astype(np.uint8)[place]
        cuts = np.cumsum([0, *[len(v) for v in long]]).tolist()
        levels = [level[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([bucket] * len(rows)), pa.array(levels, pa.binary())], ["pack", "bucket", "levels"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and bucket != now:
                    yield decide(now, rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield decide(now, rows)

    sent = packs.mapInArrow(send, "bucket bigint, pack bigint, short binary, held binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "pack bigint, bucket bigint, levels binary")


class _Block:
    """Texts that may meet others, with the keys they send: filled one by one, then a row of binary columns."""

    names = ("reps", "firsts", "shared", "sizes", "packed", "seeds", "own")

    def __init__(self):
        self.texts, self.seeds, self.size = [], [], 0

    def full(self):
        return len(self.texts) >= CELL or self.size >= CELL_BYTES

    def add(self, member, shared, seeds):
        self.texts.append((member["rep"], member["first_id"], shared, member["packed"]))
        self.seeds.append(seeds)
        self.size += len(member["packed"])

    def row(self):
        reps, firsts, shared, packed = zip(*self.texts)
        seeds, own = np.concatenate(self.seeds), np.repeat(np.arange(len(reps), dtype=np.int32), [len(s) for s in self.seeds])
        order = np.argsort(seeds, kind="stable")
        blobs = [
            np.array(reps, np.int64), np.array(firsts, np.int64), np.array(shared, bool), np.array([len(p) for p in packed], np.int32),
            b"".join(packed), seeds[order], own[order]]
        return pa.RecordBatch.from_arrays(
            [pa.array([reps[0]], pa.int64()), pa.array([any(shared)]), *[pa.array([bytes(x)], pa.binary()) for x in blobs]],
            ["block", "any_shared", *self.names])


def _blocks(packs, levels, shared, least, percent):
    """Blocks of the texts that hold keys by which texts meet (``rarest``), with those keys: a row of at most CELL texts.

    ``shared`` has the texts (pack, rep) whose id other texts have as well.
    """
    def run(batches):
        block = _Block()
        for batch in batches:
            for members, got, again in zip(*(c.to_pylist() for c in batch.columns)):
                place, cuts, once, bucket, _ = _distinct_keys(members, buckets)
                of = {g["bucket"]: g["levels"] for g in got}
                level = np.frombuffer(b"".join(of[k] for k in np.unique(bucket).tolist()), np.uint8)
                rank = np.where(level > 0, (level.astype(np.int64) << 55) | (once >> U(9)).astype(np.int64), 0)
                again = set(again or ())
                for member, i, j in zip(members, cuts.tolist(), cuts[1:].tolist()):
                    sent = once[np.unique(place[i:j][rarest(rank[place[i:j]], least, percent)])]
                    if len(sent):
                        block.add(member, member["rep"] in again, sent)
                    if block.full():
                        yield block.row()
                        block = _Block()
        if block.texts:
            yield block.row()

    buckets = _buckets(packs)
    got = levels.groupBy("pack").agg(F.collect_list(F.struct("bucket", "levels")).alias("got"))
    again = shared.groupBy("pack").agg(F.collect_list("rep").alias("again"))
    rows = packs.join(got, "pack").join(again, "pack", "left").select("members", "got", "again")
    return rows.coalesce(TASKS).mapInArrow(run, "block bigint, any_shared boolean, " + ", ".join(f"{n} binary" for n in _Block.names))


def _buckets(packs):
    return max(BUCKETS, packs.count() // PER_BUCKET)


def _pack(docs):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            words = [len(t.split()) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([pack.compress(t) for t in raw], pa.binary()), pa.array(words, pa.int64())],
                ["doc_id", "text_key", "packed", "n_words"])

    return docs.mapInArrow(run, "doc_id bigint, text_key binary, packed binary, n_words bigint")


class _Side:
    """The texts of a block as a cell reads them."""

    def __init__(self, reps, firsts, shared, sizes, packed, seeds, own):
        self.reps, self.firsts = (np.frombuffer(x, np.int64).tolist() for x in (reps, firsts))
        self.shared = np.frombuffer(shared, bool)
        self.cuts = np.append(0, np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)).tolist()
        self.packed, self.seeds, self.own = packed, np.frombuffer(seeds, U), np.frombuffer(own, np.int32)

    def text(self, at):
        return bytes(self.packed[self.cuts[at] : self.cuts[at + 1]])


def _met(a, b):
    """Places (in a, in b) of the texts of two sides that have a key in common, each pair once, by place."""
    left, right = np.searchsorted(a.seeds, b.seeds, "left"), np.searchsorted(a.seeds, b.seeds, "right")
    n = right - left
    total = np.append(0, np.cumsum(n))
    met = np.zeros(len(a.reps) * len(b.reps), bool)
    for low in range(0, int(total[-1]), MEETINGS):
        # of the meetings, in order of b's keys, those from low on
        at = np.arange(low, min(low + MEETINGS, int(total[-1])))
        key = np.searchsorted(total, at, "right") - 1
        met[a.own[left[key] + at - total[key]].astype(np.int64) * len(b.reps) + b.own[key]] = True
    return np.divmod(np.flatnonzero(met), len(b.reps))


def _compared(blocks, least, percent, shared):
    """Passages of the pairs of texts that meet; a pair is chained only where its word pairs leave room for a passage.

    Two blocks are a cell, each two of them once, and a cell finds its own pairs. Blocks are read where
    they are stored, once for each file they meet, so neither texts nor pairs nor passages are shuffled and the
    disk holds every text once, however many pairs there are. ``shared`` tells whether to take the pairs with a
    text whose id other texts have as well, or the others: only of the first two pairs can give equal rows.
    """
    sides = [blocks.select([F.col(n).alias(f"{n}_{side}") for n in blocks.columns]) for side in "ab"]
    here, there = F.col("block_a"), F.col("block_b")
    # of (i, j) and (j, i) one is taken, so that any two files have about as much to do
    once = (here == there) | ((here < there) == (here.bitwiseXOR(there).bitwiseAND(F.lit(1)) == 0)) & (here != there)
    if shared:
        once = once & (F.col("any_shared_a") | F.col("any_shared_b"))
    cells = sides[0].join(sides[1].hint("shuffle_replicate_nl"), once)
    cells = cells.select("block_a", "block_b", *[f"{n}_{side}" for side in "ab" for n in _Block.names])
    names = ["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "n_words", "n_matches"]

    def rows(known, x, y, same):
        for i, j in zip(*(p.tolist() for p in _met(x, y))):
            if same and i >= j or bool(x.shared[i] or y.shared[j]) != shared:
                continue
            (side_a, p), (side_b, q) = ((x, i), (y, j)) if x.reps[i] < y.reps[j] else ((y, j), (x, i))
            id_a, id_b = side_a.firsts[p], side_b.firsts[q]
            a, pairs_a, there_a = known[side_a.text(p)]
            b, pairs_b, there_b = known[side_b.text(q)]
            if promising(pairs_a, pairs_b, least, percent, there_b) and promising(pairs_b, pairs_a, least, percent, there_a):
                yield from dict.fromkeys(
                    ((id_b, k, m, id_a, i, j) if id_a <= id_b else (id_a, i, j, id_b, k, m)) + (n, met)
                    for i, j, k, m, n, met in passages(a, b, least, percent))

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found)) or [[]] * len(names)], names)

    def run(batches):
        known, sides = _Known(), {}
        for batch in batches:
            for at in range(batch.num_rows):
                keys, now = [batch.column(k)[at].as_py() for k in range(2)], {}
                for side, key in enumerate(keys):
                    first = 2 + side * len(_Block.names)
                    now[key] = sides.get(key) or _Side(*[memoryview(batch.column(first + k)[at].as_py()) for k in range(len(_Block.names))])
                sides, found = now, []
                for row in rows(known, now[keys[0]], now[keys[1]], keys[0] == keys[1]):
                    found.append(row)
                    if len(found) == FOUND:
                        yield batch_of(found)
                        found = []
                yield batch_of(found)

    return cells.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _all_pairs(rows):
    """Pairs (a < b) of the holders of each seed; holders of one seed meet block by block.

    As a table, these pairs take a row for each seed two texts have in common: only tests use it, to check the cells.
    """
    many = rows.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
    rows = lookup_join(rows, many.select("seed", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "seed", "inner")
    rows = rows.withColumn("own", F.pmod(F.hash("rep"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = rows.select("seed", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    left, right = (group.withColumnRenamed("rep", c) for c in "ab")
    return left.join(right, ["seed", "i", "j"]).filter("a < b").select("a", "b").distinct()


def _kept(df):
    """``stored`` in row groups that a task can hold, with its path; the shuffle files it took go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # rows may be large, so the size is looked at from the first row on
        df.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def shared_passages(docs, least=LEAST_WORDS, percent=PERCENT, id_col="doc_id", text_col="text"):
    """Passages of ``least`` words or more that documents share, ``percent`` of them alike.

    Returns one row per passage of a document and a document it shares it with: doc_id,
    start_word, end_word, source_id, source_start, source_end, n_words, n_matches, is_copy.

    Texts meet by common keys, runs of KEY words. Of the keys that several texts hold, each text
    sends those that can be the rarest of a passage (``rarest``): two texts that share a passage
    send one in common, while a line that very many texts hold, but that is shorter than a
    passage, is mostly not sent. All pairs of holders of a key are compared, whatever other
    passages connect them. Pairs with too few common word pairs drop out before they are
    chained; neither test loses a passage of replaced words. The work grows with the pairs that
    share a passage: n texts that all hold one are n * (n - 1) / 2 pairs, and as many rows.
    A pair is chained on all its common seeds (``chain``), its chains are aligned, and
    stretches that hold are kept (``_cut``). Copies of a whole text of ``least`` words give
    one row (is_copy) to the smallest id with that text, which alone is compared with others.

    Null or short texts have no passages; rows without an id are left out, as no row could
    name them; rows with equal ids and texts are one document, and equal ids with different
    texts are compared as different texts; extra columns are ignored; an empty table gives
    no rows.
    """
    spark = ready(docs)
    named = documents(docs, id_col, text_col).filter("doc_id is not null")
    text = F.coalesce(F.col("text"), F.lit(""))
    made = _pack(named.select("doc_id", text.alias("text"), text_key(text).alias("text_key"))).filter(F.col("n_words") >= least // 2)
    single = made.groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"), F.first("packed").alias("packed"), F.first("n_words").alias("n_words"))
    # 64 bits of the text's key name it in the seed table
    single = single.withColumn("rep", F.xxhash64("text_key"))
    packs, packs_at = _kept(_packs(single))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PACKS))
    levels, levels_at = _kept(_held_keys(packs, _buckets(packs)))
    single = packs.select("pack", F.explode("members").alias("m")).select("pack", "m.rep", "m.first_id", "m.n_words")
    again, again_at = _kept(lookup_join(single, single.groupBy("first_id").agg(F.count("*").alias("n")).filter("n > 1"), "first_id", "inner").select("pack", "rep"))
    blocks, _ = _kept(_blocks(packs, levels, again, least, percent))
    single, _ = _kept(single.select("rep", "first_id", "n_words"))
    ready(docs)
    shared = not again.isEmpty()
    for path in (packs_at, levels_at, again_at):
        drop_path(spark, path)
    fuzzy = _compared(blocks, least, percent, False)
    if shared:
        fuzzy = fuzzy.union(_compared(blocks, least, percent, True).distinct())
    fuzzy = fuzzy.withColumn("is_copy", F.lit(False))
    owners = single.filter(F.col("n_words") >= least).select(F.col("rep").alias("text_rep"), "first_id", "n_words")
    zero = F.lit(0).cast("bigint")
    copies = lookup_join(named.select("doc_id", F.xxhash64(text_key(text)).alias("text_rep")), owners, "text_rep", "inner").filter("doc_id <> first_id")
    copies = copies.select(
        "doc_id", zero.alias("start_word"), F.col("n_words").alias("end_word"), F.col("first_id").alias("source_id"),
        zero.alias("source_start"), F.col("n_words").alias("source_end"), "n_words", F.col("n_words").alias("n_matches"),
        F.lit(True).alias("is_copy")).distinct()
    return fuzzy.union(copies)
