"""Texts of an Arrow batch as one byte array: words, pre-tokens and hashes without Python loops."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

U = np.uint64
STEP = 0x9E3779B97F4A7C15
SPACES = b" \t\n\x0b\x0c\r"


def mix(x):
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _tables():
    letters = mix(np.arange(1, 257, dtype=U) * U(STEP)) | U(1)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return letters, space, mix(letters) | U(1)


@functools.cache
def _powers(size):
    """STEP ** i and its inverse, modulo 2 ** 64."""
    out = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(size, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


def powers(n):
    return _powers(max(1 << 20, 1 << int(n).bit_length()))


def chunks(column, limit=2 << 20):
    """Yield (first row, byte array, offsets) for runs of rows with about ``limit`` bytes.

    Null texts count as empty. A longer text comes alone.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def owner(offsets, positions):
    """Index of the text that holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def prefix_sums(data, table=0):
    """Sums from which ``span_hash`` takes the hash of any span."""
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_tables()[table][data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums, starts, ends, seed=1):
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(seed * 2 + 1))


def word_spans(data, offsets):
    """Start and end of every run free of ASCII white space; runs end at text ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_tables()[1][data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = word[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lower(data):
    """A-Z to a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def distinct(data, starts, ends):
    """Distinct spans: (their bytes, index of each span among them).

    Spans are grouped by one 64-bit hash; the grouping holds only if an unrelated second
    hash agrees on every span, otherwise the bytes themselves are compared.
    """
    sums = prefix_sums(data)
    keys = span_hash(sums, starts, ends)
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    raw = data.tobytes()
    proof = span_hash(prefix_sums(data, 2), starts, ends, 7)
    if (proof[first][inverse] == proof).all():
        return [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())], inverse
    seen = {}
    inverse = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(starts.tolist(), ends.tolist())])
    return list(seen), inverse


SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def _classes():
    """Class of every code point, as the pattern of the rank files tells them apart."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = "".join(map(chr, codes))
    table = np.full(0x110000, OTHER, np.uint8)
    codes = np.array(codes)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, chars):
            table[codes[found.start() : found.end()]] = kind
    return table


def pretokens(data, offsets):
    """Start and end (in bytes) of the pieces that byte-level BPE merges separately.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    runs of one class, where the last blank before a run belongs to it, and where an
    apostrophe that starts a piece takes the contraction after it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = _classes()[code]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
    head[n] = True
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | head[1:n]
    run = np.flatnonzero(start[:n])
    stop = np.append(run[1:], n)
    follows = ~head[stop]
    # the last white space before something else stands alone or joins what follows
    gap = follows & (kind[run] == SPACE)
    start[stop[gap] - 1] = True
    blank = gap & (code[stop - 1] == 32)
    start[stop[blank]] = False
    mark = np.flatnonzero((code[run] == 39) & (stop - run == 1) & follows & start[run])
    mark = mark[kind[stop[mark]] == LETTER]
    if len(mark):
        at, end = stop[mark], stop[mark + 1]
        one = code[at]
        two = np.where(at + 1 < end, code[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 1, np.where(long, 2, 0))
        start[at[size > 0]] = False
        rest = (size > 0) & (at + size < end)
        start[(at + size)[rest]] = True
    first = np.flatnonzero(start[:n])
    lead = np.append(lead, len(data))
    return lead[first], lead[np.append(first[1:], n)]
