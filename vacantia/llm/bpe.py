"""Byte-level BPE on all words of a batch at once, and the whole-text encoder (operator 9).

Ranked merges are folded over the byte arrays of distinct words only. ``fold_column`` does
that with Spark's higher-order functions and a literal rank map, word by word in the JVM;
``Merges.fold`` does the same fold over all words of an Arrow batch together, which is what
``encode`` runs (the README has the figures that decided this).
"""

import base64
import functools
import hashlib
import json
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from vacantia.llm import texts
from vacantia.llm.shared import documents, ready

NONE = np.iinfo(np.int64).max
SHIFT = 20
#: Words a worker remembers between batches; a full memory is emptied, not an error.
REMEMBER = 250_000


class Merges:
    """A merge table: ids of the single bytes, and (left id, right id) -> (rank, new id)."""

    def __init__(self, byte_ids, pairs, whole, pieces):
        self.byte_ids = np.array(byte_ids, np.int64)
        table = np.array(sorted((left << SHIFT | right, rank, made) for (left, right), (rank, made) in pairs.items()), np.int64)
        self.keys, self.ranks, self.made = table.T.copy()
        self.first = np.full((256, 256), -1, np.int64)  # place in keys of a pair of bytes
        of_byte = {i: b for b, i in enumerate(byte_ids)}
        for at, key in enumerate(self.keys.tolist()):
            left, right = of_byte.get(key >> SHIFT), of_byte.get(key & (1 << SHIFT) - 1)
            if left is not None and right is not None:
                self.first[left, right] = at
        self.whole, self.pieces, self.seen = whole, pieces, {}
        self.slots = np.full(1 << (4 * len(self.keys)).bit_length(), -1, np.int64)
        self.probes, rest = 0, np.arange(len(self.keys))
        while len(rest):  # of the keys that want a slot one gets it, the others try the next
            slot = self._slot(self.keys[rest]) + self.probes & len(self.slots) - 1
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            rest = rest[self.slots[slot] != rest]
            self.probes += 1

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(texts.STEP)) >> np.uint64(64 - len(self.slots).bit_length() + 1)).astype(np.int64)

    def place(self, left, right):
        """Place of each pair in the merge table, -1 where it has none."""
        key = left << SHIFT | right
        slot = self._slot(key)
        at = self.slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != key))
        for probe in range(1, self.probes):
            if not len(open_):
                return at
            at[open_] = self.slots[slot[open_] + probe & len(self.slots) - 1]
            open_ = open_[(at[open_] >= 0) & (self.keys[at[open_]] != key[open_])]
        at[open_] = -1
        return at

    def fold(self, words):
        """Ids of every word: (flat ids, offsets), by the lowest-ranked pair first, leftmost first."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, word = self.byte_ids[data], np.repeat(np.arange(len(words)), size)
        done_ids, done_words, fresh = [], [], True
        while len(ids):
            inside = word[1:] == word[:-1]
            at = np.full(len(ids), -1, np.int64)
            if fresh:
                at[:-1][inside] = self.first[data[:-1][inside], data[1:][inside]]
            else:
                at[:-1][inside] = self.place(ids[:-1][inside], ids[1:][inside])
            fresh = False
            rank = np.where(at >= 0, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, ~inside))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = best == NONE
            done_ids.append(ids[over])
            done_words.append(word[over])
            hit = (rank == best) & ~over
            # of a run of overlapping hits every second one merges, from the left
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            place = np.arange(len(ids))
            since = place - np.repeat(run, np.diff(np.append(run, len(ids))))[place - (run[0] if len(run) else 0)] if len(run) and not run[0] else place
            if len(run) and run[0]:
                since = np.zeros(len(ids), np.int64)
                since[run[0]:] = place[run[0]:] - np.repeat(run, np.diff(np.append(run, len(ids))))
            hit &= since % 2 == 0
            ids = np.where(hit, self.made[at], ids)
            keep = ~np.append(False, hit[:-1]) & ~over
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_words or [word])
        ids = ids[np.argsort(word, kind="stable")]
        return ids, np.append(0, np.cumsum(np.bincount(word, minlength=len(words)))).astype(np.int64)

    def encode(self, words):
        """Little-endian 32-bit ids of each word, as bytes; whole words first."""
        seen, whole = self.seen, self.whole
        if len(seen) > REMEMBER:
            seen.clear()
        out = [whole.get(w) or seen.get(w) for w in words]
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            ids, offsets = self.fold([words[k] for k in missing])
            raw, offsets = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
            for k, i, j in zip(missing, offsets, offsets[1:]):
                out[k] = raw[i:j]
                if len(words[k]) <= 64:
                    seen[words[k]] = out[k]
        return out


def _id(i):
    return int(i).to_bytes(4, "little")


@functools.cache
def rank_file(path):
    """Merges of a file of ranks: a pair merges if its bytes have a rank, which is also the id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank, rank
    whole = {token: _id(rank) for token, rank in ranks.items()}
    return Merges([ranks[bytes([b])] for b in range(256)], pairs, whole, {i: t for t, i in ranks.items()})


def byte_letters():
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


@functools.cache
def merge_file(path):
    """Merges of a vocabulary file with a list of merges.

    Proves which vocabulary strings encode alone as one token: each is folded by the
    merges, and only those that end as their own id may be counted without merging.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    bytes_of = {c: b for b, c in letters.items()}
    vocabulary = model["vocab"]
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
    strings = {i: bytes(bytes_of[c] for c in t) for t, i in vocabulary.items() if all(c in bytes_of for c in t)}
    merges = Merges([vocabulary[letters[b]] for b in range(256)], pairs, {}, strings)
    ids, offsets = merges.fold(list(strings.values()))
    alone = np.diff(offsets) == 1
    merges.whole = {t: _id(i) for (i, t), one, got in zip(strings.items(), alone, ids[offsets[:-1]].tolist()) if one and got == i}
    return merges


#: Buckets of the literal rank map: a lookup hashes to one and reads its few entries.
BUCKETS = 1 << 14


def _bucket(piece):
    return F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int")


@functools.cache
def _rank_text(path):
    """The rank map as one text: a line for each bucket with its ``hex:rank`` entries."""
    lines = [[] for _ in range(BUCKETS)]
    for token, rank in rank_file(path).whole.items():
        lines[zlib.crc32(token) % BUCKETS].append(f"{token.hex().upper()}:{int.from_bytes(rank, 'little')}")
    return "\n".join(",".join(line) for line in lines)


def fold_column(word, ranks=None):
    """Ids of a word (binary) by Spark's higher-order functions alone.

    The state is the array of the word's byte pieces. Every step looks up the rank of each
    pair of neighbours in a literal map, merges the first pair of the lowest rank, and the
    state stays once no pair has a rank. A word that has a rank itself is one token.
    """
    table = F.split(F.lit(_rank_text(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), "\n")

    def rank(piece):
        entries = F.str_to_map(F.get(table, _bucket(piece)), F.lit(","), F.lit(":"))
        return F.try_element_at(entries, F.hex(piece)).cast("int")

    def bound(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(state, _):
        pieces = state["pieces"]
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))))

        def merged(found):
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
            more = F.concat(F.slice(pieces, 1, at - 1), F.array(joined), F.slice(pieces, at + 2, F.size(pieces)))
            return F.when(F.array_min(found).isNull(), F.struct(pieces.alias("pieces"), F.lit(True).alias("done"))).otherwise(
                F.struct(more.alias("pieces"), F.lit(False).alias("done")))

        return F.when(state["done"] | (F.size(pieces) < 2), state).otherwise(bound(pairs, merged))

    size = F.octet_length(word)
    start = F.when(rank(word).isNotNull(), F.array(word)).otherwise(
        F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1))))
    folded = F.aggregate(F.sequence(F.lit(1), size), F.struct(start.alias("pieces"), F.lit(False).alias("done")), step)
    return F.when(size > 0, F.transform(folded["pieces"], rank)).otherwise(F.array().cast("array<int>"))


def encode(docs, ranks=None, id_col="doc_id", text_col="text", with_ids=False):
    """Encode every whole text by the ranks and decode it again, without special tokens.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, the ids.
    A null text counts as empty: no tokens, hashes of no bytes. Repeated rows give repeated
    rows; a null id stays null. Narrow: no shuffle, so hot ids or texts cannot pile up.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ready(docs)

    def run(batches):
        merges = rank_file(path)
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in texts.chunks(batch.column(1)):
                starts, ends = texts.pretokens(data, offsets)
                words, which = texts.distinct(data, starts, ends)
                coded = merges.encode(words)
                cuts = np.searchsorted(starts, offsets).tolist()
                n, hashes, back, lists = [], [], [], []
                for i, j in zip(cuts, cuts[1:]):
                    raw = b"".join(map(coded.__getitem__, which[i:j].tolist()))
                    tokens = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(tokens))
                    hashes.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(merges.pieces.__getitem__, tokens))).hexdigest())
                    if with_ids:
                        lists.append(tokens)
                columns = [ids.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(hashes), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded, ranks=None, ids_col="ids"):
    """Add ``decoded`` (binary): the pieces of the ids one after the other.

    Null ids give null; an id outside the vocabulary fails the row's task, as no bytes belong to it.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ready(encoded)

    @F.pandas_udf("binary")
    def join(ids: pd.Series) -> pd.Series:
        pieces = rank_file(path).pieces
        return ids.map(lambda row: None if row is None else b"".join(pieces[int(i)] for i in row))

    return encoded.withColumn("decoded", join(F.col(ids_col)))
