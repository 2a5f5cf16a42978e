"""BPE over words with word ends: normalising, batched merge rounds, decoding (operator 12)."""

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa

from vacantia.llm import texts
from vacantia.llm.bpe import byte_letters
from vacantia.llm.shared import documents, ready

SHIFT = 20
NONE = np.iinfo(np.int64).max
#: Bytes of text worked on at once; longer texts are cut after white space.
PIECE = 1 << 20
#: Symbols from which a word is folded rank by rank instead of round by round.
LONG = 1024
#: Words a worker remembers between batches.
REMEMBER = 250_000
END = "</w>"


class WordMerges:
    """Vocabulary and merges of a file whose words end in a mark."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, letters = whole["model"], byte_letters()
        vocabulary = model["vocab"]
        self.added = {token["content"].encode(): token["id"] for token in whole["added_tokens"]}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + END] for b in range(256)], np.int64)
        table = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            table.append((vocabulary[left] << SHIFT | vocabulary[right], rank, vocabulary[left + right]))
        self.keys, self.ranks, self.made = np.array(sorted(table), np.int64).T.copy()
        self.text = {i: t.encode() for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.seen = {}
        self.mark = re.compile(b"(" + b"|".join(re.escape(t) for t in self.added) + b")")

    def pairs(self, left, right):
        """Place of each pair among the sorted pair keys by binary search, -1 where it does not merge."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def fold(self, words):
        """Ids of every word (bytes, none empty): a list of arrays."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = [None] * len(words)
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.fold_long(words[k])
        short = np.flatnonzero(size <= LONG).tolist()
        ids, offsets = self.fold_rounds([words[k] for k in short])
        for k, i, j in zip(short, offsets.tolist(), offsets[1:].tolist()):
            out[k] = ids[i:j]
        return out

    def symbols(self, words):
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.inner[data]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        return ids, np.repeat(np.arange(len(words)), size)

    def fold_rounds(self, words):
        """All words in one flat array; a round merges the lowest-ranked pair of every word.

        Only pairs next to a merge are searched again. Words without pairs leave the array.
        """
        ids, word = self.symbols(words)
        at = np.full(len(ids), -1, np.int64)  # place of the pair that starts here
        inside = np.flatnonzero(word[1:] == word[:-1])
        at[inside] = self.pairs(ids[inside], ids[inside + 1])
        done_ids, done_words = [], []
        while len(ids):
            rank = np.where(at >= 0, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = least == NONE
            done_ids.append(ids[over])
            done_words.append(word[over])
            hit = left_first((rank == least) & ~over)
            ids[hit] = self.made[at[hit]]
            gone = np.zeros(len(ids), bool)
            gone[hit + 1] = True
            fresh = np.zeros(len(ids), bool)
            fresh[hit] = True
            keep = ~gone & ~over
            ids, word, at, fresh = ids[keep], word[keep], at[keep], fresh[keep]
            again = np.flatnonzero(fresh | np.append(fresh[1:], False))
            again = again[again < len(ids) - 1]
            same = word[again] == word[again + 1]
            at[again] = np.where(same, self.pairs(ids[again], ids[np.minimum(again + 1, len(ids) - 1)]), -1)
            if len(ids):
                at[-1] = -1
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_words or [word])
        ids = ids[np.argsort(word, kind="stable")]
        return ids, np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def fold_long(self, word):
        """Ids of one very long word: ranks from a heap, all places of a rank at once.

        Symbols are linked to their neighbours, so that a merge costs its own places and not
        the length of the word.
        """
        ids, _ = self.symbols([word])
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        at = np.append(self.pairs(ids[:-1], ids[1:]), -1)
        alive = np.ones(n, bool)
        waiting, heap = {}, []

        def wait(places):
            places = places[at[places] >= 0]
            ranks = self.ranks[at[places]]
            order = np.argsort(ranks, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(ranks[order]) != 0)) if len(order) else order
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                rank = int(ranks[order[i]])
                if rank not in waiting:
                    heapq.heappush(heap, rank)
                waiting.setdefault(rank, []).append(places[order[i:j]])

        wait(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            place = np.unique(np.concatenate(waiting.pop(rank)))
            place = place[alive[place] & (at[place] >= 0)]
            place = place[self.ranks[at[place]] == rank]
            if not len(place):
                continue
            # neighbours in the chain that both hit: every second one of a run merges
            joined = np.append(False, after[place[:-1]] == place[1:])
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(place))))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            right = after[place]
            ids[place] = self.made[at[place]]
            alive[right] = False
            at[right] = -1
            after[place] = after[right]
            inner = after[place] < n
            before[after[place][inner]] = place[inner]
            again = np.unique(np.append(place, before[place][before[place] >= 0]))
            last = after[again] >= n
            at[again[last]] = -1
            again = again[~last]
            at[again] = self.pairs(ids[again], ids[after[again]])
            wait(again)
        return ids[alive]

    def encode(self, words):
        """(number of ids, ids as text, tokens as text) of each word, ids and tokens joined by blanks."""
        seen = self.seen
        if len(seen) > REMEMBER or not seen:
            seen.clear()
            seen.update({t: (1, b"%d" % i, t) for t, i in self.added.items()})
        out = [seen.get(w) for w in words]
        missing = [k for k, known in enumerate(out) if known is None]
        for k, ids in zip(missing, self.fold([words[k] for k in missing]) if missing else []):
            ids = ids.tolist()
            out[k] = len(ids), b" ".join(b"%d" % i for i in ids), b" ".join(map(self.text.__getitem__, ids))
            if len(words[k]) <= 64:
                seen[words[k]] = out[k]
        return out


def left_first(hit):
    """Places of the hits that merge: of a run of overlapping ones every second, from the left."""
    place = np.flatnonzero(hit)
    joined = np.append(False, np.diff(place) == 1) if len(place) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(place)))) if len(place) else place
    return place[(np.arange(len(place)) - run) % 2 == 0]


@functools.cache
def vocabulary_file(path):
    return WordMerges(path)


def normalised(text):
    """Composed, lower-case text as the vocabulary's file asks for, letter by letter: no final sigma."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text.decode()).replace("Σ", "σ").lower().encode()


def cut(text, size=PIECE):
    """Pieces of about ``size`` bytes that end in white space, where no word goes on."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size)) + 1
        if end <= at:
            found = re.compile(rb"[ \n\t\r]").search(text, at + size)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def words_of(data, offsets):
    """Start and end (bytes) of the words of normalised texts.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``; white space is dropped.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = texts._classes()[code]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, offsets)] = True
    head[[0, n]] = True
    start = head.copy()
    start[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == texts.NUMBER)
    run = np.flatnonzero(start[:n])
    stop = np.append(run[1:], n)
    quote = (code[run] == 39) & (stop - run == 1) & ~head[stop]
    at = stop[quote]
    one = code[at]
    two = np.where((at + 1 < n) & ~head[np.minimum(at + 1, n)], code[np.minimum(at + 1, n - 1)], 0)
    size = np.isin(one, [ord(c) for c in "stmd"]) + 2 * (
        (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    at, size = at[size > 0], size[size > 0]
    start[at] = False
    rest = at + size
    start[rest[rest < n]] = True
    first = np.flatnonzero(start[:n])
    stop = np.append(first[1:], n)
    first, stop = first[kind[first] != texts.SPACE], stop[kind[first] != texts.SPACE]
    lead = np.append(lead, len(data))
    return lead[first], lead[stop]


def encode(docs, vocabulary=None, id_col="doc_id", text_col="text", size=PIECE):
    """Encode every whole text and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are composed and lower-cased, parted at the added tokens (which stand for
    themselves), cut into words, and the distinct words of a batch merged together in rounds.
    The file names no decoder, so decoding joins the tokens by blanks, word ends included.

    A null text counts as empty: no tokens, hashes of nothing. Repeated rows give repeated
    rows; a null id stays null; an empty table gives no rows; extra columns are ignored.
    Narrow: no shuffle. Long texts are worked on in pieces that end in white space, their
    hashes growing piece by piece, so memory follows ``size`` or the longest stretch without
    a blank, besides the text itself.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    ready(docs)

    def coded(merges, pieces):
        """Per piece: number of tokens, ids and tokens as text."""
        segments, special, owner = [], [], []
        for k, piece in enumerate(pieces):
            for number, part in enumerate(merges.mark.split(piece) if b"<|" in piece else [piece]):
                segments.append(part if number % 2 else normalised(part))
                special.append(number % 2 == 1)
                owner.append(k)
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments))))
        data = np.frombuffer(b"".join(segments), np.uint8)
        starts, ends = words_of(data, offsets)
        if any(special):
            special = np.array(special)
            plain = ~special[texts.owner(offsets, starts)]
            starts, ends = np.append(starts[plain], offsets[:-1][special]), np.append(ends[plain], offsets[1:][special])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        words, which = texts.distinct(data, starts, ends) if len(starts) else ([], np.zeros(0, np.int64))
        known = merges.encode(words)
        bounds = offsets[np.searchsorted(np.array(owner), np.arange(len(pieces) + 1))]
        edges = np.searchsorted(starts, bounds).tolist()
        which = which.tolist()
        for i, j in zip(edges, edges[1:]):
            row = [known[w] for w in which[i:j]]
            yield sum(r[0] for r in row), b" ".join(r[1] for r in row), b" ".join(r[2] for r in row)

    def grouped(column):
        """Lists of (row, piece) with about ``size`` bytes each."""
        held, total = [], 0
        for row in range(len(column)):
            text = column[row].as_py() or b""
            for piece in cut(text, size) if len(text) > size else [text]:
                held.append((row, piece))
                total += len(piece)
                if total >= size:
                    yield held
                    held, total = [], 0
        if held:
            yield held

    def run(batches):
        merges = vocabulary_file(path)
        for batch in batches:
            n = [0] * len(batch)
            ids, tokens = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
            for group in grouped(batch.column(1).cast(pa.large_binary())):
                for (row, _), (count, as_ids, as_tokens) in zip(group, coded(merges, [p for _, p in group])):
                    if count:
                        blank = b" " if n[row] else b""
                        ids[row].update(blank + as_ids)
                        tokens[row].update(blank + as_tokens)
                        n[row] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in ids]), pa.array([h.hexdigest() for h in tokens])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
