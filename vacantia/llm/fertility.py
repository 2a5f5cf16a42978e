"""Quality rules by tokeniser fertility (operator 10)."""

import functools
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from vacantia.llm import bpe, texts
from vacantia.llm.shared import ready

SYMBOLS = b"#*$%&|<>"
REMEMBER = 250_000
#: Code point ranges that tell scripts apart.
SCRIPTS = [("latin", 0, 0x250), ("cyrillic", 0x400, 0x530), ("han", 0x2E80, 0xD7B0)]
#: Rejection bands per language, and per main script for texts of any other language:
#: least and most characters per piece, least characters per byte-level token,
#: most byte-fallback share, least token entropy in bits. They leave room below what plain
#: prose of 50 words reaches and reject symbol salad, encoded data and looping texts.
BANDS = {
    "en": (1.5, 10.0, 1.9, 0.1, 4.5),
    "de": (1.5, 12.0, 1.9, 0.1, 4.5),
    "fr": (1.4, 10.0, 1.7, 0.1, 4.5),
    "es": (1.4, 10.0, 1.85, 0.1, 4.5),
    "latin": (1.2, 12.0, 1.4, 0.2, 4.5),
    "cyrillic": (0.8, 12.0, 0.8, 0.2, 4.5),
    "han": (0.3, 8.0, 0.3, 0.7, 4.5),
    "other": (0.3, 12.0, 0.3, 0.9, 4.5),
    "none": (1.0, 12.0, 0.8, 0.3, 4.5),
}
COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, chars_per_piece double, chars_per_token double, fallback_share double, "
    "entropy double, band string, kept boolean"
)


@functools.cache
def _pieces(path):
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])
    return model, is_byte, {}


def _measure_words(path, merges, words):
    """For each word its piece ids (little-endian 32-bit bytes) and its number of byte-level tokens."""
    model, _, seen = _pieces(path)
    if len(seen) > REMEMBER:
        seen.clear()
    out = [seen.get(w) for w in words]
    missing = [k for k, found in enumerate(out) if found is None]
    if missing:
        fresh = [words[k] for k in missing]
        coded = model.encode([w.decode() for w in fresh], num_threads=1)
        cuts = (np.cumsum([0, *map(len, coded)]) * 4).tolist()
        flat = np.fromiter(chain.from_iterable(coded), "<u4").tobytes()
        tokens = np.diff(merges.fold(fresh)[1]).tolist()
        for k, word, i, j, n in zip(missing, fresh, cuts, cuts[1:], tokens):
            out[k] = flat[i:j], n
            if j - i < 400:
                seen[word] = out[k]
    return out


def repeated_words(which):
    """How many words lie in a 3-word window that occurs twice or more."""
    if len(which) < 4:
        return 0
    if which.max() < 1 << 21:
        key = (which[:-2] << 21 | which[1:-1]) << 21 | which[2:]
    else:
        pair = np.unique(which[:-1] << 32 | which[1:], return_inverse=True)[1]
        key = pair[:-1] << 32 | which[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    if len(count) == len(key):
        return 0
    at = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(which), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(raw):
    lines, seen, n = raw.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(texts.SPACES):
            seen.add(line)
    return n


def main_script(raw):
    """The script that more than half of a text's letters belong to."""
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    code = code[texts._classes()[code] == texts.LETTER]
    if not len(code):
        return "none"
    for name, first, last in SCRIPTS:
        if 2 * np.count_nonzero((code >= first) & (code < last)) > len(code):
            return name
    return "other"


def _base(data, offsets):
    n = len(offsets) - 1
    starts, ends = texts.word_spans(data, offsets)
    words, which = texts.distinct(data, starts, ends) if len(starts) else ([], np.zeros(0, np.int64))
    cuts = np.searchsorted(starts, offsets)
    lead = ((data & 0xC0) != 0x80) & ~texts._tables()[1][data]
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets]).astype(np.int64)
    raw = data.tobytes()
    spans = list(zip(offsets.tolist(), offsets[1:].tolist()))
    n_words = np.diff(cuts)
    repeats = np.array([repeated_words(which[i:j]) for i, j in zip(cuts.tolist(), cuts[1:].tolist())], np.int64)
    lines = np.array([repeated_lines(raw[i:j]) for i, j in spans], np.int64)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    return words, which, cuts, [n_words, total(lead), total(symbol), lines, repeats, failed], n


def _entropy(ids):
    if not len(ids):
        return 0.0
    count = np.unique(ids, return_counts=True)[1]
    return float(np.log2(len(ids)) - (count * np.log2(count)).sum() / len(ids))


def measure(docs, bands=None, pieces=None, ranks=None, text_col="text", lang_col="lang"):
    """Add the base counts, the fertility measures and ``kept`` to every row.

    Characters per token are measured with two public vocabularies (pieces with byte
    fallback, and byte-level BPE), the byte-fallback share and the token entropy with the
    first. A text is kept if its base rules hold and every measure lies in the band of its
    language, or of its main script where the language has no band. All input columns stay;
    columns of the same names are replaced.

    A null or blank text has no words: base_failed, not kept, measures 0. A null language
    means its script decides. Repeated rows are judged alike. Narrow: no shuffle.
    """
    bands = dict(BANDS if bands is None else bands)
    piece_path = pieces or public_tokenizers.path("piece_bpe_32k.model")
    rank_path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ready(docs)
    made = [part.split(" ")[0] for part in COLUMNS.split(", ")]
    kept_columns = [c for c in docs.columns if c not in made]
    known = lang_col in kept_columns
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    docs = docs.withColumn(lang_col, F.col(lang_col).cast("string")) if known else docs
    source = docs.select(F.struct(*kept_columns).alias("_row"))

    def run(batches):
        merges = bpe.rank_file(rank_path)
        is_byte = _pieces(piece_path)[1]
        for batch in batches:
            rows = batch.column(0)
            langs = rows.field(lang_col).to_pylist() if known else [None] * len(rows)
            for row, data, offsets in texts.chunks(rows.field(text_col)):
                words, which, cuts, base, n = _base(data, offsets)
                found = _measure_words(piece_path, merges, words)
                in_pieces = [ids for ids, _ in found]
                in_bytes = np.array([n for _, n in found], np.int64)
                raw, edges = data.tobytes(), offsets.tolist()
                measures, names, kept = [], [], []
                for k, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    used = which[i:j]
                    ids = np.frombuffer(b"".join(map(in_pieces.__getitem__, used.tolist())), "<u4")
                    chars = int(base[1][k])
                    found = (
                        chars / max(1, len(ids)), chars / max(1, int(in_bytes[used].sum())),
                        float(is_byte[ids].mean()) if len(ids) else 0.0, _entropy(ids))
                    measures.append(found)
                    name = langs[row + k]
                    name = name if name in bands else main_script(raw[edges[k] : edges[k + 1]])
                    names.append(name)
                    low, high, low_bytes, fallback, entropy = bands[name]
                    kept.append(
                        not base[5][k] and low <= found[0] <= high and low_bytes <= found[1]
                        and found[2] <= fallback and found[3] >= entropy)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(row, n), *map(pa.array, base), *(pa.array(m, pa.float64()) for m in (zip(*measures) if n else [[]] * 4)),
                     pa.array(names, pa.string()), pa.array(kept, pa.bool_())], ["_row", *made])

    kept_schema = docs.select(F.struct(*kept_columns).alias("r")).schema["r"].dataType.simpleString()
    return source.mapInArrow(run, f"_row {kept_schema}, {COLUMNS}").select("_row.*", *made)
