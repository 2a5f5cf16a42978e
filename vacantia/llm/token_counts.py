"""Token counts by the whole-token shortcut (operator 4)."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from vacantia.llm import bpe, texts
from vacantia.llm.shared import documents, ready

#: The file's one added token; inside a text it counts as one token and parts the text.
END_OF_TEXT = b"<|endoftext|>"


def part_at(data, offsets, mark=END_OF_TEXT):
    """Offsets of the parts of all texts when ``mark`` stands apart: (offsets, is a mark)."""
    raw, cuts, marks, at = data.tobytes(), [], [], 0
    while (at := raw.find(mark, at)) >= 0:
        if texts.owner(offsets, at) == texts.owner(offsets, at + len(mark) - 1):
            cuts += [at, at + len(mark)]
            marks.append(at)
            at += len(mark)
        else:
            at += 1
    edges = np.union1d(offsets, np.array(cuts, np.int64))
    return edges, np.isin(edges[:-1], np.array(marks, np.int64))


def count_tokens(docs, vocabulary=None, limit=1024, id_col="doc_id", text_col="text"):
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit, n_shortcut.

    ``bpe.merge_file`` proves once per worker which vocabulary strings encode alone as one
    token. Pre-tokens equal to such a string count 1 each (``n_shortcut`` of them, marks
    included); only the distinct others are merged. The text of the added token is found
    inside texts, as the library does by default.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; a
    null id stays null. Narrow: no shuffle, and memory is bounded by a few MB of text or by
    the longest text.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ready(docs)

    def run(batches):
        merges = bpe.merge_file(path)
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in texts.chunks(batch.column(1)):
                edges, special = part_at(data, offsets)
                starts, ends = texts.pretokens(data, edges)
                plain = ~special[texts.owner(edges, starts)] if len(starts) else np.zeros(0, bool)
                starts, ends = starts[plain], ends[plain]
                words, which = texts.distinct(data, starts, ends)
                alone = np.array([w in merges.whole for w in words], bool)
                counts = np.ones(len(words), np.int64)
                rest = np.flatnonzero(~alone)
                counts[rest] = [len(c) // 4 for c in merges.encode([words[k] for k in rest.tolist()])]
                n = len(offsets) - 1
                text = texts.owner(offsets, starts)
                marks = np.bincount(texts.owner(offsets, edges[:-1][special]), minlength=n) if special.any() else 0
                tokens = np.bincount(text, counts[which], n).astype(np.int64) + marks
                short = np.bincount(text, alone[which], n).astype(np.int64) + marks
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit), pa.array(short)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_shortcut"])

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_shortcut bigint"
    return documents(docs, id_col, text_col).mapInArrow(run, schema)
