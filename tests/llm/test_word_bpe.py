"""BPE with word ends against the library that owns the vocabulary's format."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vacantia.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    """What the operator's own parts give for one text."""
    merges = word_bpe.vocabulary_file(PATH)
    raw = text.encode()
    out = []
    for number, part in enumerate(merges.mark.split(raw)):
        if number % 2:
            out.append(merges.added[part])
            continue
        part = word_bpe.normalised(part)
        data = np.frombuffer(part, np.uint8)
        starts, ends = word_bpe.words_of(data, np.array([0, len(data)]))
        words = [part[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        out += [i for ids in merges.fold(words) for i in ids.tolist()] if words else []
    return out


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_every_code_point_as_the_library(library):
    """Classes, lower case and composition of all letters; code points newer than the library's tables are left out."""
    def old(c):
        return unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and old(c)]
    lines = ["a" + "1a".join(chars[k : k + 64]) + "b" for k in range(0, len(chars), 64) if any(unicodedata.category(c) != "Co" for c in chars[k : k + 64])]
    for line, coded in zip(lines, library.encode_batch(lines, add_special_tokens=False)):
        assert ids_of(line) == coded.ids, line


def texts_to_try():
    rnd = random.Random(5)
    alphabet = ["'", "s", "re", "ve", "ll", "'S", "'LL", "d", " ", "\n", "　", "\x85", "A", "é", "é", "Σ", "ΣΣ", "İ", "ﬁ", "1", "²", "Ⅷ", "中", "한", "가", "😀", "!",
                "!'", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "̸", "the", "ing", "</w>", "_", "‍", "\x00", "ß", "ẞ"]
    return ["".join(rnd.choices(alphabet, k=rnd.randint(1, 40))) for _ in range(3000)] + [
        "", " ", "'s", "''s", "it's we'LL they'd 'tis", "a" * 5000, "ab" * 3000, "".join(rnd.choices("etaoinshrdlu", k=6000)),
        "=" * 3001, "<|endoftext|≯x", "e\ń"]


def test_odd_texts_as_the_library(library):
    odd = texts_to_try()
    for text, coded in zip(odd, library.encode_batch(odd, add_special_tokens=False)):
        assert ids_of(text) == coded.ids, text[:80]


def test_long_words_fold_alike():
    merges, rnd = word_bpe.vocabulary_file(PATH), random.Random(2)
    words = ["".join(rnd.choices("aetoins", k=rnd.randint(2, 900))).encode() for _ in range(60)] + [b"a" * k for k in range(1, 40)]
    ids, offsets = merges.fold_rounds(words)
    for k, word in enumerate(words):
        assert merges.fold_long(word).tolist() == ids[offsets[k] : offsets[k + 1]].tolist()


def test_whole_texts_through_spark(spark, library):
    odd = texts_to_try()[::10] + [None, None, "x " * 40_000 + "Ünë " * 9_000]
    rows = [(k if k % 50 else None, t, 1, "z") for k, t in enumerate(odd)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.encode(df, size=1 << 10).collect())
    assert got == sorted(((i or -1), *expected(library, t or "")) for i, t, _, _ in rows)
    assert word_bpe.encode(df.limit(0)).count() == 0


def test_cuts_lie_in_white_space():
    text = ("word " * 300 + "y" * 500 + " z\n").encode() * 3
    pieces = list(word_bpe.cut(text, 128))
    assert b"".join(pieces) == text and len(pieces) > 20
    assert all(p[-1:] in b" \n\t\r" for p in pieces[:-1])
