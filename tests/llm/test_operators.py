"""The training-data operators against brute force, libraries and edge cases."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vacantia.llm import (
    bpe,
    components,
    epsilon_join,
    fertility,
    licenses,
    minhash,
    mixing,
    passages,
    shards,
    suffixes,
    texts,
    token_counts,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, tk string, rank int, count int, seed int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("the", "ing", "éa", "tion", "wh", "Or", "st", "ß") for b in ("re", "an", "", "nd", "ü", "on")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Copies, near copies, a shared passage, odd texts, nulls, a repeated row."""
    rnd = random.Random(3)
    base = [prose(rnd, rnd.choice([3, 30, 80, 300])) for _ in range(40)]
    passage = prose(rnd, 60)
    rows = list(base)
    rows += base[:6] + [base[0]] * 5
    for text in base[6:16]:
        words = text.split(" ")
        for k in range(0, len(words), 40):
            words[k] = "changed" + words[k]
        rows.append(" ".join(words))
    rows += [prose(rnd, 70) + "\n" + passage + "\n" + prose(rnd, 50) for _ in range(8)]
    rows += [None, "", " \n\t ", "one", "ONE", "é", "a" * 700, "ab " * 300, "x" * 250 + base[3], "日本語 текст 😀 <|endoftext|> it's we'll 'tis  \n\n x",
             "line\nline\n\nline \nLicensed under the Apache License, Version 2.0.", "### $$$ %%% " * 60, prose(rnd, 2500)]
    rows.append(rows[-1])
    out = [(i, t, rnd.choice(["en", "de", None, "xx"]), rnd.choice(["a", "b", "hot", "hot", None]), None if t is None else len(t), "s", "k", 1, 2, 3)
           for i, t in enumerate(rows)]
    return [*out, out[5], (None, base[7], "en", "a", 5, "s", "k", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(row)
    return out


class Groups:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, x, y):
        self.of[self.find(x)] = self.find(y)


def smallest(ids, groups):
    """Component id of each row: the smallest id that is not null."""
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            root = groups.find(k)
            least[root] = min(least.get(root, i), i)
    return [least.get(groups.find(k)) for k in range(len(ids))]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    groups = Groups(300)
    for u, v in edges:
        groups.join(u, v)
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    assert sorted(got) == nodes
    assert all((got[a] == got[b]) == (groups.find(a) == groups.find(b)) for a in nodes for b in nodes)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def sets_of(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_finds_every_link(docs, none, size):
    rows = corpus()
    sets = [sets_of(r[1], size) for r in rows]
    groups = Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    want = Counter((r[0], len(s), c if c is not None else r[0], r[0] == c) for r, s, c in zip(rows, sets, smallest([r[0] for r in rows], groups)))
    got = minhash.near_duplicates(docs, shingle=size)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()) == want
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicate(docs, shingle=size)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for (i, _, _, k), _ in want.items() if k})


def test_one_document_stays_of_groups_without_ids(spark):
    rnd = random.Random(21)
    texts_ = [prose(rnd, 100) for _ in range(3)]
    near = lambda t: t + " more"
    rows = [(None, texts_[0]), (None, near(texts_[0])), (7, texts_[1]), (7, near(texts_[1])), (None, texts_[2]), (9, near(texts_[2])), (None, ""), (None, "")]
    kept = [(r["doc_id"], r["text"]) for r in minhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert Counter(i for i, _ in kept) == {None: 2, 7: 1, 9: 1} and (None, "") in kept


@pytest.mark.parametrize("percent", [10, 50, 70, 80, 95, 100])
def test_bands_and_sketch_fit_the_threshold(percent):
    bands, rows = minhash.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    assert percent != 80 or (bands, rows) == (minhash.BANDS, minhash.ROWS)
    # sketches of pairs at the threshold: of 2,000, all but a few in a million agree enough
    drawn = np.random.default_rng(percent).binomial(minhash.SKETCH, percent / 100, 2000) / minhash.SKETCH
    assert (drawn >= minhash.sketch_least(percent)).all()
    with pytest.raises(ValueError):
        minhash.banding(0)


def test_left_over_pairs_of_a_bucket(spark):
    """The head of a bucket is like neither of two members that are like each other."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(100)]
    middle = words[:80] + [f"m{k}" for k in range(8)]
    near = words[:82] + [f"n{k}" for k in range(4)]
    rows = [(k, " ".join(w)) for k, w in enumerate([words, middle, near, near[:60] + [f"z{rnd.random()}"] * 1 + near[60:]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [sets_of(t, 2) for _, t in rows]
    groups = Groups(4)
    for a in range(4):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert [got[k] for k in range(4)] == smallest(range(4), groups)


def removed(rows, least):
    data = [(t or "").encode() for t in rows]
    seen = Counter(d[k : k + least] for d in data for k in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - least + 1):
            if seen[d[k : k + least]] > 1:
                gone[k] += 1
                gone[k + least] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        out.append((len(d), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeated_bytes_go(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffixes.repeated_ranges, "__defaults__", (suffixes.LEAST, hot))
    rows = corpus()
    want = Counter((r[0], n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, removed([r[1] for r in rows], 200)))
    assert Counter(tuple(r) for r in suffixes.remove_repeats(docs).collect()) == want
    assert suffixes.remove_repeats(none).count() == 0


def test_documents_without_their_repeats(docs, none):
    rows = corpus()
    want = Counter((r[0], None if r[1] is None else kept.decode("utf-8", "ignore")) for r, (*_, kept) in zip(rows, removed([r[1] for r in rows], 200)))
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
    assert suffixes.without_repeats(none).count() == 0


def test_multikey_quicksort_against_sets():
    rnd = random.Random(2)
    for least in (16, 21):
        data = np.array([rnd.choice([97, 97, 97, 98]) for _ in range(3000)], np.uint8)
        starts = np.arange(len(data) - least + 1)
        groups = np.array([rnd.randint(0, 3) for _ in starts])
        raw = data.tobytes()
        seen = Counter((g, raw[s : s + least]) for g, s in zip(groups.tolist(), starts.tolist()))
        want = [seen[g, raw[s : s + least]] > 1 for g, s in zip(groups.tolist(), starts.tolist())]
        assert suffixes.multikey_repeats(suffixes.eight_bytes(data), starts, groups, least).tolist() == want


def test_slices_cover_every_window_of_long_texts(monkeypatch):
    rnd = random.Random(4)
    data = np.array([rnd.randint(97, 100) for _ in range(5000)], np.uint8)
    whole = suffixes.slices(data, np.array([0, 5000]))
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    cut = suffixes.slices(data, np.array([0, 5000]))
    for first, last, place, *_ in (whole, cut):
        windows = np.concatenate([np.arange(i, j + 1) for i, j in zip(first, last)])
        assert windows.tolist() == list(range(5000 - 199))
    anchor = {w: p for i, j, p in zip(*whole[:3]) for w in range(i, j + 1)}
    assert all(anchor[w] == p for i, j, p in zip(*cut[:3]) for w in range(i, j + 1))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + k, (base[k % 8] * (k + 1) + rng.normal(size=24) * 0.1).tolist()) for k in range(60)]
    rows += [(300, base[0].tolist()), (301, (base[0] * 2).tolist()), (302, base[0].tolist()), (302, base[0].tolist()), (None, base[1].tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 24), (403, [None] + [1.0] * 23), (404, [float("nan")] * 24), (405, [float("inf")] * 24), (406, [1.0, 2.0]), (407, [1e-200] * 24), (408, [1e200] * 24)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id bigint, embedding array<double>, links int, key string")
    groups, links = Groups(len(rows)), [0] * len(rows)

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    want = Counter((r[0], n, c if c is not None else r[0], r[0] == c) for r, n, c in zip(rows, links, smallest([r[0] for r in rows], groups)))
    for block in (4096, 7):
        got = epsilon_join.near_vectors(df, block=block)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert epsilon_join.near_vectors(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_what_the_library_gives(docs, none, encoder):
    want = Counter()
    for r in corpus():
        ids = encoder.encode_ordinary(r[1] or "")
        raw = np.array(ids, "<u4").tobytes()
        want[r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode(docs).collect()) == want
    back = bpe.decode(bpe.encode(docs, with_ids=True)).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in corpus())
    assert bpe.encode(none).count() == 0


def test_pieces_and_merges_on_random_texts(encoder):
    rnd = random.Random(6)
    parts = ["a", "th", " ", "  ", "\n", "\t", "'s", "'re", "'", "'ll", "1", "22", "!", "é", "ß", "中文", " ", " ", "\x1c", "\x85", "😀", "²", "é", "====", "\r\n", "​", "aaaa"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["a" * 900, "=" * 900, " " * 900]
    merges = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for row, data, offsets in texts.chunks(__import__("pyarrow").array(rows), 500):
        starts, ends = texts.pretokens(data, offsets)
        words, which = texts.distinct(data, starts, ends)
        coded = merges.encode(words)
        cuts = np.searchsorted(starts, offsets)
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            raw = b"".join(coded[w] for w in which[i:j].tolist())
            assert np.frombuffer(raw, "<u4").tolist() == encoder.encode_ordinary(rows[row + k])


def test_higher_order_fold_gives_the_same_ids(spark, encoder):
    words = ["the", " there", "éaü", "tion", "x", "日本", "aaaaaaa", "'s", "  ", "whst"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: list(r["ids"]) for r in df.select("word", bpe.fold_column(F.col("word").cast("binary")).alias("ids")).collect()}
    assert got == {w: encoder.encode_ordinary(w) for w in words}


def test_token_counts_are_what_the_library_gives(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in corpus():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    got = token_counts.count_tokens(docs)
    assert Counter(tuple(r) for r in got.drop("n_shortcut").collect()) == want
    assert got.filter("n_shortcut > n_tokens").count() == 0
    assert token_counts.count_tokens(none).count() == 0
    merges = bpe.merge_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = random.Random(1).sample(sorted(merges.whole), 300)
    for word in some:  # the proof: alone, each is one token of the library
        try:
            text = word.decode()
        except UnicodeDecodeError:
            continue
        if text != "<|endoftext|>" and len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_quality_rules(docs, none):
    want = Counter()
    for r in corpus():
        words = WORD.findall(r[1] or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        seen, again = set(), 0
        for line in (r[1] or "").split("\n"):
            again += line in seen and bool(WORD.search(line))
            seen.add(line)
        want[r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), again, len(covered),
             len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    got = fertility.measure(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == want
    assert set(docs.columns) <= set(got.columns)
    assert got.filter("kept AND base_failed").count() == 0
    rows = by_id(got)
    salad = next(r for r in corpus() if r[1] and r[1].startswith("### $$$"))
    assert not rows[salad[0]][0]["kept"]
    assert fertility.measure(none).count() == 0


def test_fertility_tells_prose_from_salad(spark):
    rnd = random.Random(9)
    english = ("It was a bright cold day in April and the clocks were striking when the old man walked down to the harbour to look "
               "for his boat, which he had not seen since the storm of the week before had driven everything out to sea and left "
               "the beach covered with broken planks, ropes and the white bones of ancient fish that nobody could name any more.")
    german = ("Der alte Fischer ging am frühen Morgen zum Hafen hinunter, um nach seinem Boot zu sehen, das er seit dem Sturm der "
              "letzten Woche nicht mehr gesehen hatte, und fand am Strand nur zerbrochene Bretter, Seile und Netze, die niemand "
              "mehr brauchen konnte, weil das Meer alles andere mit sich genommen hatte und erst im Frühling zurückgeben würde.")
    salad = " ".join(f"{rnd.choice(VOCABULARY)}{rnd.choice(['###', '***', '%%%', '$$$', '&&&'])}" for _ in range(120))
    noise = " ".join("".join(rnd.choice("0123456789abcdef") for _ in range(12)) for _ in range(80))
    df = spark.createDataFrame([(1, english, "en"), (2, german, "de"), (3, english, None), (4, salad, "en"), (5, noise, "en")], "doc_id int, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in fertility.measure(df).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_mixture(docs, none):
    got = mixing.with_copies(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in corpus())
    total, sources = 0, {}
    for r in corpus():
        size = len(WORD.findall(r[1] or ""))
        total += size
        sources.setdefault(r[3], []).append(size)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:  # pour out again what the full sources cannot hold
        left = total - sum(3 * sum(sources[s]) for s in full)
        open_ = sum(weights[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and left * weights[s] > 3 * sum(sources[s]) * open_}
        if not more:
            break
        full |= more
    for name, sizes in sources.items():
        mine = [r for r in got if r["source"] == name]
        target = 3.0 * sum(sizes) if name in full else left * weights[name] / open_
        assert {round(r["target"], 6) for r in mine} == {round(target, 6)} and {r["source_size"] for r in mine} == {sum(sizes)}
        assert abs(sum(r["taken"] for r in mine) - target) <= max(sizes)
    assert sorted(map(tuple, mixing.with_copies(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.with_copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_shards_hold_the_mixture(spark, docs, none):
    got = shards.assign(docs, 6).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in corpus())
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    want = Counter((r[0], len((r[1] or "").encode()) + 8) for r in corpus())
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 7, "hot").otherwise("b").alias("source"))
    per = Counter((r["shard"], r["source"]) for r in shards.assign(many, 24).collect())
    assert all(abs(per[s, "hot"] - 700 / 24) <= 1.5 for s in range(24))
    assert shards.assign(none).count() == 0


def test_shards_cut_rows_of_one_id_too(spark, monkeypatch, tmp_path):
    """60,000 rows without an id in one source, half of them wholly equal: even tasks, whole shards."""
    folders = []

    def numbered(df, order):
        folders.append(str(tmp_path / str(len(folders))))
        return with_row_numbers(df, order, folders[-1])

    with_row_numbers = shards.with_row_numbers
    monkeypatch.setattr(shards, "with_row_numbers", numbered)
    text = F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string"))
    hot = spark.range(60_000).select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), F.lit("hot").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = shards.assign(hot, 24).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 24 and all((r["n"], r["slots"], r["last"]) == (2500, 2500, 2499) for r in got)
    for folder in folders:
        tasks = [r["count"] for r in spark.read.parquet(folder).groupBy("_part").count().collect()]
        assert len(tasks) == 8 and max(tasks) < 2 * 60_000 / 8
    assert len(folders) == 2


def test_chain_against_every_path():
    rnd = random.Random(7)
    for _ in range(60):
        n = rnd.randint(1, 9)
        x = np.array([rnd.randint(0, 40) for _ in range(n)])
        y = np.array([rnd.randint(0, 40) for _ in range(n)])
        best = 0
        for mask in range(1, 1 << n):
            path = sorted((k for k in range(n) if mask >> k & 1), key=lambda k: (x[k], y[k]))
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(path, path[1:])):
                best = max(best, 5 * len(path) - 0.3 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(path, path[1:])))
        path = passages.chain(x, y, 5, 0.3)[0]
        got = 5 * len(path) - 0.3 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(path, path[1:]))
        assert got == pytest.approx(best)


def test_passages(docs, none, spark):
    rows = corpus()
    words = {r[0]: [w.lower() for w in WORD.findall(r[1] or "")] for r in rows if r[0] is not None}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for ids in where.values() if len(ids) > 1 for i in ids}
    found = passages.shared_passages(docs).collect()
    assert want <= {r["doc_id"] for r in found} | {r["source_id"] for r in found}
    for r in found:
        a, b = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["source_id"]][r["source_start"] : r["source_end"]]
        assert r["n_words"] >= 50 and 100 * r["n_matches"] >= 80 * r["n_words"] and r["doc_id"] != r["source_id"]
        assert not r["is_copy"] or a == b
    rnd = random.Random(11)
    shared = prose(rnd, 80).split(" ")
    fuzzy = [w if k % 17 else w + "x" for k, w in enumerate(shared)]
    del fuzzy[40]
    pair = spark.createDataFrame(
        [(1, prose(rnd, 200) + " " + " ".join(shared) + " " + prose(rnd, 100)), (2, prose(rnd, 90) + " " + " ".join(fuzzy) + " " + prose(rnd, 300)), (3, prose(rnd, 400))],
        "doc_id bigint, text string")
    (row,) = passages.shared_passages(pair).collect()
    assert (row["doc_id"], row["source_id"], row["is_copy"]) == (2, 1, False)
    assert row["source_start"] <= 205 and row["source_end"] >= 275 and row["start_word"] <= 95 and row["end_word"] >= 163
    assert passages.shared_passages(none).count() == 0


def test_passages_of_documents_between_the_ends(spark):
    """Each pair is compared on its own: the ends of a seed's group hold less than a passage."""
    rnd = random.Random(12)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    shared = fresh(55)
    for turn in range(3):
        rows = [(k, " ".join(fresh(70) + (shared[:45] if k in (turn, turn + 3) else shared) + fresh(70))) for k in range(6)]
        got = {(r["doc_id"], r["source_id"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        whole = {k for k in range(6) if k not in (turn, turn + 3)}
        assert {k for pair in got for k in pair} == whole


def test_passages_of_all_pairs(spark):
    """Texts of one family meet each other, also where passages connect them through another text."""
    rnd = random.Random(31)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    common, line, rows = fresh(60), fresh(18), {}
    for family in range(12):
        base = fresh(55)
        for _ in range(4):
            rows[len(rows)] = fresh(40) + line + fresh(30) + base + fresh(40) + (common if family < 2 else [])
            base = list(base)
            for k in rnd.sample(range(55), 8):
                base[k] = fresh(1)[0]
    hashed = {k: words_array(w) for k, w in rows.items()}
    want = {(b, a) for a in rows for b in rows if a < b and passages.passages(hashed[a], hashed[b])}
    assert {(b, a) for b in range(8) for a in range(b)} <= want
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "doc_id bigint, text string")
    assert {(r["doc_id"], r["source_id"]) for r in passages.shared_passages(docs).collect()} == want


@pytest.mark.parametrize("cell", [1, 20, 4000])
def test_pairs_in_cells(spark, monkeypatch, cell):
    """A text with very many partners, and every other pair, is compared once, in cells of any size."""
    monkeypatch.setattr(passages, "CELL", cell)
    monkeypatch.setattr(passages, "TASKS", 7)
    rnd = random.Random(33)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    own = [fresh(52) for _ in range(20)]
    rows = [(0, sum(own, [])), *[(k + 1, fresh(9) + part + fresh(9)) for k, part in enumerate(own)], (30, fresh(5) + own[4] + fresh(5))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(31, None), (None, " ".join(own[0]))], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["source_id"], r["n_words"]) for r in passages.shared_passages(docs).collect())
    assert got == sorted([(k, 0, 52) for k in [*range(1, 21), 30]] + [(30, 5, 52)])


def test_texts_with_a_passage_have_a_rare_key_in_common():
    """Of 50 to 130 words with a fifth replaced, however often other texts hold them; a hot line alone sends nothing."""
    rnd = random.Random(32)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    for n in [50, 59, 60, 77, 99, 100, 130]:
        for _ in range(30):
            base = fresh(n)
            copy = list(base)
            for k in rnd.sample(range(n), n - -(-n * 80 // 100)):
                copy[k] = fresh(1)[0]
            hot, keys = fresh(15), []
            for text in (fresh(90) + hot + base + fresh(rnd.randrange(90)), fresh(rnd.randrange(70)) + copy + fresh(2) + hot + fresh(60)):
                keys.append(passages.seeds(words_array(text), passages.KEY))
            common = np.intersect1d(*keys)
            order = {key: k for k, key in enumerate(rnd.sample(common.tolist(), len(common)), 1)}
            sent = [{k[p] for p in passages.rarest(np.array([order.get(x, 0) for x in k.tolist()]), 50, 80)} for k in keys]
            assert sent[0] & sent[1]
    line = np.zeros(300, np.int64)
    line[100:117] = np.arange(1, 18)
    assert not len(passages.rarest(line, 50, 80))
    line[130] = 1 << 40
    assert 116 - 100 >= len(passages.rarest(line, 50, 80)) >= 1


def words_array(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return passages.word_hashes(raw, np.array([0, len(raw)]))[0]


@pytest.mark.parametrize("n", [50, 60, 80, 120])
def test_passages_at_the_least_likeness(n):
    """Every passage of replaced words is found, nine in ten of those with words left out or put in."""
    rnd = random.Random(n)
    fresh = lambda k: [f"x{rnd.random()}" for _ in range(k)]
    found = Counter()
    for turn in range(200):
        base, plain = fresh(n), turn % 2 == 0
        cut = set(rnd.sample(range(1, n - 1), n - -(-n * 80 // 100)))
        copy = [w for k, word in enumerate(base) for w in ([word] if k not in cut else fresh(1) if plain or rnd.random() < 0.67 else [])]
        a, b = words_array(fresh(60) + base + fresh(60)), words_array(fresh(70) + copy + fresh(50))
        shared = np.isin(passages.seeds(a), passages.seeds(b))
        assert not plain or len(passages.dense(shared, 50, 80)) >= passages.needed() == 7
        got = bool(passages.passages(a, b))
        two = [passages.seeds(w, 2) for w in (a, b)]
        assert not got or passages.promising(*two) and passages.promising(*two[::-1])
        found[plain] += got
    assert found[True] == 100 and found[False] >= 90


def test_short_shared_lines_are_not_chained():
    """A line of 20 words that two texts share, with common words around it, leaves no room for a passage."""
    rnd = random.Random(3)
    fresh = lambda k: [f"x{rnd.random()}" for _ in range(k)]
    line = fresh(20)
    texts = [[w for x in fresh(60) for w in (x, "of")] + line + [w for x in fresh(60) for w in (x, "the")] for _ in range(2)]
    a, b = (words_array(t) for t in texts)
    assert len(passages.dense(np.isin(passages.seeds(a), passages.seeds(b)), 50, 80)) >= passages.needed()
    assert not passages.promising(passages.seeds(a, 2), passages.seeds(b, 2)) and not passages.passages(a, b)
    none = passages.seeds(words_array([]), 2)
    assert not passages.promising(none, passages.seeds(a, 2)) and not passages.promising(passages.seeds(a, 2), none)


def test_words_said_very_often_are_not_chained(monkeypatch):
    """A text that says one word 3,000 times shares no passage with one that says it 20 times, here and there."""
    rnd = random.Random(6)
    fresh = lambda k: [f"x{rnd.random()}" for _ in range(k)]
    often = words_array(fresh(40) + ["on"] * 3000 + fresh(40))
    rare = words_array([w for _ in range(3) for w in fresh(60) + ["on"] * 20])
    monkeypatch.setattr(passages, "chain", None)
    assert passages.passages(often, rare) == passages.passages(rare, often) == []


def plain_growth(a, b):
    """From the start of both lists: every way to leave words out is counted out at each difference."""
    out, p, q, score, best, end = [], 0, 0, 0, 0, 0
    while p < len(a) and q < len(b) and best - score <= passages.DROP:
        if a[p] == b[q]:
            out.append((True, p, q))
            p, q, score, end = p + 1, q + 1, score + 1, len(out)
            best = max(best, score)
            continue
        ways = []
        for d, e, wide in passages.SKIPS:
            run = 0
            while run < 9 and p + d + run < len(a) and q + e + run < len(b) and a[p + d + run] == b[q + e + run]:
                run += 1
            if run or not ways:
                ways.append((4 * wide - run, len(ways), d, e))
        *_, d, e = min(ways)
        out += [(False, p + min(k, d), q + min(k, e)) for k in range(max(d, e))]
        p, q, score = p + d, q + e, score - 4 * max(d, e)
    return out[:end]


def test_growth_takes_the_plain_way():
    rnd = random.Random(9)
    grown = 0
    for turn in range(2000):
        k = rnd.choice([2, 3, 9, 60])
        a = [w for w in rnd.choices(range(k), k=rnd.randrange(30)) for _ in range(rnd.choice([1, 1, 3, 15]))]
        b = [w for w in a for w in ([] if rnd.random() < 0.1 else [w, -1] if rnd.random() < 0.1 else [rnd.choice([w, w, w, w, k])])]
        b = rnd.choices(range(k), k=rnd.randrange(3)) + b
        want = plain_growth(a, b)
        assert passages._grow(a, b, 0, 0, 1) == want
        back = [(m, len(a) - 1 - x, len(b) - 1 - y) for m, x, y in want]
        assert passages._grow(a[::-1], b[::-1], len(a) - 1, len(b) - 1, -1) == back
        grown += len(want) > 20
    assert grown > 200


def test_growth_ends_where_no_word_is_common(monkeypatch):
    monkeypatch.setattr(passages, "SKIPS", None)
    assert passages._grow([1] * 90, [2] * 90, 0, 0, 1) == passages._grow([1] * 90, [2] * 90, 89, 89, -1) == []


def test_every_passage_has_room():
    """The test by words counted as often as held loses nothing in texts full of repeats."""
    rnd = random.Random(8)
    found = 0
    for turn in range(300):
        some = lambda n, k=rnd.choice([2, 4, 12]): [f"w{w}" for w in rnd.choices(range(k), k=n) for _ in range(rnd.choice([1, 2, 7, 20, 45]))]
        base = some(rnd.randrange(1, 30))
        copy = [w for w in base for w in ([] if rnd.random() < 0.05 else [w, "new"] if rnd.random() < 0.05 else [w])]
        a, b = words_array(some(4) + base + some(6)), words_array(some(7) + copy + some(3))
        room = [passages.roomy(u, np.sort(v)) for u, v in ((a, b), (b, a))]
        x, y = passages.matches(passages.seeds(a), passages.seeds(b))
        if len(x) and passages.passages(a, b):
            assert all(room)
            found += 1
    assert found > 100
    none = words_array([])
    assert not passages.roomy(none, np.sort(a)) and not passages.roomy(a, none)


def test_packed_texts_kept_by_a_task(monkeypatch):
    monkeypatch.setattr(passages, "KNOWN", 100)
    known = passages._Known()
    pack = zstandard.ZstdCompressor().compress
    packed = [pack(" ".join(f"w{k}" for k in range(n)).encode()) for n in (60, 70, 30, 200, 10)]
    for turn in packed * 2:
        assert len(known[turn][0]) == len(passages._words([turn])[0])
        assert known.held == sum(len(k[0]) for k in known.values()) and (known.held <= 100 or len(known) == 1)


def test_passage_of_few_seeds(spark):
    """A passage that says the same four words again and again counts at all its places."""
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 80) + " " + "on and on again " * 20 + prose(rnd, 90)) for k in range(3)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found} | {r["source_id"] for r in found} == {0, 1, 2}


def test_all_pairs_of_a_hot_seed(spark, monkeypatch):
    """Blocks of holders meet each other once, every pair of holders is there."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    rows = [(s, r) for s, n in ((1, 30), (2, 1), (3, 2)) for r in range(n)]
    got = passages._all_pairs(spark.createDataFrame(rows, "seed bigint, rep bigint")).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_pairs_are_neither_shuffled_nor_stored(spark):
    """Texts meet where their blocks are read: the disk holds each text once, however many pairs there are."""
    rnd = random.Random(34)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    common = fresh(60)
    docs = spark.createDataFrame([(k, " ".join(fresh(20) + common + fresh(20))) for k in range(40)], "doc_id bigint, text string")
    found = passages.shared_passages(docs)
    assert found.filter("not is_copy").count() == 40 * 39 // 2
    plan = found.filter("not is_copy")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0]
    held = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    kept, _ = passages._kept(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and kept.count() == 1000


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_texts_of_one_id(spark, monkeypatch, cell):
    """Different texts of one id are compared like others; rows that two of them give alike come once."""
    monkeypatch.setattr(passages, "CELL", cell)
    rnd = random.Random(35)
    fresh = lambda n: [f"x{rnd.random()}" for _ in range(n)]
    one, two = fresh(60), fresh(60)
    rows = [(5, one + fresh(30)), (5, one + fresh(40)), (7, one + fresh(20)), (8, two), (9, two + fresh(5))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["source_id"], r["n_words"]) for r in passages.shared_passages(docs).collect())
    assert got == [(5, 0, 60, 5, 60), (7, 0, 60, 5, 60), (9, 0, 60, 8, 60)]


def test_texts_of_two_blocks_that_meet(spark, monkeypatch):
    """The pairs that cells find, a few meetings of keys at a time, are those of the holders of every key."""
    monkeypatch.setattr(passages, "MEETINGS", 7)
    rnd = random.Random(36)
    held = [[(rep, np.array(sorted({rnd.choice((1, rnd.randrange(2, 40))) for _ in range(rnd.randrange(1, 9))}), np.uint64)) for rep in range(low, low + 15)] for low in (0, 15)]
    sides = []
    for texts_of in held:
        block = passages._Block()
        for rep, keys in texts_of:
            block.add({"rep": rep, "first_id": rep, "packed": b"%d" % rep}, False, keys)
        sides.append(passages._Side(*[block.row().column(n)[0].as_py() for n in block.names]))
    assert [sides[1].text(k) for k in range(15)] == [b"%d" % (15 + k) for k in range(15)]
    rows = [(int(key), rep) for texts_of in held for rep, keys in texts_of for key in keys]
    want = sorted(map(tuple, passages._all_pairs(spark.createDataFrame(rows, "seed bigint, rep bigint")).collect()))
    got = [(int(i) + a, int(j) + b) for a, b in ((0, 0), (0, 15), (15, 15)) for i, j in zip(*passages._met(sides[a // 15], sides[b // 15])) if a != b or i < j]
    assert sorted(got) == want


def test_passage_held_twice():
    rnd = random.Random(5)
    fresh = lambda k: [f"x{rnd.random()}" for _ in range(k)]
    shared = fresh(60)
    got = passages.passages(words_array(fresh(30) + shared + fresh(40) + shared), words_array(fresh(20) + shared))
    assert sorted(g[:2] for g in got) == [(30, 90), (130, 190)]


def test_licenses(spark, docs, none):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "The work was Released under the MIT license and more words follow here"),
        (3, "This work is licensed under the GNU General Public Licence, version 3"),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."),
        (6, "He renewed his driving license last week"), (7, None), (8, ""),
        (9, "x " * 40_000 + "Released under the MIT License."),
        (10, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
    ]
    found = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")))
    names = {i: [r["license"] for r in sorted(rs, key=lambda r: r["place"])] for i, rs in found.items()}
    assert names == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["GPL-3.0"], 4: ["CC-BY-NC-4.0"], 5: ["CC-BY-4.0"], 9: ["MIT"], 10: ["Apache-2.0", "MIT"]}
    assert found[1][0]["exact"] and found[3][0]["differences"] == "-license +licence"
    assert {r["license"] for r in licenses.scan(docs).collect()} == {"Apache-2.0"}
    assert licenses.scan(none).count() == 0


MIT_HEADER = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal"""
BSD_HEADER = """/* Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met: */"""
GPL_HEADER = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version."""


def licenses_of(*rows):
    return [[n[1] for _, block in licenses.blocks(r.encode()) for n in licenses.judge(block)] for r in rows]


def test_licenses_over_lines():
    assert licenses_of(MIT_HEADER, BSD_HEADER, GPL_HEADER) == [["MIT"], ["BSD-2-Clause / BSD-3-Clause"], ["GPL-3.0"]]
    far = "é\n" * 300
    assert licenses_of(far + GPL_HEADER + "\n" + far, "Permission is\n * hereby granted" + MIT_HEADER[32:]) == [["GPL-3.0"], ["MIT"]]
    ((place, block),) = licenses.blocks((far + GPL_HEADER).encode())
    assert place + licenses.judge(block)[0][0] == len((far + "// ").encode())


def test_every_license_of_a_block():
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    grant = " ".join(MIT_HEADER.replace("#", "").split())
    late = "Copyright " + "someone and others " * 13 + grant
    assert licenses_of(two, "Copyright 2020 X. All rights reserved. " + BSD_HEADER, late) == [
        ["MIT", "Apache-2.0"], ["BSD-2-Clause / BSD-3-Clause"], ["MIT"]]
    assert licenses_of(" and ".join([two, grant] * 3)) == [["MIT", "Apache-2.0", "MIT"] * 3]
    assert licenses_of("word " * 500 + "license " * 500 + two + " license" * 500) == [["MIT", "Apache-2.0"]]


def test_telling_words_decide_between_licenses():
    head = "This %s is free software; you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    assert licenses_of(head % ("program", "", "2"), head % ("program", "", "3"), head % ("library", "Lesser ", "2.1"), head % ("file", "Lesser ", "3"),
                       head % ("program", "Affero ", "3"), head % ("program", "", "9")) == [["GPL-2.0"], ["GPL-3.0"], ["LGPL-2.1"], ["LGPL-3.0"], ["AGPL-3.0"], []]
    lines = ["GPL-2.0-or-later", "BSD-2-Clause", "Apache-2.0 OR MIT", "ISC", "GPL-2.0-only WITH Classpath-exception-2.0"]
    assert licenses_of(*["# SPDX-License-Identifier: " + x + "\n# more" for x in lines]) == [[x] for x in lines]
    assert licenses_of("Copyright 2020 Me. All rights reserved.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.") == [["proprietary"], ["ISC"]]
    assert licenses_of("Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-ND 4.0.") == [["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], ["CC-BY-4.0"], []]


def test_notices_inside_notices_end():
    inner = "Licensed under the SPDX-License-Identifier: MIT Apache License, Version 2.0."
    assert licenses_of(inner) == [["MIT"]]


def test_every_template_is_found_and_no_other_number(spark):
    """Brute force over all templates: each wording by itself names its licenses, with another number none of them."""
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            if wording.startswith("SPDX"):
                continue
            (found,) = licenses_of(wording)
            assert len(found) == 1 and name in found[0].split(" / "), wording
            for number in re.findall(r"\d+(?:\.\d+)?(?!-)", wording):
                (other,) = licenses_of(wording.replace(number, "77"))
                assert not any(name in n.split(" / ") for n in other), wording


def test_the_dictionaries_decide(monkeypatch):
    """With every template given another one's dictionary the ranking no longer names the license."""
    plain, coders = licenses._coders()
    names = list(coders)
    monkeypatch.setattr(licenses, "_coders", lambda: (plain, {n: coders[names[(k + 9) % len(names)]] for k, n in enumerate(names)}))
    changed = [w for n, ws in licenses.TEMPLATES.items() for w in ws if not w.startswith("SPDX") and licenses_of(w) != [[n]]]
    assert len(changed) > 20


def test_every_operator_is_registered(spark):
    from vacantia.llm import queries

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
