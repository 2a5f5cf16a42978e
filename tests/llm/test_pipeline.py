"""The stages of the corpus pipeline, each against what its operator has to do."""

import random

import corpus_pipeline
from tests.llm.test_operators import Groups, prose, removed, sets_of, smallest

NAMES = ["quality rules", "minhash near-dedup", "suffix-array dedup", "source mixing", "byte-level bpe"]


def table(spark):
    rnd = random.Random(21)
    base = [prose(rnd, 150) for _ in range(30)]
    passage = prose(rnd, 70)
    rows = base + base[:5] + [prose(rnd, 100) + " " + passage for _ in range(4)]
    rows += [None, "", "too short", "again and again " * 50, "### $$$ %%% " * 60]
    data = [(i, t, "en", "ab"[i % 2], None if t is None else len(t)) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    docs = table(spark)
    clean = stages[0](spark, docs, None)
    assert clean.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in clean.collect()) == list(range(39))
    single = stages[1](spark, clean, None)
    rows = clean.collect()
    sets = [sets_of(r["text"], 5) for r in rows]
    groups = Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    left = sorted(set(smallest([r["doc_id"] for r in rows], groups)))
    assert sorted(r["doc_id"] for r in single.collect()) == left
    assert len(left) == 34
    cut = stages[2](spark, single, None)
    rows = single.collect()
    want = {r["doc_id"]: kept.decode("utf-8", "ignore") for r, (*_, kept) in zip(rows, removed([r["text"] for r in rows], 200))}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    mixed = stages[3](spark, cut, None)
    assert mixed.columns == corpus_pipeline.COLUMNS
    coded = stages[4](spark, mixed, None)
    assert coded.count() == mixed.count() and coded.filter("size(ids) <> n_tokens").count() == 0


def test_stages_take_empty_tables(spark):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == 0
