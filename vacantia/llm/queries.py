"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from pyspark.sql import functions as F

from vacantia.llm import (
    bpe,
    epsilon_join,
    fertility,
    hard_negatives,
    licenses,
    minhash,
    mixing,
    passages,
    shards,
    suffixes,
    token_counts,
    vector_codes,
    word_bpe,
)

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (SELECT *, floor(sqrt(size))::BIGINT + 1 AS preference FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(preference * size)::BIGINT AS preferred_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight
  FROM p GROUP BY source
), l AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS full_words,
    sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s
), c AS (SELECT *, source_size * 3 * open_weight <= (total - full_words) * weight AS capped FROM l),
t AS (
  SELECT *, coalesce(CASE WHEN capped THEN source_size * 3.0::DOUBLE ELSE
    ((max(total) OVER () - sum(CASE WHEN capped THEN source_size * 3 ELSE 0 END) OVER ())::DOUBLE * weight)
    / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END, 0.0)::DOUBLE AS target FROM c
), w AS (SELECT *, coalesce(least(3, floor(target / nullif(source_size, 0))), 0)::BIGINT AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM w),
o AS (
  SELECT p.doc_id, p.source, p.size, r.source_size, r.target, r.whole, r.rest,
    (('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(p.doc_id::VARCHAR, ''), coalesce(p.source, ''), p.size::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0::DOUBLE AS u,
    least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, coalesce(r.rest * p.preference / nullif(r.preferred_size, 0), 0.5))) AS chance
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
), q AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS odds FROM o),
g AS (
  SELECT source, odds, any_value(rest) AS rest, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY odds) AS upto
  FROM q WHERE size > 0 GROUP BY source, odds
)
SELECT q.doc_id, q.size, q.source, q.source_size, q.target,
  ((q.whole + CASE WHEN g.upto - g.words / 2 <= g.rest THEN 1 ELSE 0 END) * q.size)::BIGINT AS taken,
  (q.whole + CASE WHEN g.upto - g.words / 2 <= g.rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM q LEFT JOIN g ON q.source IS NOT DISTINCT FROM g.source AND q.odds = g.odds AND q.size > 0
"""


SHARD_SQL = f"""
WITH crc AS (  -- CRC-32 of each byte value
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))
), h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
d AS (
  SELECT doc_id, source, (n + 8)::BIGINT AS size, md5('{shards.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS shuffle,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM h, crc
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffle, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / (2 * n), source NULLS LAST, shuffle, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * 24 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM s
"""


#: Usable vectors as whole numbers; ``{label}`` is the label's expression.
WHOLE_SQL = """
v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

NEGATIVES_SQL = f"""
WITH {WHOLE_SQL.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")},
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * r.c[i]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0 AND a.label IS NOT NULL AND r.label IS NOT NULL
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _round_sql(n):
    """One round of assigning (``a{n}``) and averaging: books ``b{n}`` become ``b{n + 1}``."""
    return f"""
a{n} AS (
  SELECT x.vec_id, x.part, x.piece, min((list_sum(list_transform(range(1, len(piece) + 1),
    lambda i: (piece[i] - entry[i]) * (piece[i] - entry[i])))::BIGINT * 64 + code)) AS best
  FROM x JOIN b{n} b ON x.part = b.part GROUP BY x.vec_id, x.part, x.piece
), m{n} AS (
  SELECT part, best % 64 AS code, place, sum(piece[place])::BIGINT AS total, count(*) AS n
  FROM a{n}, (SELECT unnest(range(1, (SELECT width + 1 FROM w))) AS place) GROUP BY ALL
), b{n + 1} AS (
  SELECT b.part, b.code, coalesce(any_value(l.moved), any_value(b.entry)) AS entry FROM b{n} b LEFT JOIN (
    SELECT part, code, list((total - ((total % n) + n) % n) // n ORDER BY place) AS moved FROM m{n} GROUP BY part, code
  ) l ON b.part = l.part AND b.code = l.code GROUP BY b.part, b.code
)"""


CODES_SQL = f"""
WITH {WHOLE_SQL.format(label="label")},
w AS (SELECT max(len(c)) // 16 AS width FROM v),
x AS (SELECT vec_id, label, part, c[part * width + 1 : part * width + width] AS piece FROM v, w, (SELECT unnest(range(16)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM v QUALIFY code < 64),
b0 AS (SELECT part, code, piece AS entry FROM x JOIN f USING (vec_id)),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2).split(", m2 AS")[0]},
h AS (SELECT sha256(string_agg(number, ',' ORDER BY part, code)) AS codebooks_sha256
  FROM (SELECT part, code, array_to_string(entry, ',') AS number FROM b2)),
r AS (
  SELECT vec_id, string_agg(lower(lpad(printf('%x', best % 64), 2, '0')), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error
  FROM a2 GROUP BY vec_id
)
SELECT r.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN v USING (vec_id), h
"""


@query("op1_pareto_mix", MIX_SQL)
def op1(spark, sf_dir):
    """All documents mixed to weights 1, 2, 3 in turn, targets at most three times a source."""
    return mixing.with_copies(table(spark, sf_dir, "documents"))


@query("op2_chained_passages")
def op2(spark, sf_dir):
    """Fuzzy passages of 50 words or more that documents share."""
    return passages.shared_passages(table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_epsilon_join")
def op5(spark, sf_dir):
    return epsilon_join.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_circulant_minhash")
def op6(spark, sf_dir):
    """Near-duplicates of all documents by two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_interleaved_shards", SHARD_SQL)
def op8(spark, sf_dir):
    """All documents in 24 shards whose row counts differ by one at most."""
    placed = shards.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query("op10_fertility")
def op10(spark, sf_dir):
    measured = fertility.measure(table(spark, sf_dir, "documents"))
    return measured.select("doc_id", *BASE, "chars_per_piece", "chars_per_token", "fallback_share", "entropy", "band")


@query("op11_residue_negatives", NEGATIVES_SQL)
def op11(spark, sf_dir):
    """Hard negatives of all anchors against all vectors; every seventh label is off by one."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


@query("op12_word_bpe")
def op12(spark, sf_dir):
    """All documents by the vocabulary of words with ends, encoded and decoded."""
    return word_bpe.encode(table(spark, sf_dir, "documents"))


@query("op13_orchard_codes", CODES_SQL)
def op13(spark, sf_dir):
    """Codes of all vectors: 16 parts, 64 entries each, two rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
