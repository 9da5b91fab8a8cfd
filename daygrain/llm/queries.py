"""The queries op1 to op13 over whole tables, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daygrain.llm import alignment, langid, lattice, lm, minhash, mixing, packing, phrases, quality, records, secrets, simhash, superkmers
from daygrain.llm.common import table


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.predictions(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(table(spark, sf_dir, "documents"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near(table(spark, sf_dir, "embeddings"))


def op11_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digest(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_log_bilinear": op5_log_bilinear,
    "op6_source_mix": op6_source_mix,
    "op7_token_records": op7_token_records,
    "op8_minhash": op8_minhash,
    "op9_secret_scan": op9_secret_scan,
    "op10_lattice": op10_lattice,
    "op11_superkmers": op11_superkmers,
    "op12_phrases": op12_phrases,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op6_source_mix": r"""
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
  sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s2),
s4 AS (SELECT *, (budget - capped) * w / open_w > cap AS is_full FROM s3),
s5 AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0.0) AS full_sum, sum(w) FILTER (NOT is_full) OVER () AS rest_w FROM s4),
s AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (budget - full_sum) * w / rest_w END AS target FROM s5),
c AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.source,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, (cum + epoch * source_size)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) v(epoch)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, size, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
  (SELECT floor(sum(target) + 0.25) FROM s) AS budget FROM e)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, budget - (run - size))))::BIGINT AS taken
FROM r GROUP BY doc_id, size, source_size, target""",
    "op11_superkmers": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws)::BIGINT AS n_words, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
hit AS (SELECT v.doc_id, v.i FROM v JOIN (SELECT g, min(doc_id) AS least FROM v GROUP BY g) f USING (g) WHERE v.doc_id > f.least),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(13)) AS j)),
k AS (SELECT w.doc_id, count(gone.i)::BIGINT AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.*, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1 : k], ' ') AS y FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (fx.a * fy.a) AS score,
  row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000000::HUGEINT * cuts.a * cuts.a) // (fx.a * fy.a), cut) AS nth
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = cuts.x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = cuts.y),
held AS (SELECT lang, part, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.part = s.phrase WHERE s.nth = 1 AND (h.longest IS NULL OR 100 * h.longest < 50 * s.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT o.lang, o.rank::BIGINT AS rank, o.phrase, o.a::BIGINT AS a, o.l::BIGINT AS l, o.r::BIGINT AS r, n.n, o.score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000""",
}
