"""The queries ``op1_`` to ``op10_`` over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.llm import audio, license_scan, lm, minhash, mixing, order_minhash, packing, quality, sharding, substrings
from lodespar.llm._shared import documents

#: Source weights, in the order of the sources, repeating.
WEIGHTS = [5, 2, 1]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir), WEIGHTS, most=3))


def op2_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.summary(audio.audio_columns(documents(spark, sf_dir)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(documents(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path())).drop("row")


def op6_ngram_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(documents(spark, sf_dir), least=1)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir)))


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_audio_columns,
        op3_minhash_near_dedup,
        op4_substring_dedup,
        op5_best_fit_packing,
        op6_ngram_trie_scores,
        op7_order_minhash,
        op8_quality_classifier,
        op9_license_scan,
        op10_stratified_shards,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_KEYED = "CASE WHEN source IS NULL THEN '1' ELSE '0' || source END"
_SHUFFLE = "CAST('0x' || substr(md5('17' || chr(31) || doc_id || chr(31) || md5(coalesce(text, ''))), 1, 15) AS BIGINT)"


def _op1_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, {_KEYED} AS k, len({_WORDS}) AS size, {_SHUFFLE} AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY k) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY k),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM s WINDOW b AS (ORDER BY source_size * 3 / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(CAST(source_size * 3 AS DOUBLE), max(level) OVER () * w) AS target FROM l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota, coalesce(sum(target) OVER (ORDER BY k) / nullif(sum(target) OVER (), 0), 0) AS hi FROM t),
x AS (SELECT d.*, source_size, target, quota, row_number() OVER () AS id, CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM d JOIN q USING (k)),
n AS (SELECT CAST(ceil(sum(size) / {mixing.BLOCK}) AS BIGINT) AS n FROM d),
p AS (SELECT i, (i % {mixing.TURN} * {mixing.GOLDEN}) % {mixing.TURN} / {mixing.TURN}::DOUBLE AS p FROM (SELECT unnest(range(n)) AS i FROM n)),
m AS (SELECT k, i AS slot, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS rank FROM p JOIN (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo, hi FROM q) ON p >= lo AND p < hi),
y AS (SELECT k, unnest(range((quota + {mixing.BLOCK - 1}) // {mixing.BLOCK})) AS rank FROM q),
z AS (SELECT k, rank, coalesce(slot, n + rank) AS slot FROM y LEFT JOIN m USING (k, rank), n),
e AS (SELECT id, k, a + e * source_size AS a, least(a + e * source_size + size, quota) AS z FROM x, range(3) r(e) WHERE size > 0 AND a + e * source_size < quota),
f AS (SELECT id, z.slot, least(e.z, (z.rank + 1) * {mixing.BLOCK}) - greatest(e.a, z.rank * {mixing.BLOCK}) AS words FROM e JOIN z ON z.k = e.k AND z.rank BETWEEN e.a // {mixing.BLOCK} AND (e.z - 1) // {mixing.BLOCK})
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(words), 0) AS BIGINT) AS taken, min(slot) AS first_slot, count(slot) AS n_slots FROM x LEFT JOIN f USING (id) GROUP BY id, doc_id, size, source_size, target"""


_OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

_OP4_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT x, min(doc_id) AS first FROM v GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM v JOIN m USING (x) WHERE first < doc_id),
e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def _op9_sql() -> str:
    of = license_scan.prepared(license_scan.TEMPLATES)
    templates = ", ".join(f"({k}, '{t.name}', {len(t.bigrams)}, {t.least}, {t.most}, {t.span}, {t.seed})" for k, t in enumerate(of))
    bigrams = ", ".join(f"({k}, '{b}')" for k, t in enumerate(of) for b in t.bigrams)
    return f"""WITH t(k, license, n, least, most, span, seed) AS (VALUES {templates}), tb(k, b) AS (VALUES {bigrams}),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(regexp_replace(replace(lower(coalesce(text, '')), 'licence', 'license'), '(?:{license_scan.VERBS})([^\\p{{L}}\\p{{N}}]+under)', 'licensed\\1', 'g'), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
p AS (SELECT id, i, w[i + 1] || ' ' || w[i + 2] AS b FROM (SELECT id, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
a AS (SELECT id, k, i, b FROM p JOIN tb USING (b)),
g AS (SELECT id, k FROM a JOIN t USING (k) GROUP BY id, k, least HAVING count(DISTINCT b) >= least),
o AS (SELECT id, k, i, i - row_number() OVER (PARTITION BY id, k ORDER BY i) AS run FROM a SEMI JOIN g USING (id, k)),
s AS (SELECT id, k, min(i) AS s FROM o JOIN t USING (k) GROUP BY id, k, run, seed HAVING count(*) >= seed),
v AS (SELECT id, i, b, coalesce(lag(i) OVER (PARTITION BY id, b ORDER BY i), -1) AS before FROM p SEMI JOIN g USING (id)),
x AS (SELECT id, k, s, i, before < s AS new, before < s AND o.i IS NOT NULL AS own FROM s JOIN t USING (k) JOIN v USING (id) LEFT JOIN o USING (id, k, i) WHERE i BETWEEN s AND s + span - 1),
c AS (SELECT id, k, s, i, sum(new::INT) OVER f AS w, sum(own::INT) OVER f AS c FROM x WINDOW f AS (PARTITION BY id, k, s ORDER BY i)),
h AS (SELECT id, k, license, n, s, i - s + 2 AS words, c * 2.0::DOUBLE / (w + n) AS dice FROM c JOIN t USING (k) WHERE w BETWEEN least AND most AND c * 2.0::DOUBLE / (w + n) >= {license_scan.THRESHOLD}),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY dice DESC, s, words) = 1),
r AS (SELECT * FROM b h WHERE NOT EXISTS (SELECT 1 FROM b g WHERE g.id = h.id AND (g.dice, g.n, -g.k) > (h.dice, h.n, -h.k) AND (least(g.s + g.words, h.s + h.words) - greatest(g.s, h.s)) * 2 >= h.words)),
q AS (SELECT id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, max(dice) AS best, first(s ORDER BY dice DESC, s, words DESC) AS s, first(words ORDER BY dice DESC, s, words DESC) AS words FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_hits, coalesce(licenses, '') AS licenses, coalesce(best, 0.0) AS best_dice, CAST(s AS BIGINT) AS first_word, CAST(words AS BIGINT) AS hit_words FROM d LEFT JOIN q USING (id)"""


_OP10_SQL = f"""WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, {_KEYED} AS k, strlen(coalesce(text, '')) AS bytes, {_SHUFFLE} AS h,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS r, count(*) OVER (PARTITION BY k) AS n, count(*) OVER () AS total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, k, r) - 1 AS pos FROM r)
SELECT doc_id, bytes + 16 AS size, crc AS text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INTEGER) AS shard, CAST(pos - (pos * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

#: The others: 2 (WAV, CRC-32), 5 (a tokenizer), 6 (a trie), 7 (hashes of k-mers) and 8 (a fitted model)
#: have no SQL form; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": _op1_sql(),
    "op3_minhash_near_dedup": _OP3_SQL,
    "op4_substring_dedup": _OP4_SQL,
    "op9_license_scan": _op9_sql(),
    "op10_stratified_shards": _OP10_SQL,
}
