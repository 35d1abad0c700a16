"""The numbered queries, each its operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm import audio, audit, bpe, decontaminate, fingerprints, importance, language, mixing, near_dedup, sharding, substring_dedup, token_counts, url_filter
from terragrid.llm.shared import new_folder

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hosts blocked where no rule fits.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("cheap-pills", "spam-farm") for top in ("com", "net", "org")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrivals that the sharding query splits documents into.
ARRIVALS = 4


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard (its place in the manifest), shard_bytes, version: where each document is after compaction."""
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    shards = sharding.compacted([docs.where(part == i) for i in range(ARRIVALS)], new_folder(spark, "shards"))
    version = shards.version()
    rows = shards.read(version).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.col("_metadata.file_name").alias("file"))
    return rows.join(shards.listing(version), "file").select("doc_id", "n_bytes", "shard", F.col("bytes").alias("shard_bytes"), F.lit(version).alias("version"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_audio_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: each text's UTF-8 bytes are the recording, as unsigned 8-bit PCM at 8 kHz."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("media"))
    return audio.align(docs, "media", "u8", rate=8000, frame=256, hop=64, id_col="doc_id").withColumnRenamed("id", "doc_id")


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs.select("doc_id", "text"), language.learn(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_repeated_spans": op3_repeated_spans,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_audio_align": op5_audio_align,
    "op6_fair_mix": op6_fair_mix,
    "op7_language": op7_language,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_url_cascade": op10_url_cascade,
    "op11_importance": op11_importance,
    "op12_decontaminate": op12_decontaminate,
    "op13_filter_audit": op13_filter_audit,
}

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_ACTIONS = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in RULES)
_BANNED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)

ORACLES: dict[str, str] = {
    "op6_fair_mix": r"""
WITH RECURSIVE u AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY source),
w AS (SELECT *, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::BIGINT AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS heavy FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
c AS (SELECT *, before::DOUBLE + cap::DOUBLE / weight * heavy <= total::DOUBLE AS stopped FROM l),
t AS (SELECT source, source_size, total, CASE WHEN stopped THEN cap::DOUBLE ELSE
  (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)::BIGINT)::DOUBLE / (sum(weight) FILTER (NOT stopped) OVER ())::BIGINT * weight END AS target FROM c),
g AS (SELECT doc_id, source, size, count(*) AS n, md5(coalesce(doc_id::VARCHAR, '') || '|0') AS key FROM u GROUP BY ALL),
q AS (SELECT g.*, source_size, total, target, sum(size * n) OVER (PARTITION BY g.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, unnest([1, 2, 3]) AS epoch FROM q WHERE size > 0 AND target > 0),
f AS (SELECT *, ((epoch - 1) * source_size + upto)::DOUBLE / target AS finish FROM e WHERE epoch <= ceil(target / source_size)),
r AS (SELECT *, sum(size * n) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS run FROM f),
k AS (SELECT doc_id, source, size, count(*)::BIGINT AS copies, min(finish) AS finish FROM r WHERE run <= total GROUP BY ALL)
SELECT u.doc_id, u.size, t.source_size, t.target, u.size * coalesce(k.copies, 0) AS taken, k.finish FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON u.doc_id IS NOT DISTINCT FROM k.doc_id AND u.source IS NOT DISTINCT FROM k.source AND u.size = k.size""",
    "op10_url_cascade": f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT *, CASE {_FITS} END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {_ACTIONS} END, CASE WHEN {_BANNED} THEN 'block' ELSE 'allow' END) AS verdict FROM m""",
    "op12_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
o AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT r, n, s, item FROM o JOIN i USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, step, letter, 1 << (ascii(letter) - 65) AS bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END)) AS before
  FROM (SELECT filter_order, step, filter_order[step] AS letter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))),
g AS (SELECT part, filter_order, step, letter, mask & bit <> 0 AS fails, mask & coalesce(before, 0)::INT <> 0 AS gone, mask = bit AS alone, good, toxic, n FROM c, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost,
  coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r""",
}
