"""The thirteen operators as queries over the given tables, and their SQL."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, chat, hmm, packing, prefix_trie, quality, resampling, rules, secrets, sharding, simhash, tiled, transport
from framewright.llm.shared import bucket, fresh, materialize, raw, shared_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(found)


def op4_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def padded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: (b := raw(t)) + b" " * (-len(b) % 192 if b else 192))

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for media in part:
                media = bytes(media)
                found = transport.demux(media)
                data = found["payload"]
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), transport.features(data, found)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest(transport.muxed(padded("text"))).alias("r"))
    return docs.select("doc_id", "n_bytes", "r.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.digested(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("r")).select("doc_id", "r.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.trained(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (bucket(F.col("doc_id"), quality.FOLDS) == quality.HELD).alias("held_out"), quality.probability(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", rules.measured(F.col("text")).alias("stats"))
    rows, _ = materialize(docs, "stats")
    return rules.judged(rows).select("doc_id", "stats.*", "verdict.*")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.scanned(F.col("text")).alias("spans"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Arrivals that the sharding query appends, by a hash of the id.
ARRIVALS = 4


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact(docs.schema)
        store.expire()
    sizes = store.manifest().select("shard", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), F.col("level").alias("shard_level"))
    name = fresh(docs.columns, "shard")
    placed = store.read(docs.schema, shard_as=name).select("doc_id", F.col(f"`{name}`").alias("shard"))
    return placed.join(sizes, "shard").select("doc_id", F.element_at(F.split("shard", "/"), -1).alias("shard"), "shard_rows", "shard_bytes", "shard_level")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_hmm, op3_packing, op4_transport, op5_bpe, op6_quality, op7_chat, op8_rules, op9_secrets, op10_sharding, op11_resampling, op12_prefix_trie, op13_tiled)}

def _crc32(text: str) -> str:
    """DuckDB SQL of a text's CRC-32 (it has no function of its own); ``crc``
    must be a table in scope of the 256 remainders, as the list ``t``."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * k + 1)::BIGINT, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda k: {byte})), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"

ORACLES: dict[str, str] = {
    "op11_resampling": rf"""
WITH {_CRC_TABLE}, said AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT side, row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM said
), hashed AS (
  SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc
), held AS (
  SELECT side, row, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM held GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM held JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS deviate
  FROM said LEFT JOIN weighed USING (row) WHERE side = 'd'
), ranked AS (
  SELECT *, weight + deviate AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + deviate DESC, doc_id NULLS LAST) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM ranked
""",
    "op13_tiled": r"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), able AS MATERIALIZED (
  SELECT * FROM given WHERE len(v) > 0 AND len(list_filter(v, lambda c: c IS NOT NULL AND isfinite(c))) = len(v) AND list_sum(list_transform(v, lambda c: abs(c))) > 0
), links AS (
  SELECT a.row AS a, b.row AS b FROM able a JOIN able b ON a.row <> b.row AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) ELSE -1 END >= 0.95
), reach AS (
  SELECT row AS a, row AS b FROM given UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a AS row, min(g.vec_id) AS component_id FROM reach r JOIN given g ON g.row = r.b GROUP BY 1
)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.row) AS n_links, component_id, g.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM given g JOIN least USING (row)
""",
    "op12_prefix_trie": rf"""
WITH {_CRC_TABLE}, said AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT c, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS turns FROM said GROUP BY c
), headed AS (
  SELECT c, turns, {_crc32("c::VARCHAR")} % 4 AS h FROM whole, crc
), rebuilt AS (
  SELECT a.c, CASE WHEN b.c IS NULL THEN a.turns[a.h + 1:] ELSE list_concat(b.turns[1:a.h], a.turns[a.h + 1:]) END AS turns
  FROM headed a LEFT JOIN whole b ON b.c = a.c - a.c % 20
), reached AS (
  SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt
), nodes AS (
  SELECT turns[1:d] AS path, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(turns[d].words), 0) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = d), '')) AS ends FROM reached GROUP BY turns[1:d]
), children AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), ups AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (path)
), totals AS (
  SELECT path[1:a] AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM ups) GROUP BY 1
)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, u.ends AS ends_sha256
FROM ups u JOIN totals t USING (path) LEFT JOIN nodes p ON u.d > 0 AND p.path = u.path[1:u.d - 1]
""",
    "op7_chat": r"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), logged AS (
  SELECT conv_id, count(*) AS n_turns,
    list(concat(role, chr(31), sha256(text)) ORDER BY turn NULLS FIRST, role, sha256(text)) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text)) AS text
  FROM said GROUP BY conv_id
), prefix AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM logged)
)
SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS copies, any_value(text) AS text
FROM logged ANTI JOIN prefix USING (turns) GROUP BY turns
""",
}
