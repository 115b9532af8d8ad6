"""The operators of this folder over the driver tables, and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.registry import Tables
from . import alignment, bpe, chat, exact_dedup, fertility, language, mixing, periodic, quality_fm, sharding, simhash, toxicity, word_bpe
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _mixed_sql(half: str) -> str:
    y = f"(({half} + key) % {sharding.PRIME})"
    z = f"(({y} * {y} % {sharding.PRIME} * {sharding.FACTOR} + {y}) % {sharding.PRIME})"
    return f"({z} * {z} % {sharding.PRIME})"


OP1_SQL = f"""
WITH RECURSIVE total AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*), 1) - 1)) AS BIGINT) + 1 AS root FROM documents),
grid AS (
  SELECT n, h, (n + h - 1) // h AS w FROM total, range(root, 2 * root + 1) t(h) ORDER BY (h - n % h) % h, h LIMIT 1),
walk AS (
  SELECT number, number // w AS l, number % w AS r, 0 AS i, h, w, n
  FROM (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number FROM documents), grid
  UNION ALL
  SELECT number,
         CASE WHEN i % 2 = 1 THEN l ELSE (l + {_mixed_sql("r")}) % h END,
         CASE WHEN i % 2 = 1 THEN (r + {_mixed_sql("l")}) % w ELSE r END,
         i + 1, h, w, n
  FROM (SELECT *, {list(sharding.KEYS)}[i % {len(sharding.KEYS)} + 1] AS key FROM walk)
  WHERE i = 0 OR i % {len(sharding.KEYS)} > 0 OR l * w + r >= n),
placed AS (SELECT number, l * w + r AS place FROM walk WHERE i > 0 AND i % {len(sharding.KEYS)} = 0 AND l * w + r < n),
steps AS (
  SELECT b, 0 AS k, b AS c FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32,
       'rows' AS law, number, CAST(place % 16 AS INTEGER) AS shard, place // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM docs JOIN placed USING (number), crcs
"""


@query("op1_sharding", OP1_SQL)
def op1(t: Tables) -> DataFrame:
    return sharding.shards(t.documents, 16)


@query("op2_simhash")
def op2(t: Tables) -> DataFrame:
    return simhash.near_duplicates(t.documents, shingle=4, most=4)


@query("op3_bpe")
def op3(t: Tables) -> DataFrame:
    return bpe.encode(t.documents, RANKS, PATTERN, with_ids=False)


@query("op4_toxicity")
def op4(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("held_out", held_out(1, 3))
    training = t.labels.filter(~held_out(1, 3)).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.toxicity(docs, training, "held_out")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op5_fertility")
def op5(t: Tables) -> DataFrame:
    return fertility.measures(t.documents, RANKS, PATTERN, PIECES)


@query("op6_language")
def op6(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("held_out", held_out(2, 4))
    return language.predict(docs, language.learn(docs.filter("not held_out")), "held_out")


@query("op7_chat")
def op7(t: Tables) -> DataFrame:
    return chat.repair(t.conversations)


@query("op8_quality_fm")
def op8(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("held_out", held_out(0, 5))
    labels = t.labels.filter(~held_out(0, 5)).select("doc_id", F.col("quality").alias("label"))
    return quality_fm.score(docs, quality_fm.learn(docs, labels), "held_out").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


OP9_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, (n + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks,
         greatest(1, CAST(round({mixing.PERIOD} * sqrt(n) / sum(sqrt(n)) OVER ()) AS BIGINT)) AS w
  FROM counts),
-- One slot after the other: of the blocks released, the one that is due first.
runs AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS start, 0 AS phase, 0::BIGINT AS i, 0::BIGINT AS w, 0::BIGINT AS block,
         0::BIGINT AS release, 0::BIGINT AS deadline, 0::BIGINT AS next_start, 0 AS next_phase,
         list({{'i': i, 'w': w, 'have': blocks, 'j': 0::BIGINT, 'done': 0::BIGINT}} ORDER BY i) AS state
  FROM weights
  UNION ALL
  SELECT now, next_start, next_phase, p.i, p.w, p.done + p.j, next_start + p.j * total // p.w,
         next_start + ((p.j + 1) * total + p.w - 1) // p.w,
         CASE WHEN p.have = 1 THEN now + 1 ELSE next_start END,
         CASE WHEN p.have = 1 THEN next_phase + 1 ELSE next_phase END,
         list_filter(list_transform(state, lambda x: {{
           'i': x.i, 'w': x.w, 'have': x.have - CAST(x.i = p.i AS BIGINT),
           'j': CASE WHEN p.have = 1 THEN 0 ELSE x.j + CAST(x.i = p.i AS BIGINT) END,
           'done': CASE WHEN p.have = 1 THEN x.done + x.j + CAST(x.i = p.i AS BIGINT) ELSE x.done END}}), lambda x: x.have > 0)
  FROM (
    SELECT *, list_filter(state, lambda x: x.i = best % 1000000)[1] AS p
    FROM (
      SELECT *, list_min(list_transform(
        list_filter(state, lambda x: x.j * total // x.w <= now - next_start),
        lambda x: ((x.j + 1) * total + x.w - 1) // x.w * 1000000 + x.i)) AS best
      FROM (SELECT *, slot + 1 AS now, list_sum(list_transform(state, lambda x: x.w))::BIGINT AS total FROM runs WHERE len(state) > 0)))),
numbered AS (
  SELECT doc_id, source, row_number() OVER (
    PARTITION BY source ORDER BY md5(CASE WHEN doc_id IS NULL THEN '17' ELSE '17:' || doc_id END), doc_id) - 1 AS number
  FROM documents)
SELECT d.doc_id, d.source, r.w AS weight, r.block, r.phase, r.release, r.deadline, r.slot,
       r.slot * {mixing.BLOCK_ROWS} + d.number % {mixing.BLOCK_ROWS} AS position
FROM numbered d JOIN weights s ON d.source IS NOT DISTINCT FROM s.source
JOIN runs r ON r.i = s.i AND r.block = d.number // {mixing.BLOCK_ROWS} AND r.slot >= 0
"""


@query("op9_mixing", OP9_SQL)
def op9(t: Tables) -> DataFrame:
    return mixing.mixed(t.documents)


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)
"""


@query("op10_exact_dedup", OP10_SQL)
def op10(t: Tables) -> DataFrame:
    return exact_dedup.exact_duplicates(t.documents)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, the words from some place on repeat a few of the original ones to the end."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op11_periodic")
def op11(t: Tables) -> DataFrame:
    return periodic.digests(periodic.find_runs(t.documents, alter=repeated_tail))


@query("op12_word_bpe")
def op12(t: Tables) -> DataFrame:
    return word_bpe.digests(word_bpe.encode(t.documents, WORDS))


@query("op13_alignment")
def op13(t: Tables) -> DataFrame:
    return alignment.align(t.documents, BYTES, PATTERN, PIECES)
