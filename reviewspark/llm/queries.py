"""The queries opN_<name> over the test tables: each applies its operator to the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, fingerprint, html_main, manifest, minhash, mixing, neighbours, phrases, quality, repair, suffix_dedup, vectors
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op2_repair_shards")
def repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-shards")
    path = public_tokenizers.path(TOKENIZER)
    repair.write_shards(read_table(spark, sf_dir, "documents"), out, repair.library_encode(path), end_id=2)
    return repair.read_documents(spark, out)


@query("op3_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op8_entropy_mix")
def entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


_ESCAPED = """regexp_replace(regexp_replace(regexp_replace({x}, '(<)(~*)(\\|)', '\\1\\2~\\3', 'g'),
    '(<)(~*)(/?s>)', '\\1\\2~\\3', 'g'), '(\\[)(~*)(/?INST\\])', '\\1\\2~\\3', 'g')"""


@query(
    "op9_chat_parts",
    f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="body")}) + length('<|turn|><|text|><|end|>') AS n FROM m
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS turns,
    coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM g
""",
)
def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), both, F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.format_conversations(messages))


@query("op1_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(read_table(spark, sf_dir, "documents"))


@query(
    "op10_bottom_k_near_duplicates",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
hits AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM hits UNION ALL SELECT b, a FROM hits),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN g USING (doc_id)
""",
)
def bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, threshold=0.8)


@query(
    "op5_projection_passes",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN g USING (vec_id) LEFT JOIN n USING (vec_id)
""",
)
def projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op4_naive_bayes_support_vectors")
def naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3)


@query("op6_induced_suffix_dedup")
def induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), length=400)


@query("op7_chain_field_main_text")
def chain_field_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, sf_dir, "pages"))


_SHIFT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"  # the reversed CRC-32 polynomial


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text in SQL that has no such function: a table of 256 entries, made by shifting eight times."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: {_SHIFT})"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = f"xor(c >> 8, ({table})[CAST(xor(c & 255, b) AS BIGINT) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


_FIELD = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(x=x) for x in ("doc_id", "source", "lang", "n_chars"))


@query(
    "op11_concatenated_levels",
    f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format(x="text")}) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format(x="replace(text, chr(10), '')")})
    END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents
), t AS (
  SELECT source, 0 AS level, pos, leaf AS node, n FROM d
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1
  GROUP BY source, level, pos // 3, n
), s AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM s
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3, n
), up AS (
  SELECT a.source, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.source, a.level, a.pos
), over_s AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM u a JOIN u b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.pos
), paths AS (
  SELECT d.doc_id, up.level, up.l, up.r FROM d JOIN up ON d.source IS NOT DISTINCT FROM up.source AND up.pos = d.pos // CAST(pow(3, up.level) AS BIGINT)
  UNION ALL
  SELECT d.doc_id, 1000 + o.level, o.l, o.r FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
  JOIN over_s o ON o.pos = s.pos // CAST(pow(3, o.level) AS BIGINT)
), p AS (
  SELECT doc_id, list({{'l': l, 'r': r}} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS siblings FROM paths GROUP BY doc_id
), folding AS (
  SELECT d.doc_id, 1 AS step, coalesce(changed, leaf) AS node, path FROM d LEFT JOIN p USING (doc_id)
  UNION ALL
  SELECT doc_id, step + 1, sha256(path[step].l || node || path[step].r), path FROM folding WHERE step <= len(path)
), f AS (SELECT doc_id, arg_max(node, step) AS folded_root FROM folding GROUP BY doc_id)
SELECT d.doc_id, d.leaf, s.subroot, u.node AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = u.node AS verified
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN u ON u.n = 1 JOIN f USING (doc_id) LEFT JOIN p USING (doc_id)
""",
)
def concatenated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    docs = read_table(spark, sf_dir, "documents")
    return manifest.manifest(docs, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, tampered_where=even)


@query(
    "op12_dynamic_itemset_phrases",
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS words FROM pieces
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM f WHERE m > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, l.f AS l, r.f AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.k + 1:c.m], ' ') JOIN t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.m > b.m AND 100 * q.f >= 100 * b.a
    AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
)
def dynamic_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"), threshold=100, longest=5, most=2000)


@query("op13_cross_polytope_neighbours")
def cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0, k=10)
