"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import ann, audit, chat, lines, merkle, mixing, near, quality, sharding, url_filter, warc
from logloom.llm.common import materialise, table
from logloom.llm.packing import pack_documents
from logloom.llm.token_counts import count_tokens


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialise(mixing.with_sizes(docs, "doc_id", "text", "source").select("doc_id", "source", "size", "src", "h"))
    return mixing.mix_plan(sized, sized.count())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("VALUES " + ", ".join(str(r) for r in url_filter.RULES)).toDF("action", "host", "path")
    return url_filter.filter_pages(table(spark, sf_dir, "pages"), rules)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_removed", "removed_words", "removed", F.sha2("text", 256).alias("text_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"VALUES (-1L, 0L, 'user', '{say}'), (-1L, 1L, 'assistant', '{say}')").toDF(*told.columns)
    return chat.digests(chat.format_conversations(told.unionAll(probe)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality.BASE, "base_failed", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS which
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), w AS (
  SELECT *, CASE which WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM s
), r AS (
  SELECT *, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * (all_weight - weight_before) <= weight * (budget - cap_before) AS capped FROM r
), t AS (
  SELECT source, source_size, which, CASE WHEN capped THEN cap ELSE weight * left_budget / left_weight END AS target
  FROM (SELECT *, budget - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS left_budget,
               all_weight - coalesce(sum(weight) FILTER (capped) OVER (), 0) AS left_weight FROM c)
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.which,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE (middle < target)::INT + (middle + source_size < target)::INT END AS BIGINT) AS n,
         middle / target AS y
  FROM p
), y AS (
  SELECT *, y * CASE which WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS z FROM q
)
SELECT doc_id, size, source_size, target, n * size AS taken,
       CASE WHEN n = 0 THEN NULL
            WHEN which = 0 THEN z * 2 / (sqrt(36.0::DOUBLE + z * (-4.0)::DOUBLE) + 6.0::DOUBLE)
            WHEN which = 1 AND z <= 0.75 THEN z * 2 / (sqrt(1.0::DOUBLE + z * 4.0::DOUBLE) + 1.0::DOUBLE)
            WHEN which = 1 THEN 0.5 + (z - 0.75::DOUBLE) * 2 / (sqrt(4.0::DOUBLE + (z - 0.75::DOUBLE) * 4.0::DOUBLE) + 2.0::DOUBLE)
            ELSE z * 2 / (sqrt(1.0::DOUBLE) + 1.0::DOUBLE) END AS position
FROM y
"""

URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), f AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS under,
         string_agg('<|start|>' || {_escaped("role")} || '<|message|>' || {_escaped("text")} || '<|end|>', '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars, sha256(under) AS loss_sha256,
       CAST(length(formatted) AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM g
"""

WARC_SQL = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
         (strpos('0123456789abcdef', substr(h, i * 5 // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, i * 5 // 4 + 2, 1)) - 1
       ) >> (3 - i * 5 % 4)) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

#: Levels that the SQL goes up in a source (up to 3^12 rows of each) and above the sources.
MERKLE_LEVELS = 12, 6


def _merkle_sql() -> str:
    told = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    run = "PARTITION BY tree, k // 3 ORDER BY k ROWS BETWEEN"
    sides = f"coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b"
    with_n = "(SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({}))"
    crc = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i:
      list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)], list_transform(range(8), lambda j: -1))))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
    out = [f"""d AS (
  SELECT *, {told("text")} AS leaf, CASE WHEN text IS NOT NULL AND ({crc}) % 2 = 0 THEN {told("bare")} END AS other
  FROM (SELECT *, replace(text, chr(10), '') AS bare, coalesce('s' || source, '') AS tree FROM documents)
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)"""]  # fmt: skip

    def tree(name: str, base: str, levels: int) -> None:
        out.append(f"{name}0 AS (SELECT *, {sides} FROM {with_n.format(base)})")
        for i in range(levels):
            up = f"SELECT tree, k // 3 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM {name}{i} WHERE n > 1 GROUP BY tree, k // 3"
            out.append(f"{name}{i + 1} AS (SELECT *, {sides} FROM {with_n.format(up)})")
        out.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{i} WHERE n = 1" for i in range(levels + 1)) + ")")

    tree("l", "SELECT tree, place AS k, leaf AS d FROM p", MERKLE_LEVELS[0])
    tree("s", "SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS k, d FROM ltop", MERKLE_LEVELS[1])
    out.append("f0 AS (SELECT p.*, ltop.d AS subroot, (SELECT d FROM stop) AS root, dense_rank() OVER (ORDER BY p.tree) - 1 AS at, coalesce(other, leaf) AS h, '' AS sib FROM p JOIN ltop USING (tree))")
    for i in range(sum(MERKLE_LEVELS)):
        level = i - MERKLE_LEVELS[0]
        on = f"l{i} x ON x.tree = f.tree AND x.k = f.place // {3**i} AND x.n > 1" if level < 0 else f"s{level} x ON x.k = f.at // {3**level} AND x.n > 1"
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN x.n IS NULL THEN h ELSE sha256(x.a || h || x.b) END AS h, CASE WHEN x.n IS NULL THEN sib ELSE sib || x.a || x.b END AS sib) FROM f{i} f LEFT JOIN {on})")
    return "WITH " + ", ".join(out) + f" SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified FROM f{sum(MERKLE_LEVELS)}"


def _audit_sql() -> str:
    bit = {c: 1 << k for k, c in enumerate(audit.NAMES)}
    orders = ", ".join(f"('{''.join(o)}', {k + 1}, {sum(bit[c] for c in o[:k])}, {bit[o[k]]})" for o in permutations(audit.NAMES) for k in range(len(o)))
    total = lambda n, where: f"CAST(coalesce(sum({n}) FILTER ({where}), 0) AS BIGINT)"
    removed = "m & bit <> 0 AND m & before = 0"
    return f"""
    WITH d AS (
      SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w, length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY x) AS first
      FROM (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents)
    ), f AS (
      SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END) + (CASE WHEN 100 * capitals > 3 * length(x) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS m FROM d
    ), l AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
    ), c AS (
      SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
    ), o(filter_order, step, before, bit) AS (VALUES {orders})
    SELECT part, filter_order, CAST(step AS INT) AS step, {total("n", "m & (before | bit) = 0")} AS kept, {total("n", removed)} AS removed, {total("n", "m & bit <> 0 AND m & before <> 0")} AS redundant,
      {total("n", "m = bit")} AS unique_fails, {total("good", removed)} AS good_lost, {total("toxic", removed)} AS toxic_lost, {total("n * (120 // greatest(bit_count(m), 1))", "m & bit <> 0")} AS shapley
    FROM c CROSS JOIN o GROUP BY part, filter_order, step"""


ORACLES: dict[str, str] = {"op12_filter_audit": _audit_sql(), "op11_merkle_manifest": _merkle_sql(), "op8_warc": WARC_SQL, "op1_mix_sources": MIX_SQL, "op4_url_filter": URL_SQL, "op7_chat_format": CHAT_SQL}
