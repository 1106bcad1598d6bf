"""The training-data queries by name, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.llm import ann, bpe, codes, decontaminate, langid, manifest, quality, records, secrets, sharding, simhash, sketches, url_filter
from evidra.llm._common import table

#: Pages on hosts with one of these labels make up the list of URLs to block.
LISTED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")
BPE_FILE = "byte_bpe_50k.tiktoken"


def tokenizer_file(name):
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern():
    """How a text is cut into words before the merges of BPE_FILE."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file(BPE_FILE), bpe_pattern())


def op3_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark, sf_dir):
    """A source is an owner; its texts in one language are a repository."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"))


def op5_language(spark, sf_dir):
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    labels = F.split(url_filter.host_of(F.col("url")), "[.]")
    listed = pages.where(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS)))).select("url")
    return url_filter.filter_urls(pages, listed)


def op8_sharding(spark, sf_dir):
    return sharding.bounded_ring_shards(table(spark, sf_dir, "documents"))


def op9_permutation_index(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_token_records(spark, sf_dir):
    return records.write_and_read_back(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_sketches(spark, sf_dir):
    return sketches.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents"))


def queries():
    ops = (op1_decontamination, op2_byte_bpe, op3_quality, op4_secrets, op5_language, op6_simhash, op7_url_filter, op8_sharding, op9_permutation_index, op10_token_records, op11_sketches, op12_vector_codes, op13_manifest)
    return {f.__name__: f for f in ops}


_SUBDOMAIN = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')"
_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

#: op7 in DuckDB. Queries without SQL are models, hashes or tilings; tests compare them with brute force.
URL_FILTER_SQL = rf"""WITH h AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    c AS (SELECT *, regexp_replace(host, '^(?:www|m|blog)\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_replace(path, '(?:/index)?\.html?$', ''), '/+$', '') AS canonical_url,
        CASE {" ".join(f"WHEN {_SUBDOMAIN.format(h, p)} THEN '{h + p}'" for _, h, p in _RULES)} END AS rule FROM h),
    l AS (SELECT DISTINCT canonical_url FROM c WHERE canonical_url <> '' AND list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}])),
    r AS (SELECT *, canonical_url IN (SELECT canonical_url FROM l) AS listed FROM c)
    SELECT page_id, host, path, rule, canonical_url, listed,
      CASE {" ".join(f"WHEN rule = '{h + p}' THEN '{k}'" for k, h, p in _RULES)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r"""


_ROUND = """a{n} AS (SELECT vec_id, part, min_by(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
      SELECT vec_id, q.part, entry, sum((val - e) * (val - e)) AS d FROM q JOIN e{n} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
_MOVED = """e{m} AS (SELECT part, pos, entry, coalesce(new, e) AS e FROM e{n} LEFT JOIN (
      SELECT part, pos, entry, floor(sum(val) / count(*))::BIGINT AS new FROM q JOIN a{n} USING (vec_id, part) GROUP BY ALL) USING (part, pos, entry))"""
#: op12 in DuckDB.
VECTOR_CODES_SQL = f"""WITH v AS (SELECT vec_id, label, embedding AS x, len(embedding) AS dims FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    c AS (SELECT vec_id, label, dims, unnest(x) AS y, unnest(range(dims)) AS k FROM v),
    q AS (SELECT vec_id, label, k // (dims // 16) AS part, k % (dims // 16) AS pos, floor(256 * y::DOUBLE)::BIGINT AS val FROM c),
    s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
    e0 AS (SELECT part, pos, entry, val AS e FROM q JOIN s USING (vec_id)),
    {_ROUND.format(n=0)}, {_MOVED.format(n=0, m=1)}, {_ROUND.format(n=1)}, {_MOVED.format(n=1, m=2)}, {_ROUND.format(n=2)},
    b AS (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e2),
    r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), b"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# Levels of a forest: nodes j of tree t at level l, until each tree has one; w: how many the tree has there.
_GROWN = """{out} AS (SELECT t, j, 0 AS l, h, w FROM {nodes} UNION ALL
      SELECT t, j // 2, l + 1, sha256(string_agg(h, '' ORDER BY j)), (max(w) + 1) // 2 FROM {out} WHERE w > 1 GROUP BY t, j // 2, l)"""
# What stands beside a node's path on each level.
_BESIDE = """{out} AS (SELECT n.key, {base} + u.l AS l, n.j >> u.l AS j, s.h AS sib FROM {nodes} n, {tree} u LEFT JOIN {tree} s
      ON s.t IS NOT DISTINCT FROM u.t AND s.l = u.l AND s.j = xor(u.j, 1) WHERE u.t IS NOT DISTINCT FROM n.t AND u.j = n.j >> u.l AND u.w > 1)"""
#: op13 in DuckDB. zlib's CRC-32 is taken bit by bit, as DuckDB has none.
MANIFEST_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS changed, n_chars IS NOT NULL AS has FROM documents),
    bits AS (SELECT doc_id, 0 AS k, 4294967295::BIGINT AS crc FROM d WHERE doc_id IS NOT NULL UNION ALL
      SELECT doc_id, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (
        SELECT doc_id, k, xor(crc, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1)) ELSE 0 END) AS x FROM bits WHERE k < 8 * length(doc_id::VARCHAR))),
    bad AS (SELECT DISTINCT doc_id FROM bits WHERE k = 8 * length(doc_id::VARCHAR) AND xor(crc, 4294967295) % 7 = 0),
    p AS (SELECT doc_id AS key, lang AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS j, leaf AS h, count(*) OVER (PARTITION BY lang) AS w,
        CASE WHEN has AND doc_id IN (SELECT doc_id FROM bad) THEN changed ELSE leaf END AS shown FROM d),
    {_GROWN.format(out="g", nodes="p")},
    tops AS (SELECT t AS key, NULL AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS j, h, count(*) OVER () AS w FROM g WHERE w = 1),
    {_GROWN.format(out="top", nodes="tops")},
    {_BESIDE.format(out="low", base="0", nodes="p", tree="g")}, {_BESIDE.format(out="high", base="1000", nodes="tops", tree="top")},
    path AS (SELECT * FROM low UNION ALL SELECT p.key, high.l, high.j, high.sib FROM p JOIN high ON p.t IS NOT DISTINCT FROM high.key),
    steps AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l) AS step FROM path),
    fold AS (SELECT key, 0 AS step, shown AS h FROM p UNION ALL
      SELECT fold.key, fold.step + 1, sha256(CASE WHEN s.j % 2 = 1 THEN s.sib || h ELSE h || coalesce(s.sib, '') END) FROM fold JOIN steps s ON s.key = fold.key AND s.step = fold.step + 1),
    ends AS (SELECT key, max_by(h, step) AS folded_root FROM fold GROUP BY key),
    proofs AS (SELECT key, sha256(coalesce(string_agg(sib, '' ORDER BY l), '')) AS proof_sha256 FROM p LEFT JOIN path USING (key) GROUP BY key),
    r AS (SELECT h AS root FROM top WHERE w = 1)
    SELECT p.key AS doc_id, p.h AS leaf, tops.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM p JOIN tops ON p.t IS NOT DISTINCT FROM tops.key JOIN ends ON ends.key = p.key JOIN proofs ON proofs.key = p.key, r"""


def oracle_sql():
    return {"op7_url_filter": URL_FILTER_SQL, "op12_vector_codes": VECTOR_CODES_SQL, "op13_manifest": MANIFEST_SQL}
