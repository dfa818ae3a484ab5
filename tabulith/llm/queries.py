"""The operators over their whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabulith.llm.bands import compression_bands
from tabulith.llm.interpolation import lm_scores
from tabulith.llm.licenses import license_labels
from tabulith.llm.merkle import manifest
from tabulith.llm.minhash import near_duplicates
from tabulith.llm.multi_index import near_duplicate_vectors
from tabulith.llm.packing import pack
from tabulith.llm.positions import decontaminate
from tabulith.llm.ranked import ranked_search
from tabulith.llm.registry import ORACLES, QUERIES, query
from tabulith.llm.repeats import suffix_dedup
from tabulith.llm.token_cache import count_tokens
from tabulith.llm.toxicity import toxicity
from tabulith.llm.warc import archive
from tabulith.llm.words import documents

__all__ = ["ORACLES", "QUERIES"]


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT start, b FROM reach JOIN both_ways ON node = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, d.doc_id = least_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT start, min(node) AS least_id FROM reach GROUP BY start) ON start = d.doc_id"""


@query("op1_near_duplicates", OP1_SQL)
def op1_near_duplicates(spark, folder):
    return near_duplicates(documents(spark, folder), shingle=2)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, folder):
    return suffix_dedup(documents(spark, folder))


@query("op3_compression_bands")
def op3_compression_bands(spark, folder):
    return compression_bands(documents(spark, folder))


@query("op4_deleted_interpolation")
def op4_deleted_interpolation(spark, folder):
    return lm_scores(documents(spark, folder))


@query("op5_digest_cache")
def op5_digest_cache(spark, folder):
    return count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


@query("op6_capture_index", OP6_SQL)
def op6_capture_index(spark, folder):
    return archive(documents(spark, folder, "pages")).records().drop("target")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM b, range(1, 10000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw USING (k, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op7_positional_decontamination", OP7_SQL)
def op7_positional_decontamination(spark, folder):
    return decontaminate(documents(spark, folder), documents(spark, folder, "benchmark"))


@query("op8_bounded_packing")
def op8_bounded_packing(spark, folder):
    return pack(documents(spark, folder).select("doc_id", F.col("text")), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_diagonal_licenses")
def op9_diagonal_licenses(spark, folder):
    return license_labels(documents(spark, folder))


@query("op10_nnpu_toxicity")
def op10_nnpu_toxicity(spark, folder):
    return toxicity(documents(spark, folder), documents(spark, folder, "labels"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS t
  FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (
  SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM b) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
i AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * p.n * c.n) // c.l))) AS impact FROM p JOIN f USING (t), c),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s QUALIFY rank <= 50"""


@query("op11_range_maximum_search", OP11_SQL)
def op11_range_maximum_search(spark, folder):
    return ranked_search(documents(spark, folder), documents(spark, folder, "benchmark"))


def _merkle_sql(levels: int = 6) -> str:
    """The tree, level by level: 16 ** levels leaves of a source, and as many sources."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR) END"
    fields = lambda text: " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text))
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),"
        " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
    )

    def up(name: str) -> str:
        return ",\n".join(
            f"{name}r{k} AS (SELECT tree, place // 16 AS run, any_value(n) AS n, list(digest ORDER BY place) AS l FROM {name}{k} GROUP BY tree, place // 16),\n"
            f"{name}{k + 1} AS (SELECT tree, run AS place, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS digest FROM {name}r{k})"
            for k in range(levels)
        )

    def along(name: str, path: str) -> str:
        before, after = "coalesce(array_to_string(l[1 : place % 16], ''), '')", "coalesce(array_to_string(l[place % 16 + 2 :], ''), '')"
        return ",\n".join(
            f"{path}{k + 1} AS (SELECT p.* EXCLUDE (place, proof, fold), place // 16 AS place, CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof,"
            f" CASE WHEN n > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold FROM {path}{k} p JOIN {name}r{k} r ON p.tree = r.tree AND p.place // 16 = r.run)"
            for k in range(levels)
        )

    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({fields("text")}) AS leaf,
         sha256({fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other,
         coalesce({crc} % 5 = 0, false) AS bad FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
a0 AS (SELECT tree, place, n, leaf AS digest FROM o),
{up("a")},
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest, tree AS source FROM a{levels}),
{up("b")},
p0 AS (SELECT doc_id, leaf, tree, place, '' AS proof, CASE WHEN bad THEN other ELSE leaf END AS fold FROM o),
{along("a", "p")},
q0 AS (SELECT doc_id, leaf, digest AS subroot, b0.tree, b0.place, proof, fold FROM p{levels} p JOIN b0 ON p.tree = b0.source),
{along("b", "q")}
SELECT doc_id, leaf, subroot, b{levels}.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{levels}.digest AS verified
FROM q{levels} JOIN b{levels} ON q{levels}.tree = b{levels}.tree"""


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark, folder):
    return manifest(documents(spark, folder))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT vec_id AS start, vec_id AS node FROM embeddings UNION SELECT start, b FROM reach JOIN both_ways ON node = a)
SELECT e.vec_id, (SELECT count(*) FROM both_ways WHERE a = e.vec_id) AS n_links, least_id AS component_id, e.vec_id = least_id AS kept
FROM embeddings e JOIN (SELECT start, min(node) AS least_id FROM reach GROUP BY start) ON start = e.vec_id"""


@query("op13_multi_index_vectors", OP13_SQL)
def op13_multi_index_vectors(spark, folder):
    return near_duplicate_vectors(documents(spark, folder, "embeddings"))
