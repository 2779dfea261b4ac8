"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.chat import crossed_pairs, format_pairs
from palimpsest.llm.decontaminate import contamination
from palimpsest.llm.divergence import source_divergence
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.licenses import oracle as license_oracle
from palimpsest.llm.licenses import scan_licenses
from palimpsest.llm.minhash_dedup import minhash_dedup
from palimpsest.llm.mixing import mix
from palimpsest.llm.ngram_join import near_duplicates
from palimpsest.llm.periodic_runs import periodic_runs
from palimpsest.llm.quality import quality_scores
from palimpsest.llm.sharding import shard_documents
from palimpsest.llm.token_output import token_round_trip
from palimpsest.llm.warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a chosen one, against itself going on as its partner does (``crossed_pairs``). Cases: ``format_preferences``, ``crossed_pairs``."""
    return format_pairs(crossed_pairs(table(spark, sf_dir, "conversations")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document from trees trained on the labels outside the held-out fold. Cases: ``quality_scores``, ``train``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document. Cases: ``scan_licenses``."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law ``bytes``. Cases: ``shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Cases: ``mix``."""
    return mix(table(spark, sf_dir, "documents")).drop("repeats")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover. Cases: ``contamination``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document. Cases: ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document at three words and a similarity of 0.9. Cases: ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, num=90, den=100)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of token ids hold of every document. Cases: ``write_ids``, ``token_round_trip``."""
    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page. Cases: ``write_warc``, ``warc_round_trip``."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from those of the other sources and of its language. Cases: ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, of which one in ten is made periodic first. Cases: ``periodic_runs``."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document at five words and a similarity of 0.85. Cases: ``minhash_dedup``."""
    return minhash_dedup(table(spark, sf_dir, "documents"), n_words=5, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_output": op9_token_output,
    "op10_warc": op10_warc,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS a FROM t GROUP BY conv_id),
k AS (SELECT *, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % (len(a) + 1) AS keep FROM o),
l AS (SELECT k.conv_id, k.a, list_concat(k.a[1:keep], coalesce(p.a, [])[keep + 1:]) AS b FROM k LEFT JOIN o p ON p.conv_id = xor(k.conv_id, 1)),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM l)
SELECT conv_id AS pair_id, n AS n_common,
       coalesce(array_to_string(list_transform(a[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
       coalesce(array_to_string(list_transform(a[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') AS chosen,
       coalesce(array_to_string(list_transform(b[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') AS rejected,
       coalesce(array_to_string(list_transform(a[n + 1:], lambda x: (length(x.role) + 13)::VARCHAR || ':0,' || (length(x.text) + 11)::VARCHAR || ':' || CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END), ','), '') AS chosen_mask,
       coalesce(array_to_string(list_transform(b[n + 1:], lambda x: (length(x.role) + 13)::VARCHAR || ':0,' || (length(x.text) + 11)::VARCHAR || ':' || CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END), ','), '') AS rejected_mask
FROM n
""",
    "op3_license_scan": license_oracle(),
    "op5_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
total AS (SELECT 3 * sum(source_size)::BIGINT AS num FROM s),
-- a source is full if its fair level 2 * size / w is under the final level; full ones come first in that order
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wopen FROM o),
f AS (SELECT c.*, num - 4 * before AS lft, w * (num - 4 * before) > 4 * source_size * wopen AS is_full FROM c, total),
lvl AS (SELECT lft, wopen FROM f WHERE NOT is_full ORDER BY k LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN is_full THEN (2 * f.source_size)::DOUBLE ELSE (w * lvl.lft)::DOUBLE / (2 * lvl.wopen)::DOUBLE END AS target,
         CASE WHEN is_full THEN 2 * f.source_size ELSE (w * lvl.lft) // (2 * lvl.wopen) END AS goal
  FROM f LEFT JOIN lvl ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM t),
cum AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(size) OVER (PARTITION BY source, h) AS here FROM d),
-- the boundary hash is in if that is nearer to the target
e AS (SELECT cum.*, source_size, target, whole, goal - whole * source_size AS rest FROM cum JOIN r ON cum.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - here < rest AND upto - rest < rest - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pat),
occ AS (
  SELECT row_no, i, x.k, pat.item_id
  FROM (SELECT row_no, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
        FROM (SELECT row_no, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)) x
  JOIN pat ON pat.k = x.k AND pat.p = x.p),
hit AS (SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(i, i + k)) AS pos FROM occ) GROUP BY row_no),
its AS (SELECT row_no, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS id FROM occ) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (row_no) LEFT JOIN its USING (row_no)
""",
    "op7_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_ AS (SELECT a.r AS ra, b.r AS rb, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS (
  SELECT ra, rb FROM both_ JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT ra, rb FROM link UNION SELECT rb, ra FROM link),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.rb FROM reach JOIN e ON reach.b = e.ra),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN w ON reach.b = w.r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM w JOIN c ON c.a = w.r LEFT JOIN n ON n.r = w.r
""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM q
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM o GROUP BY lang, term HAVING count(*) >= 30),
s AS (SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*)::HUGEINT AS terms FROM v GROUP BY lang),
c AS (SELECT o.lang, source, term, sum(n)::HUGEINT AS n FROM o SEMI JOIN v ON v.lang = o.lang AND v.term = o.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
x AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.terms) AS p,
         1 + (1000000000::HUGEINT * (v.lang_n + 5)) // (s.lang_total + 5 * s.terms) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_ AS (SELECT a.r AS ra, b.r AS rb, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS (
  SELECT ra, rb FROM both_ JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT ra, rb FROM link UNION SELECT rb, ra FROM link),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.rb FROM reach JOIN e ON reach.b = e.ra),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN w ON reach.b = w.r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN c ON c.a = w.r LEFT JOIN n ON n.r = w.r
""",
}
