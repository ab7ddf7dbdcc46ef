"""Registered queries of the corpus operators, one per operator, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import Vocabulary as ByteVocabulary, bpe_decode, bpe_encode, token_digests
from .common import documents, table
from .embeddings import embedding_dedup
from .exact_dedup import exact_dedup
from .katz import katz_scores
from .license_scan import NOTICES, PHRASES, license_scan
from .merkle import every_seventh, merkle_manifest, verify
from .mixing import domain_of, mix
from .pieces import Vocabulary, sentencepiece
from .prefix_trie import prefix_trie
from .quality import quality_scores, train
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

@query
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


@query
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))


# Mixing: target weights of the production run.
MIX_WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "code": 1}, "lang": {"en": 4, "de": 2}, "source": {}}
MIX_PART, MIX_EPOCHS, MIX_SEED = (3, 5), 2, 7


@query
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    levels = [domain_of(F.coalesce("source", F.lit(""))), F.col("lang"), F.col("source")]
    return mix(docs, levels, MIX_WEIGHTS, MIX_PART, MIX_EPOCHS, MIX_SEED)


def _weight_sql(level: str) -> str:
    cases = "".join(f" WHEN {level} = '{v}' THEN {w}" for v, w in MIX_WEIGHTS[level].items())
    return f"CASE{cases} ELSE 1 END" if cases else "1"


def _deal_sql(path: list[str], out: str, given: str) -> str:
    """The steps of one level of the tree: nodes with budget in, nodes with share out."""
    name, parent = path[-1], path[:-1]
    keys, home = ", ".join(path), f"PARTITION BY {', '.join(parent)} " if parent else ""
    return f"""
{out}_n AS (SELECT {keys}, CAST(sum(cap) AS HUGEINT) AS cap, CAST(max({_weight_sql(name)}) AS HUGEINT) AS weight FROM leaf GROUP BY {keys}),
{out}_g AS (SELECT n.*, CAST(g.budget AS HUGEINT) AS budget FROM {out}_n n JOIN {given} g {f"USING ({', '.join(parent)})" if parent else "ON true"}),
{out}_a AS (SELECT *, coalesce(sum(cap) OVER ({home}ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER ({home}ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM {out}_g),
{out}_b AS (SELECT *, cap * behind <= (budget - before) * weight AS filled FROM {out}_a),
{out}_c AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({home}) AS rest_of, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({home}) AS open_w FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN filled THEN cap ELSE CAST(rest_of AS HUGEINT) * weight // CAST(open_w AS HUGEINT) END AS part FROM {out}_c),
{out}_e AS (SELECT *, budget - sum(part) OVER ({home}) AS spare, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER ({home}ORDER BY {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place_no FROM {out}_d),
{out} AS (SELECT {keys}, part + CASE WHEN NOT filled AND place_no <= spare THEN 1 ELSE 0 END AS budget FROM {out}_e)"""


ORACLES["op4_mix"] = f"""WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-3]$') THEN 'web' WHEN regexp_matches(coalesce(source, ''), '[4-6]$') THEN 'books'
    WHEN regexp_matches(coalesce(source, ''), '[78]$') THEN 'news' WHEN regexp_matches(coalesce(source, ''), '9$') THEN 'code' ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {MIX_EPOCHS} AS HUGEINT) AS cap FROM docs GROUP BY 1, 2, 3),
top AS (SELECT least(sum(tokens) * {MIX_PART[0]} // {MIX_PART[1]}, sum(tokens) * {MIX_EPOCHS}) AS budget FROM leaf),
{_deal_sql(["domain"], "l1", "top")},
{_deal_sql(["domain", "lang"], "l2", "l1")},
{_deal_sql(["domain", "lang", "source"], "l3", "l2")},
plan AS (SELECT domain, lang, source, CAST(budget // greatest(tokens, 1) AS BIGINT) AS epochs, CAST(budget % greatest(tokens, 1) AS BIGINT) AS prefix FROM leaf JOIN l3 USING (domain, lang, source)),
placed AS (SELECT docs.*, epochs, prefix, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat('{MIX_SEED}:', CAST(epochs AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs, greatest(0, least(n_tokens, prefix - (upto - n_tokens))) AS prefix_tokens,
  epochs * n_tokens + greatest(0, least(n_tokens, prefix - (upto - n_tokens))) AS taken_tokens FROM placed"""


@query
def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embeddings"] = """WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _template_rows() -> str:
    rows, number = [], 0
    for exact, group in ((True, PHRASES), (False, NOTICES)):
        for label, texts in group.items():
            for text in texts:
                words = text.split()
                rows += [f"({number}, '{label}', {exact}, {len(words)}, {t}, '{words[t]}', '{words[t + 1]}')" for t in range(len(words) - 1)]
                number += 1
    return ", ".join(rows)


ORACLES["op7_license_scan"] = f"""WITH tpl(template, label, exact, size, t, t_first, t_second) AS (VALUES {_template_rows()}),
docs AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
pairs AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS p, w FROM docs),
votes AS (SELECT doc_id, template, label, exact, size, p, t, p - t AS diagonal FROM pairs JOIN tpl ON w[p + 1] = t_first AND w[p + 2] = t_second),
lines AS (SELECT doc_id, template, label, exact, size, diagonal, bit_or(1::BIGINT << t) AS votes, min(p) AS low, max(p) + 1 AS high FROM votes GROUP BY doc_id, template, label, exact, size, diagonal),
gaps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 2 AND low - lag(high) OVER w <= size THEN 0 ELSE 1 END AS opens
  FROM lines WHERE NOT exact WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal, low)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal, low ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
merged AS (SELECT doc_id, template, label, size, run, least(1.0::DOUBLE, bit_count(bit_or(votes)) / (size - 1)::DOUBLE) AS cover, min(low) AS first_word, max(high) AS last_word FROM runs GROUP BY doc_id, template, label, size, run),
found AS (SELECT doc_id, label, true AS exact, low AS first_word, 1.0::DOUBLE AS cover FROM lines WHERE exact AND bit_count(votes) = size - 1
  UNION ALL SELECT doc_id, label, false, first_word, cover FROM merged WHERE cover >= 0.75 AND last_word - first_word + 1 <= size * 1.5),
figures AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first_word) FILTER (exact) AS first_word, max(first_word) FILTER (exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN figures USING (doc_id)"""


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLES["op8_exact_dedup"] = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {LOWER_SQL} AS norm FROM documents)"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, body, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS digest,
  max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM named"""


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece(documents(spark, sf_dir), Vocabulary.load())



@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(merkle_manifest(documents(spark, sf_dir), tampered=every_seventh()))


def _leaf_sql(chars: str) -> str:
    values = ["doc_id", "source", "lang", chars, "text"]
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR), ':', CAST({v} AS VARCHAR)) END" for v in values]
    return f"sha256(concat({', '.join(parts)}))"


def crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text: a byte is mixed in, then eight times a bit is shifted out."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, CAST(i AS BIGINT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {bit} END), 4294967295::BIGINT)"


ORACLES["op11_merkle"] = f"""WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid
  FROM (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS raised, {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents)),
low(lang, level, idx, h, n) AS (SELECT lang, 0, idx, leaf, n FROM leaf
  UNION ALL SELECT lang, any_value(level) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, idx // 2),
sub AS MATERIALIZED (SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
top(level, idx, h, n) AS (SELECT 0, idx, h, n FROM sub
  UNION ALL SELECT any_value(level) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY idx // 2),
path AS MATERIALIZED (
  SELECT l.rid, w.level AS step, s.h AS sibling, (l.idx >> w.level) % 2 = 1 AS in_front FROM leaf l
    JOIN (SELECT DISTINCT lang, level FROM low WHERE n > 1) w ON w.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = w.level AND s.idx = xor(l.idx >> w.level, 1)
  UNION ALL
  SELECT l.rid, u.height + w.level, s.h, (u.idx >> w.level) % 2 = 1 FROM leaf l JOIN sub u ON u.lang IS NOT DISTINCT FROM l.lang
    CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) w LEFT JOIN top s ON s.level = w.level AND s.idx = xor(u.idx >> w.level, 1)),
folded(rid, step, h) AS (SELECT rid, 0, CASE WHEN hit THEN coalesce(raised, leaf) ELSE leaf END FROM leaf
  UNION ALL SELECT f.rid, f.step + 1, sha256(CASE WHEN in_front THEN concat(sibling, h) ELSE concat(h, sibling) END) FROM folded f JOIN path p ON p.rid = f.rid AND p.step = f.step),
proof AS (SELECT rid, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY rid),
final AS (SELECT rid, arg_max(h, step) AS folded_root FROM folded GROUP BY rid)
SELECT doc_id, leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaf l JOIN sub u ON u.lang IS NOT DISTINCT FROM l.lang JOIN final f ON f.rid = l.rid LEFT JOIN proof p ON p.rid = l.rid"""


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = ByteVocabulary.load(spark.conf.get("boxloom.llm.byte_vocabulary", None))
    return token_digests(bpe_decode(bpe_encode(documents(spark, sf_dir), vocabulary), vocabulary))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = f"""WITH turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, max(pos) AS n, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM turns GROUP BY conv_id),
built AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
named AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
  string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM built),
member AS MATERIALIZED (SELECT conv_id, CAST(d AS BIGINT) AS d, words, key, substr(key, 1, length(key) - 64) AS parent FROM named UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
node AS MATERIALIZED (SELECT key, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM member GROUP BY key, d),
kids AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
below AS (SELECT a.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM node n JOIN member a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids k ON k.parent = n.key GROUP BY a.key),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(key, d) AS key FROM member GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM node n LEFT JOIN node p ON p.key = n.parent LEFT JOIN kids k ON k.parent = n.key JOIN below b ON b.key = n.key LEFT JOIN ends e ON e.key = n.key"""
