"""Queries over the training-data operators, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, media, nearcopies, neighbours, packing, phrases, pii, quality, substrings, toxicity, trie, urls, warc


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op2_nearcopies(spark, sf_dir):
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


def op3_media(spark, sf_dir):
    found = media.features(media.media_table(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", "n_frames", "n_peaks", "n_pairs", "pairs_sha256").alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.sha2("media", 256).alias("media_sha256"), feature, "times", "codes")


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), spans.alias("offending_spans"))


def op5_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


RULES = [
    urls.Rule("block", "com/en/"),
    urls.Rule("allow", "example.com/en/7"),
    urls.Rule("block", "net/de/"),
    urls.Rule("allow", "example.net/de/8"),
    urls.Rule("block", "org/es/"),
]


def op6_urls(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rh, rp, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')
), hits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""


def op7_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


def op8_warc(spark, sf_dir):
    at = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, at, keep_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A group of five hex digits gives four characters of base32.
OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS bigint) >> cast(15 - 5 * (k % 4) AS int)) & 31)::int, 1)), '') AS digest FROM p
)
SELECT page_id, cast(strlen(html) AS bigint) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM b
"""


def op9_substrings(spark, sf_dir):
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), keep_text=False)


_NEXT = ", ".join(f"lead(word, {k}) OVER p" for k in range(1, 13))
OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), grams AS (
  SELECT doc_id, i, concat_ws(' ', word, {_NEXT}) AS g, lead(word, 12) OVER p IS NOT NULL AS whole FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), firsts AS (
  SELECT g, min(doc_id) AS d FROM grams WHERE whole GROUP BY g
), hits AS (
  SELECT doc_id, i FROM grams JOIN firsts USING (g) WHERE whole AND d < doc_id
), flagged AS (
  SELECT doc_id, i, word, max(CASE WHEN hits.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN hits USING (doc_id, i)
)
SELECT doc_id, count(word) AS n_words, cast(coalesce(sum(gone), 0) AS bigint) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN flagged USING (doc_id) GROUP BY doc_id
"""


def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op11_trie(spark, sf_dir):
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


#: h of a conversation: crc32 of its decimal id, a byte and eight shifts at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ord(c)::bigint + 256, 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i < h
  UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h
), s AS (
  SELECT conv_id, text, list({{'role': role, 'text': text}}) OVER p AS k, row_number() OVER p AS d FROM r WINDOW p AS (PARTITION BY conv_id ORDER BY part, i)
), m AS (
  SELECT conv_id, d, k::varchar || length(k) AS k, text FROM s UNION ALL SELECT conv_id, 0, '', '' FROM c
), member AS (
  SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, k) AS node, d = max(d) OVER (PARTITION BY conv_id) AS last FROM m
), node AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM member GROUP BY node, d
), up AS (
  SELECT node.node, node.d, p.node AS parent FROM node LEFT JOIN member p ON p.conv_id = node.node AND p.d = node.d - 1
), kids AS (
  SELECT parent AS node, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT a.node, a.d, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM node LEFT JOIN kids ON kids.node = node.node AND kids.d = node.d JOIN member a ON a.conv_id = node.node AND a.d <= node.d GROUP BY a.node, a.d
)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, cast(leaves AS bigint) AS n_leaves, cast(sums.saved AS bigint) AS saved_tokens, ends_sha256
FROM node JOIN up USING (node, d) JOIN sums USING (node, d) LEFT JOIN kids USING (node, d)
"""


def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, string_split(trim(piece), ' ') AS w
  FROM (SELECT lang, regexp_replace(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[ \t]+', ' ', 'g') AS piece FROM documents)
  WHERE trim(piece) <> ''
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p)
), f AS (
  SELECT lang, k, phrase, count(*) AS f, any_value(lang || chr(10) || phrase) AS id FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, cast(sum(f) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS cut, lang || chr(10) || w[1] AS x, lang || chr(10) || array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, lang || chr(10) || w[1] || ' ' || w[2], lang || chr(10) || w[3] FROM c WHERE k = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, fx.f AS l, fy.f AS r, cast((1000000::hugeint * a * a) // (fx.f::hugeint * fy.f) AS bigint) AS score
  FROM cuts JOIN f fx ON fx.id = x JOIN f fy ON fy.id = y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS top FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE top IS NULL OR 100 * top < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op13_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    spans = pii.spans_text(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *map(count, range(4)), "base_sha256", spans.alias("spans"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op6_urls": OP6_SQL, "op8_warc": OP8_SQL, "op9_substrings": OP9_SQL, "op11_trie": OP11_SQL, "op12_phrases": OP12_SQL}
