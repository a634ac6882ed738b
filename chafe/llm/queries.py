"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, decontaminate, language_id, line_dedup, prefix_trie, secret_scan,
               sentencepiece_unigram, simhash_dedup, token_files, topk_search, toxicity, url_filter)
from .common import scratch, table, text_key


def op1_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, d, "documents"))


# ---- fixed values: the rules that the contract names, and the spam host labels
# whose pages make up the block list of the query ----
URL_RULES = [
    url_filter.Rule("allow", "org"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
LISTED_LABELS = "(^|[.])(casino-win|free-bets|ads-track|cheap-pills|spam-farm)[.]"
# -------------------------------------------------------------------------------


def op2_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """The block list: canonical URLs of pages on hosts with a listed label."""
    pages = table(spark, d, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_LABELS)).select(url_filter.canonical(host, path).alias("url"))
    return url_filter.judge(pages, listed, URL_RULES)


def op3_topk_search(spark: SparkSession, d: str) -> DataFrame:
    return topk_search.search(table(spark, d, "embeddings"))


def op4_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, contaminated, item_ids, similarity) for every document, judged by its
    own text; an item without an id is a null in item_ids."""
    docs = table(spark, d, "documents")
    hits = decontaminate.contaminated_rows(docs, table(spark, d, "benchmark")) \
        .groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")) \
        .agg(F.collect_list(F.struct("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    same = own["doc_id"].eqNullSafe(F.col("__id")) & (own["key"] == F.col("__key"))
    return own.join(hits, same, "left") \
        .select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                F.coalesce(F.array_sort(F.col("items.item_id")), F.array().cast("array<long>")).alias("item_ids"),
                "similarity")


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    shards = token_files.write_shards(table(spark, d, "documents"), folder,
                                      public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_shards(shards, folder)


def op7_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_sha256, exact): ids of every whole text, and
    whether the text decoded from them equals it."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    e = sentencepiece_unigram
    out = e.decode(e.encode(table(spark, d, "documents").select("doc_id", "text"), model), model)
    # <0x00> to <0xFF> are ids 3 to 258 of this vocabulary
    return out.select("doc_id", F.size("__ids").cast("long").alias("n_ids"),
                      F.size(F.filter("__ids", lambda i: i.between(3, 258))).cast("long").alias("n_byte_ids"),
                      F.sha2(F.array_join(F.col("__ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      (F.col("__text") == F.coalesce("text", F.lit(""))).alias("exact"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Owner: the source.  Repository: a source's documents of one language."""
    return secret_scan.scan(table(spark, d, "documents"))


def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(table(spark, d, "documents"))


def op11_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, d, "conversations"))))


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"))


# ---- fixed values: the conversation that the contract adds ----
ADDED_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
# ---------------------------------------------------------------


def op13_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """Formats all conversations into files and reads the digests back from them."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_CONVERSATION, "conv_id long, turn long, role string, text string")
    folder = chat_format.format_conversations(rows.unionByName(added))
    return chat_format.read_digests(spark.read.schema(chat_format.PARTS).parquet(folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_topk_search": op3_topk_search,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_collocations": op12_collocations,
    "op13_chat_format": op13_chat_format,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op2_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, coalesce(""" + _LOWER.format("regexp_extract(r, '^([^/?#]*)', 1, 's')") + r""", '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM rest),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') ||
         regexp_replace(regexp_replace(path, '(/index)?[.]html?$', ''), '/+$', '') END AS url FROM parts),
listing AS (
  SELECT DISTINCT url FROM canon
  WHERE regexp_matches(host, '(^|[.])(casino-win|free-bets|ads-track|cheap-pills|spam-farm)[.]')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN url IN (SELECT url FROM listing WHERE url IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
       (rule IS NULL AND coalesce(url IN (SELECT url FROM listing WHERE url IS NOT NULL), false)) AS listed
FROM ruled
""",
    "op3_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.rid <> q.rid),
r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    # A-Z only: translate() leaves all other letters alone.  The line's ends
    # are stripped of ASCII white space (U+0020, U+0009 to U+000D).
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM documents),
keyed AS (
  SELECT doc_id, nth, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
rep AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, nth, line, (rep.k IS NOT NULL AND doc_id <> keeper) AS gone
  FROM keyed LEFT JOIN rep ON keyed.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    # positions: lengths of the gaps and matches in front, added up
    "op9_secret_scan": r"""
WITH pat(kind, k, re, g, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
  ('hex', 2, '[0-9a-f]+', 0, 16),
  ('owned', 3, '[A-Za-z0-9+/_-]+', 0, 20)),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
base_m AS (
  SELECT doc_id, owner, repo, kind, k, least, string_split_regex(t, re) AS gaps,
         regexp_extract_all(t, re, 0) AS w, CASE WHEN g = 2 THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re, 0) END AS v
  FROM d, pat),
long AS (
  SELECT doc_id, owner, repo, kind, k, least, unnest(gaps[1:len(w)]) AS gap, unnest(w) AS whole, unnest(v) AS val,
         generate_subscripts(w, 1) AS nth
  FROM base_m WHERE len(w) > 0 AND len(list_filter(v, lambda x: length(x) >= least)) > 0),
placed AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, k ORDER BY nth) AS e FROM long),
found AS (
  SELECT doc_id, owner, repo, kind, k, e - length(whole) AS s, e, val FROM placed WHERE length(val) >= least),
cand AS (
  SELECT * FROM found f WHERE k < 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM found b WHERE b.k < 3 AND b.doc_id = f.doc_id AND b.s < f.e AND b.e > f.s))),
own AS (SELECT val, count(DISTINCT owner) >= 2 OR count(DISTINCT (owner, repo)) >= 3 AS example FROM cand GROUP BY val),
judged AS (SELECT cand.*, example FROM cand JOIN own USING (val)),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
         count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (WHERE k < 3 OR NOT example) AS spans,
         count(*) FILTER (WHERE k < 3 AND NOT example) AS n_live, count(*) FILTER (WHERE k < 3 AND example) AS n_example
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (doc_id)
""",
    # crc32 of the decimal id, bit by bit; nodes are grouped by the list of their turns
    "op11_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], repeat([-1::BIGINT], 8))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
    4294967295) % 9 AS h FROM own),
conv AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
node AS (
  SELECT d AS depth, seq[1:d] AS path, count(*) AS n_convs, min(conv_id) AS conv_id,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM conv) GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children,
         CASE WHEN node.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node.path[-1].t) END AS saved
  FROM node LEFT JOIN kids ON node.depth = kids.depth AND node.path = kids.path),
-- a node belongs to the subtree of each of its own prefixes
up AS (
  SELECT k AS depth, path[1:k] AS path, sum(saved)::BIGINT AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, up.saved_tokens, f.ends_sha256
FROM full_ f JOIN up ON f.depth = up.depth AND f.path = up.path
LEFT JOIN node p ON p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1] AND f.depth > 0
""",
    # all phrases of up to four words are counted
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(""" + _LOWER.format("coalesce(text, '')")
    + r""", '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
cnt AS (
  SELECT lang, s, ws[i:i + s - 1] AS g, count(*) AS f
  FROM (SELECT lang, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) t(s))
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM cnt WHERE s = 1 GROUP BY lang),
cand AS (SELECT * FROM cnt WHERE s >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.s, c.f AS a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM cand) c
  JOIN cnt l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN cnt r ON r.lang = c.lang AND r.g = c.g[c.k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS most
  FROM (SELECT cand.*, m, unnest(range(1, s - m + 2)) AS i FROM cand, (VALUES (2), (3)) t(m) WHERE m < s) GROUP BY ALL),
left_ AS (
  SELECT best.* FROM best LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    # a turn is escaped by one character at each place that looks like a control string
    "op13_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text,
      '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE=|\[\\*/ROLE\]'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 5
      ELSE 16 + length(role) + 2 * len(regexp_extract_all(role, '[%<\[\]]')) END AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
