"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Building blocks are CTE strings composed per query; every computed column is
aliased to the Spark name and doubles are rounded to the same digits."""

from __future__ import annotations

from ..functions.lexicon import CATEGORY_KEYWORDS, NEGATIVE_WORDS, POSITIVE_WORDS
from ..functions.text import BOT_PATTERNS, WHITESPACE_RUN

D = 6


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _inlist(ws) -> str:
    return "(" + ", ".join(_q(w) for w in ws) + ")"


def clean(expr: str) -> str:
    e = f"regexp_replace({expr}, '```[\\s\\S]*?```', '[CODE_BLOCK]', 'g')"
    e = f"regexp_replace({e}, '`[^`]+`', '[CODE]', 'g')"
    e = f"regexp_replace({e}, {_q(WHITESPACE_RUN)}, ' ', 'g')"
    return f"coalesce(trim({e}), '')"


def tokens(expr: str) -> str:
    return f"regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+')"


def hits(tok: str, words) -> str:
    return f"len(list_filter({tok}, lambda w: w IN {_inlist(words)}))"


def keyword_category(expr: str) -> str:
    low = f"lower({expr})"
    scores = []
    for kws in CATEGORY_KEYWORDS.values():
        scores.append("(" + " + ".join(f"CAST(contains({low}, {_q(k)}) AS INTEGER)" for k in kws) + ")")
    arr = "[" + ", ".join(scores) + "]"
    names = "[" + ", ".join(_q(k) for k in CATEGORY_KEYWORDS) + "]"
    return (f"CASE WHEN list_max({arr}) > 0 THEN {names}[list_position({arr}, list_max({arr}))] "
            f"ELSE 'Other' END")


def scored(src: str, text: str = "clean_body") -> str:
    """Adds g, h, friction_score, sentiment_label, is_negative, friction_category."""
    tok = tokens(text)
    return f"""(SELECT *, g / (g + h + 1.0) AS friction_score,
       CASE WHEN g >= 1 AND g >= h THEN 'negative' WHEN h <= 1 THEN 'neutral' ELSE 'positive' END
         AS sentiment_label,
       (g >= 1 AND g >= h) AS is_negative,
       CASE WHEN g >= 1 AND g >= h THEN {keyword_category(text)} ELSE 'N/A' END AS friction_category
  FROM (SELECT *, CAST({hits(tok, NEGATIVE_WORDS)} AS DOUBLE) AS g,
               CAST({hits(tok, POSITIVE_WORDS)} AS DOUBLE) AS h FROM {src}))"""


CLEAN_DOCS = f"""clean_docs AS (
  SELECT doc_id, lang, source, {clean('text')} AS clean_body FROM documents
  WHERE length({clean('text')}) > 10)"""
SCORED_DOCS = CLEAN_DOCS + f""",
scored_docs AS (SELECT * FROM {scored('clean_docs')})"""

BOT_RE = "|".join(BOT_PATTERNS)
API = "https://api.github.com/repos/"


def owner_repo(k: str) -> str:
    return f"('org' || CAST(({k}) % 53 AS VARCHAR) || '/repo' || CAST(({k}) % 11 AS VARCHAR))"


def url_repo(u: str) -> str:
    p = f"string_split({u}, '/')"
    return (f"CASE WHEN len({p}) >= 7 AND list_contains({p}, 'repos') "
            f"THEN {p}[-4] || '/' || {p}[-3] END")


def url_number(u: str) -> str:
    p = f"string_split({u}, '/')"
    return (f"CASE WHEN len({p}) >= 7 AND list_contains({p}, 'repos') "
            f"THEN TRY_CAST(trim({p}[-1]) AS BIGINT) END")


def repo_path(u: str) -> str:
    p = f"string_split({u}, '/')"
    return (f"CASE WHEN len({p}) >= 5 AND list_contains({p}, 'repos') "
            f"THEN {p}[-2] || '/' || {p}[-1] END")


ITEMS = f"""closed AS (SELECT l_orderkey AS id, max(l_shipdate) AS closed_at FROM lineitem GROUP BY 1),
prs0 AS (
  SELECT o.o_orderkey AS id, o.o_orderkey AS number, o.o_orderpriority AS agent,
         CASE o.o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'merged'
              ELSE lower(o.o_orderstatus) END AS state,
         o.o_orderdate AS created_at, '{API}' || {owner_repo('o.o_orderkey')} AS repo_url,
         c.closed_at
  FROM orders o LEFT JOIN closed c ON c.id = o.o_orderkey),
prs1 AS (
  SELECT *, CASE WHEN state = 'merged' THEN closed_at END AS merged_at,
         (epoch_us(closed_at) - epoch_us(created_at)) / 1000000.0 AS pr_duration_seconds
  FROM prs0),
tt AS (SELECT o_orderkey AS id, lower(c_mktsegment) AS type FROM orders JOIN customer ON o_custkey = c_custkey),
prs AS (
  SELECT p.*, coalesce(tt.type, 'unknown') AS pr_type, {repo_path('p.repo_url')} AS repo_path
  FROM prs1 p LEFT JOIN tt ON tt.id = p.id
  WHERE p.pr_duration_seconds IS NULL OR p.pr_duration_seconds >= 60),
comments AS (
  SELECT l.l_orderkey * 16 + l.l_linenumber AS item_id, d.text AS body,
         CASE WHEN l.l_suppkey % 10 = 0 THEN 'ci-runner-' || CAST(l.l_suppkey AS VARCHAR) || '[bot]'
              ELSE 'dev' || CAST(l.l_suppkey AS VARCHAR) END AS "user",
         CASE WHEN l.l_suppkey % 9 = 0 THEN 'Bot' ELSE 'User' END AS user_type,
         '{API}' || {owner_repo('l.l_orderkey')} || '/pulls/' || CAST(l.l_orderkey AS VARCHAR)
           AS pull_request_url,
         l.l_shipdate AS item_created_at
  FROM lineitem l LEFT JOIN documents d ON l.l_partkey % (SELECT count(*) FROM documents) = d.doc_id),
reviews AS (
  SELECT conv_id * 1000 + turn AS item_id, conv_id AS pr_id,
         CASE WHEN role = 'assistant' THEN 'copilot' WHEN role = 'system' THEN 'system'
              ELSE 'reviewer' || CAST(conv_id AS VARCHAR) END AS "user",
         CASE WHEN role = 'system' THEN 'Bot' ELSE 'User' END AS user_type, text AS body
  FROM conversations),
mc AS (
  SELECT p.id AS id_pr, c.item_id, 'comment' AS source, {clean('c.body')} AS clean_body,
         coalesce(p.agent, 'Unknown_AI') AS agent, p.pr_type, p.created_at, p.closed_at,
         p.merged_at, p.state, c.item_created_at
  FROM comments c JOIN prs p
    ON {url_repo('c.pull_request_url')} = p.repo_path AND {url_number('c.pull_request_url')} = p.number
  WHERE NOT coalesce(regexp_matches(lower(c."user"), {_q(BOT_RE)}), false)),
mr AS (
  SELECT p.id AS id_pr, r.item_id, 'review' AS source, {clean('r.body')} AS clean_body,
         coalesce(p.agent, 'Unknown_AI') AS agent, p.pr_type, p.created_at, p.closed_at,
         p.merged_at, p.state, CAST(NULL AS TIMESTAMP) AS item_created_at
  FROM reviews r JOIN prs p ON r.pr_id = p.id
  WHERE NOT (coalesce(regexp_matches(lower(r."user"), {_q(BOT_RE)}), false)
             OR coalesce(r.user_type = 'Bot', false))),
items AS (
  SELECT * FROM mc WHERE length(clean_body) > 10
  UNION ALL
  SELECT * FROM mr WHERE length(clean_body) > 10)"""
SCORED_ITEMS = ITEMS + f""",
scored_items AS (SELECT * FROM {scored('items')})"""


ORACLE: dict[str, str] = {}

ORACLE["friction_by_group"] = f"""WITH {SCORED_DOCS}
SELECT source, round(avg(friction_score), {D}) AS mean, count(friction_score) AS "count",
       round(stddev_samp(friction_score), {D}) AS std
FROM scored_docs GROUP BY source"""

ORACLE["friction_by_agent"] = f"""WITH {SCORED_ITEMS}
SELECT agent, round(avg(friction_score), {D}) AS mean, count(friction_score) AS "count",
       round(stddev_samp(friction_score), {D}) AS std
FROM scored_items GROUP BY agent"""

ORACLE["clean_text_len"] = f"""WITH {CLEAN_DOCS},
conv AS (SELECT conv_id * 1000 + turn AS doc_id, role AS source, {clean('text')} AS clean_body
         FROM conversations)
SELECT doc_id, source, length(clean_body) AS clean_len, md5(clean_body) AS clean_md5
FROM (SELECT doc_id, source, clean_body FROM clean_docs
      UNION ALL SELECT * FROM conv WHERE length(clean_body) > 10)"""


def _avg_rank(v: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pv = f"PARTITION BY {part + ', ' if part else ''}{v}"
    return f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER ({pv}) - 1) / 2.0)"


def kruskal_sql(src: str, g: str, v: str, name: str) -> str:
    return f"""r AS (SELECT {g} AS g, {v} AS v, {_avg_rank(v)} AS rk FROM {src}
           WHERE {v} IS NOT NULL AND {g} IS NOT NULL),
grp AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS R FROM r GROUP BY g),
ties AS (SELECT sum(c * c * c - c) AS T FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)),
tot AS (SELECT sum(n) AS N, count(*) AS k, min(n) AS mn, sum(R * R / n) AS s FROM grp)
SELECT '{name}' AS test, CAST(N AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS dof,
       round(CASE WHEN k >= 2 AND mn >= 2 THEN
         (12.0 / (N * (N + 1)) * s - 3 * (N + 1)) / (1 - T / (N * N * N - N)) END, {D}) AS statistic
FROM tot, ties"""


def chi2_sql(src: str, a: str, b: str, name: str) -> str:
    return f"""cells AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {src}
               WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS r FROM cells GROUP BY a),
cb AS (SELECT b, sum(o) AS c FROM cells GROUP BY b),
tot AS (SELECT sum(o) AS N, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS dof FROM cells),
every AS (SELECT coalesce(o, 0) AS o, r * c / N AS e, N, dof
  FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)
SELECT '{name}' AS test, CAST(max(N) AS BIGINT) AS n, CAST(max(dof) AS BIGINT) AS dof,
       round(CASE WHEN max(dof) = 1 THEN sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) ELSE sum(pow(o - e, 2) / e) END, {D}) AS statistic
FROM every"""


def spearman_sql(src: str, x: str, y: str, name: str, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""sr AS (SELECT {sel_by}{_avg_rank(x, by)} AS rx, {_avg_rank(y, by)} AS ry FROM {src}
              WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
SELECT {sel_by}{"" if by else f"'{name}' AS test, "}count(*) AS n, round(corr(rx, ry), {D}) AS statistic
FROM sr {grp}"""


SI = f"WITH {SCORED_ITEMS}"
NEG_ITEMS = "(SELECT * FROM scored_items WHERE friction_category <> 'N/A')"
AGENT_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
HUMAN = """(SELECT * REPLACE (CASE WHEN agent = '5-LOW' THEN 'Human' ELSE agent END AS agent)
           FROM scored_items)"""
HOURS = """(SELECT *, (epoch_us(merged_at) - epoch_us(created_at)) / 3600000000.0 AS time_to_merge_hours
           FROM scored_items)"""
PR_TIME = f"""(SELECT id_pr, avg(friction_score) AS friction_score,
                  any_value(time_to_merge_hours) AS time_to_merge_hours, any_value(agent) AS agent
           FROM {HOURS} WHERE time_to_merge_hours > 0 AND time_to_merge_hours < 8760 GROUP BY id_pr)"""
PR_ITER = """(SELECT id_pr, avg(friction_score) AS friction_score, count(clean_body) AS comment_count,
                  any_value(agent) AS agent FROM scored_items GROUP BY id_pr)"""
PR_OUT = """(SELECT id_pr, avg(friction_score) AS friction_score, count(clean_body) AS comment_count,
                  any_value((epoch_us(closed_at) - epoch_us(created_at)) / 3600000000.0) AS time_to_merge_hours,
                  max(CAST(contains(lower(state), 'merge') AS INTEGER)) AS is_merged
           FROM scored_items GROUP BY id_pr)"""


def _band(score: str, cuts=(0.2, 0.4)) -> str:
    return f"CASE WHEN {score} < {cuts[0]} THEN 'low' WHEN {score} < {cuts[1]} THEN 'medium' ELSE 'high' END"


ORACLE.update({
    "url_keys": f"""WITH {ITEMS}
SELECT item_id AS id, {url_repo('pull_request_url')} AS repo_path, {url_number('pull_request_url')} AS pr_number
FROM comments
UNION ALL
SELECT -page_id - 1 AS id, {url_repo('url')} AS repo_path, {url_number('url')} AS pr_number FROM pages""",
    "repo_keys": f"WITH {ITEMS} SELECT id, {repo_path('repo_url')} AS repo_path FROM prs0",
    "quick_close_filter": f"""WITH {ITEMS}
SELECT id, round(pr_duration_seconds, {D}) AS pr_duration_seconds FROM prs1
WHERE pr_duration_seconds IS NULL OR pr_duration_seconds >= 60""",
    "task_type_join": f"""WITH {ITEMS} SELECT pr_type, count(*) AS "count" FROM prs GROUP BY pr_type""",
    "items_union": f"""WITH {ITEMS}
SELECT item_id, source, id_pr, agent, pr_type, state, length(clean_body) AS clean_len,
       md5(clean_body) AS clean_md5 FROM items""",
    "baseline_union": f"""{SI}
SELECT agent, round(avg(friction_score), {D}) AS mean, count(friction_score) AS "count",
       round(stddev_samp(friction_score), {D}) AS std FROM {HUMAN} GROUP BY agent""",
    "bot_filter": f"""WITH {ITEMS},
u AS (SELECT 'comment' AS source, "user", user_type FROM comments
      UNION ALL SELECT 'review', "user", user_type FROM reviews)
SELECT source, (coalesce(regexp_matches(lower("user"), {_q(BOT_RE)}), false)
                OR coalesce(user_type = 'Bot', false)) AS is_bot, count(*) AS n
FROM u GROUP BY ALL""",
    "quality_funnel": f"""WITH d AS (SELECT text, {clean('text')} AS clean_body FROM documents),
s AS (SELECT * FROM {scored('d')}),
c AS (SELECT count(*) AS s0, count(*) FILTER (WHERE text IS NOT NULL) AS s1,
             count(*) FILTER (WHERE text IS NOT NULL AND length(clean_body) > 10) AS s2,
             count(*) FILTER (WHERE text IS NOT NULL AND length(clean_body) > 10 AND is_negative) AS s3
      FROM s)
SELECT step_no, step, CASE step_no WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS n_rows
FROM (VALUES (0, 'input'), (1, 'has_text'), (2, 'long_enough'), (3, 'negative')) v(step_no, step), c""",
    "value_counts": """SELECT event_type, count(*) AS "count" FROM events WHERE event_type IS NOT NULL GROUP BY 1""",
    "shares": f"""SELECT event_type, count(*) AS "count",
       round(100.0 * count(*) / (SELECT count(*) FROM events), {D}) AS pct FROM events GROUP BY 1""",
    "sentiment_summary": f"""{SI}
SELECT source, count(*) AS n, CAST(sum(CAST(is_negative AS INTEGER)) AS BIGINT) AS n_negative,
       round(avg(CAST(is_negative AS INTEGER)), {D}) AS negative_rate,
       round(avg(friction_score), {D}) AS mean_friction FROM scored_items GROUP BY source""",
    "sentiment_by_source": f"""{SI}
SELECT coalesce(source, 'all') AS source, count(*) AS n,
       CAST(sum(CAST(is_negative AS INTEGER)) AS BIGINT) AS n_negative,
       round(avg(CAST(is_negative AS INTEGER)), {D}) AS negative_rate,
       round(avg(friction_score), {D}) AS mean_friction,
       round(avg(CAST(sentiment_label = 'neutral' AS INTEGER)), {D}) AS neutral_rate,
       round(avg(CAST(sentiment_label = 'positive' AS INTEGER)), {D}) AS positive_rate
FROM scored_items GROUP BY ROLLUP (source)""",
    "merge_rates": f"""{SI}
SELECT agent, round(avg(CAST(coalesce(contains(lower(state), 'merge'), false) AS INTEGER)), {D}) AS merge_rate,
       count(state IS NOT NULL OR true) AS "count" FROM scored_items GROUP BY agent""",
    "category_counts": f"""{SI}
SELECT friction_category, count(*) AS "count",
       round(100.0 * count(*) / (SELECT count(*) FROM {NEG_ITEMS}), {D}) AS pct
FROM {NEG_ITEMS} GROUP BY 1""",
    "category_stats": f"""{SI}
SELECT friction_category, round(round(avg(friction_score), 4), {D}) AS mean_friction,
       round(round(stddev_samp(friction_score), 4), {D}) AS std_friction, count(*) AS "count"
FROM {NEG_ITEMS} GROUP BY 1""",
    "category_matrix": f"""{SI}
SELECT friction_category, {", ".join(f"count(*) FILTER (WHERE agent = {_q(a)}) AS {chr(34)}{a}{chr(34)}" for a in AGENT_VALUES)}
FROM {NEG_ITEMS} GROUP BY 1""",
    "category_share": f"""{SI}
SELECT friction_category, agent, count(*) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY agent), {D}) AS pct
FROM {NEG_ITEMS} GROUP BY 1, 2""",
    "monthly_trend": f"""{SI}
SELECT strftime(created_at, '%Y-%m') AS year_month, agent, round(avg(friction_score), {D}) AS mean,
       count(*) AS "count" FROM scored_items WHERE created_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""",
    "per_pr_time": f"""{SI} SELECT id_pr, round(friction_score, {D}) AS friction_score,
       round(time_to_merge_hours, {D}) AS time_to_merge_hours, agent FROM {PR_TIME}""",
    "per_pr_iterations": f"""{SI} SELECT id_pr, round(friction_score, {D}) AS friction_score,
       comment_count, agent FROM {PR_ITER}""",
    "label_counts": f"""{SI} SELECT sentiment_label, source, count(*) AS "count" FROM scored_items GROUP BY 1, 2""",
    "mean_matrix_source": f"""{SI}
SELECT agent, round(avg(friction_score) FILTER (WHERE source = 'comment'), {D}) AS comment,
       round(avg(friction_score) FILTER (WHERE source = 'review'), {D}) AS review,
       round(avg(friction_score) FILTER (WHERE source = 'comment')
             - avg(friction_score) FILTER (WHERE source = 'review'), {D}) AS comment_minus_review
FROM scored_items GROUP BY agent""",
    "mean_matrix_type": f"""{SI}
SELECT pr_type, {", ".join(f"round(avg(friction_score) FILTER (WHERE agent = {_q(a)}), {D}) AS {chr(34)}{a}{chr(34)}" for a in AGENT_VALUES)}
FROM scored_items GROUP BY 1""",
    "negative_rate": f"""{SI}
SELECT pr_type, round(avg(CAST(is_negative AS INTEGER)), {D}) AS negative_rate,
       round((SELECT avg(CAST(is_negative AS INTEGER)) FROM scored_items WHERE pr_type <> 'unknown'), {D}) AS overall_rate
FROM scored_items WHERE pr_type <> 'unknown' GROUP BY 1""",
    "type_stats": f"""{SI}
SELECT pr_type, round(round(avg(friction_score), 4), {D}) AS mean_friction,
       round(round(stddev_samp(friction_score), 4), {D}) AS std_friction, count(*) AS "count",
       round(round(avg(CAST(is_negative AS INTEGER)), 4), {D}) AS negative_rate
FROM scored_items WHERE pr_type <> 'unknown' GROUP BY 1""",
    "top_topics": f"""WITH {SCORED_DOCS},
c AS (SELECT lang, source, count(*) AS n FROM scored_docs GROUP BY 1, 2)
SELECT * FROM (SELECT lang, source, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank
               FROM c WHERE n > 0) WHERE rank <= 3""",
    "band_outcomes": f"""{SI}
SELECT {_band('friction_score')} AS band, round(avg(is_merged), {D}) AS merge_rate, count(*) AS n,
       round(quantile_cont(time_to_merge_hours, 0.5), {D}) AS median_hours,
       round(quantile_cont(comment_count, 0.5), {D}) AS median_items
FROM {PR_OUT} GROUP BY 1""",
    "quartile_contrast": f"""{SI}, pr AS (SELECT * FROM {PR_OUT}),
q AS (SELECT quantile_cont(friction_score, 0.25) AS lo, quantile_cont(friction_score, 0.75) AS hi FROM pr)
SELECT quartile, round(avg(comment_count), {D}) AS mean_items, count(*) AS n,
       round(quantile_cont(comment_count, 0.5), {D}) AS median_items
FROM (SELECT pr.*, CASE WHEN friction_score <= q.lo THEN 'bottom' WHEN friction_score >= q.hi THEN 'top' END AS quartile
      FROM pr, q) WHERE quartile IS NOT NULL GROUP BY 1""",
    "band_counts": f"""{SI}
SELECT agent, count(*) FILTER (WHERE {_band('friction_score', (0.2, 0.5))} = 'low') AS low,
       count(*) FILTER (WHERE {_band('friction_score', (0.2, 0.5))} = 'medium') AS medium,
       count(*) FILTER (WHERE {_band('friction_score', (0.2, 0.5))} = 'high') AS high
FROM scored_items GROUP BY agent""",
    "triage": f"""{SI} SELECT agent, count(*) AS n_triage FROM scored_items WHERE friction_score > 0.4 GROUP BY agent""",
    "kruskal_events": f"WITH {kruskal_sql('events', 'event_type', 'value', 'kruskal_events')}",
    "kruskal_agents": f"{SI}, {kruskal_sql('scored_items', 'agent', 'friction_score', 'kruskal_agents')}",
    "kruskal_categories": f"{SI}, {kruskal_sql(NEG_ITEMS, 'friction_category', 'friction_score', 'kruskal_categories')}",
    "mann_whitney_pairs": f"""WITH g AS (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL),
pairs AS (SELECT a.event_type AS ga, b.event_type AS gb FROM g a JOIN g b ON a.event_type < b.event_type),
x AS (SELECT p.ga, p.gb, e.event_type, e.value FROM pairs p JOIN events e
      ON e.event_type = p.ga OR e.event_type = p.gb WHERE e.value IS NOT NULL),
r AS (SELECT *, {_avg_rank('value', 'ga, gb')} AS rk FROM x),
s AS (SELECT ga, gb, count(*) FILTER (WHERE event_type = ga) AS n_a, count(*) FILTER (WHERE event_type = gb) AS n_b,
             sum(rk) FILTER (WHERE event_type = ga) AS ra FROM r GROUP BY ga, gb)
SELECT ga || ' vs ' || gb AS pair, ga AS group_a, gb AS group_b, n_a, n_b,
       round(ra - n_a * (n_a + 1) / 2.0, {D}) AS statistic FROM s""",
    "mann_whitney_two": f"""{SI},
x AS (SELECT CASE WHEN agent = '5-LOW' THEN 'Human' ELSE 'AI' END AS g, friction_score AS v FROM scored_items),
r AS (SELECT *, {_avg_rank('v')} AS rk FROM x)
SELECT 'Human vs AI' AS pair, count(*) FILTER (WHERE g = 'Human') AS n_a, count(*) FILTER (WHERE g = 'AI') AS n_b,
       round(sum(rk) FILTER (WHERE g = 'Human') - count(*) FILTER (WHERE g = 'Human') * (count(*) FILTER (WHERE g = 'Human') + 1) / 2.0, {D}) AS statistic
FROM r""",
    "point_biserial": f"""WITH {SCORED_DOCS}
SELECT 'pointbiserial' AS test, count(*) AS n, round(corr(friction_score, toxic), {D}) AS statistic
FROM scored_docs JOIN labels USING (doc_id) WHERE toxic IS NOT NULL""",
    "chi2_category_agent": f"{SI}, {chi2_sql(NEG_ITEMS, 'friction_category', 'agent', 'chi2_category_agent')}",
    "chi2_lang_source": f"WITH {chi2_sql('documents', 'lang', 'source', 'chi2_lang_source')}",
    "spearman_time": f"{SI}, {spearman_sql(PR_TIME, 'friction_score', 'time_to_merge_hours', 'spearman_time')}",
    "spearman_iterations": f"{SI}, {spearman_sql(PR_ITER, 'friction_score', 'comment_count', 'spearman_iterations')}",
    "spearman_by_group": f"""WITH ev AS (SELECT event_type, value,
       floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 86400000000) AS time_numeric
       FROM events),
{spearman_sql('ev', 'time_numeric', 'value', 'spearman_by_group', by='event_type')} HAVING count(*) >= 10""",
    "box_stats": f"""WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events
       WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1)
SELECT event_type, n, round(q1, {D}) AS q1, round(median, {D}) AS median, round(q3, {D}) AS q3,
       round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), {D}) AS whisker_low,
       round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), {D}) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM events JOIN q USING (event_type) WHERE value IS NOT NULL GROUP BY event_type, n, q1, median, q3""",
    "box_stats_agents": f"""{SI}, q AS (SELECT agent, count(friction_score) AS n, quantile_cont(friction_score, 0.25) AS q1,
       quantile_cont(friction_score, 0.5) AS median, quantile_cont(friction_score, 0.75) AS q3 FROM scored_items
       GROUP BY 1)
SELECT agent, n, round(q1, {D}) AS q1, round(median, {D}) AS median, round(q3, {D}) AS q3,
       round(min(friction_score) FILTER (WHERE friction_score >= q1 - 1.5 * (q3 - q1)), {D}) AS whisker_low,
       round(max(friction_score) FILTER (WHERE friction_score <= q3 + 1.5 * (q3 - q1)), {D}) AS whisker_high,
       count(*) FILTER (WHERE friction_score < q1 - 1.5 * (q3 - q1) OR friction_score > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM scored_items JOIN q USING (agent) GROUP BY agent, n, q1, median, q3""",
    "histogram": f"""WITH r AS (SELECT event_type, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
       CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
       FROM events WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM events JOIN r USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT r.event_type, CAST(g.bin AS INTEGER) AS bin, coalesce(b.n, 0) AS n, round(lo + g.bin * (hi - lo) / 30.0, {D}) AS bin_lo,
       round(lo + (g.bin + 1) * (hi - lo) / 30.0, {D}) AS bin_hi
FROM r CROSS JOIN range(30) g(bin) LEFT JOIN b ON b.event_type = r.event_type AND b.bin = g.bin""",
    "density": f"""WITH st AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h,
       min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY 1),
v AS (SELECT event_type, value, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT st.*, p.point, st.lo + p.point * (st.hi - st.lo) / 99.0 AS x FROM st, range(100) p(point) WHERE st.h > 0)
SELECT g.event_type, CAST(g.point AS INTEGER) AS point, round(max(g.x), {D}) AS x,
       round(sum(v.c * exp(-0.5 * ((g.x - v.value) / g.h) ^ 2) / (g.n * g.h * sqrt(2 * pi()))), {D}) AS density
FROM g JOIN v USING (event_type) GROUP BY g.event_type, g.point""",
})

from ..operators.topics import STOP_WORDS  # noqa: E402

TERMS = f"""tok AS (
  SELECT doc_id, source, lang, list_filter(regexp_extract_all(lower(clean_body), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
         lambda w: w NOT IN {_inlist(STOP_WORDS)}) AS t FROM clean_docs),
dterms AS (
  SELECT doc_id, source, lang, list_concat(t, CASE WHEN len(t) >= 2 THEN
           list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS terms
  FROM tok),
cnt AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(terms) AS term FROM dterms) GROUP BY 1, 2),
kept AS (SELECT * FROM cnt WHERE term IN (SELECT term FROM cnt GROUP BY term HAVING count(*) >= 2)),
pt AS (SELECT source, sum(n) AS tn FROM kept GROUP BY 1),
pf AS (SELECT term, sum(n) AS f FROM kept GROUP BY 1),
a AS (SELECT floor((SELECT sum(n) FROM kept) / (SELECT count(DISTINCT source) FROM kept)) AS avg_n),
sc AS (SELECT k.source, k.term, k.n, sqrt(k.n / pt.tn) * ln(1 + a.avg_n / pf.f) AS score
       FROM kept k JOIN pt USING (source) JOIN pf USING (term), a),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM sc)"""

ORACLE.update({
    "topic_terms": f"WITH {CLEAN_DOCS}, {TERMS} SELECT source, term, n FROM kept",
    "ctfidf_top": f"""WITH {CLEAN_DOCS}, {TERMS}
SELECT source, term, n, round(score, {D}) AS score, rank FROM top WHERE rank <= 10""",
    "topic_info": f"""WITH {CLEAN_DOCS}, {TERMS},
t10 AS (SELECT * FROM top WHERE rank <= 10),
rep AS (SELECT source, string_agg(term, ', ' ORDER BY rank) AS representation,
               string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name4 FROM t10 GROUP BY 1),
dt AS (SELECT DISTINCT doc_id, source, unnest(terms) AS term FROM dterms),
hits AS (SELECT source, doc_id, count(*) AS h FROM dt JOIN t10 USING (source, term) GROUP BY 1, 2),
best AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY k) AS representative_docs
         FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h DESC, doc_id) AS k FROM hits)
         WHERE k <= 3 GROUP BY 1),
sizes AS (SELECT source, count(*) AS "count" FROM clean_docs GROUP BY 1)
SELECT source, "count", source || coalesce('_' || name4, '') AS name, coalesce(representation, '') AS representation,
       coalesce(representative_docs, '') AS representative_docs
FROM sizes LEFT JOIN rep USING (source) LEFT JOIN best USING (source)""",
    "model_score": ORACLE["friction_by_group"],
    "model_category": f"""WITH {SCORED_DOCS}
SELECT {keyword_category('clean_body')} AS friction_category, count(*) AS "count"
FROM scored_docs WHERE is_negative GROUP BY 1""",
})

ORACLE.update({
    "mean_matrix_type_source": f"""{SI}
SELECT pr_type, round(avg(friction_score) FILTER (WHERE source = 'comment'), {D}) AS comment,
       round(avg(friction_score) FILTER (WHERE source = 'review'), {D}) AS review
FROM scored_items GROUP BY pr_type""",
    "spearman_temporal_agents": f"""{SI},
ev AS (SELECT agent, friction_score,
       floor((epoch_us(created_at) - min(epoch_us(created_at)) OVER (PARTITION BY agent)) / 86400000000) AS time_numeric
       FROM scored_items WHERE created_at IS NOT NULL),
{spearman_sql('ev', 'time_numeric', 'friction_score', 'x', by='agent')} HAVING count(*) >= 10""",
})

ORACLE["label_counts_agent"] = f"""WITH {SCORED_ITEMS}
SELECT sentiment_label, agent, count(*) AS "count" FROM scored_items GROUP BY 1, 2"""

ORACLE["box_stats_agent_source"] = f"""WITH {SCORED_ITEMS}, q AS (
  SELECT agent, source, count(friction_score) AS n, quantile_cont(friction_score, 0.25) AS q1,
         quantile_cont(friction_score, 0.5) AS median, quantile_cont(friction_score, 0.75) AS q3
  FROM scored_items GROUP BY 1, 2)
SELECT agent, source, n, round(q1, {D}) AS q1, round(median, {D}) AS median, round(q3, {D}) AS q3,
       round(min(friction_score) FILTER (WHERE friction_score >= q1 - 1.5 * (q3 - q1)), {D}) AS whisker_low,
       round(max(friction_score) FILTER (WHERE friction_score <= q3 + 1.5 * (q3 - q1)), {D}) AS whisker_high,
       count(*) FILTER (WHERE friction_score < q1 - 1.5 * (q3 - q1) OR friction_score > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM scored_items JOIN q USING (agent, source) GROUP BY agent, source, n, q1, median, q3"""

# The comments' bot rule looks at the user name alone, the reviews' also at the account type
_BOT_NAME = f"coalesce(regexp_matches(lower(\"user\"), {_q(BOT_RE)}), false)"
ORACLE["pipeline_funnel"] = f"""WITH {ITEMS},
jc AS (SELECT {_BOT_NAME} AS bot, length({clean('c.body')}) > 10 AS long FROM comments c JOIN prs p
  ON {url_repo('c.pull_request_url')} = p.repo_path AND {url_number('c.pull_request_url')} = p.number),
jr AS (SELECT ({_BOT_NAME} OR coalesce(r.user_type = 'Bot', false)) AS bot, length({clean('r.body')}) > 10 AS long
  FROM reviews r JOIN prs p ON r.pr_id = p.id)
SELECT 'prs' AS source_table, 0 AS step_no, 'input' AS step, (SELECT count(*) FROM prs1) AS n_rows
UNION ALL SELECT 'prs', 1, 'not_quick_close',
  (SELECT count(*) FROM prs1 WHERE pr_duration_seconds IS NULL OR pr_duration_seconds >= 60)
UNION ALL SELECT 'comments', 0, 'input', (SELECT count(*) FROM comments)
UNION ALL SELECT 'comments', 1, 'joined', (SELECT count(*) FROM jc)
UNION ALL SELECT 'comments', 2, 'not_bot', (SELECT count(*) FROM jc WHERE NOT bot)
UNION ALL SELECT 'comments', 3, 'long_enough', (SELECT count(*) FROM jc WHERE NOT bot AND long)
UNION ALL SELECT 'reviews', 0, 'input', (SELECT count(*) FROM reviews)
UNION ALL SELECT 'reviews', 1, 'joined', (SELECT count(*) FROM jr)
UNION ALL SELECT 'reviews', 2, 'not_bot', (SELECT count(*) FROM jr WHERE NOT bot)
UNION ALL SELECT 'reviews', 3, 'long_enough', (SELECT count(*) FROM jr WHERE NOT bot AND long)"""


def _terms_of(topic: str) -> str:
    """The c-TF-IDF tables of TERMS for another topic expression."""
    return TERMS.replace("SELECT doc_id, source, lang, list_filter", f"SELECT doc_id, {topic} AS source, lang, list_filter")


_COSINE = """nrm AS (SELECT source, sqrt(sum(score * score)) AS nrm FROM sc GROUP BY 1),
cosines AS (SELECT x.source AS a, y.source AS b, sum(x.score * y.score) / (max(nx.nrm) * max(ny.nrm)) AS cosine
  FROM sc x JOIN sc y ON x.term = y.term AND x.source < y.source
  JOIN nrm nx ON nx.source = x.source JOIN nrm ny ON ny.source = y.source GROUP BY 1, 2)"""

ORACLE.update({
    "topic_numbers_kept": "SELECT count(*) AS n, 0 AS n_changed FROM embeddings WHERE embedding IS NOT NULL",
    "distance_outliers": f"""WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL),
m AS (SELECT label, list(v ORDER BY i) AS mean FROM (
  SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e) GROUP BY 1, 2)
  GROUP BY 1),
far AS (SELECT label, list_distance(x, mean) AS distance FROM e JOIN m USING (label)),
cut AS (SELECT label, quantile_cont(distance, 0.95) AS cut FROM far GROUP BY 1)
SELECT label, count(*) AS n, count(*) FILTER (WHERE distance > cut) AS n_outliers,
       round(avg(distance), {D}) AS mean_distance, round(max(distance), {D}) AS max_distance
FROM far JOIN cut USING (label) GROUP BY label""",
    "topic_cosine": f"""WITH {CLEAN_DOCS}, {_terms_of("concat_ws('/', lang, source)")}, {_COSINE}
SELECT a, b, round(cosine, {D}) AS cosine FROM cosines WHERE cosine >= 0.5""",
    # the least label that a topic reaches over pairs of cosine >= 0.9
    "topic_merge": f"""WITH RECURSIVE {CLEAN_DOCS}, {_terms_of("lang")}, {_COSINE},
near AS (SELECT a, b FROM cosines WHERE cosine >= 0.9 UNION ALL SELECT b, a FROM cosines WHERE cosine >= 0.9),
reach(lang, other) AS (SELECT DISTINCT source, source FROM sc UNION SELECT lang, b FROM reach JOIN near ON other = a)
SELECT lang, min(other) AS merged_topic FROM reach GROUP BY lang""",
})


def _letters(t: str, which: str = "") -> str:
    """Letters a to z of either case, or only ``which``."""
    keep = f"{which}{which.upper()}" if which else "A-Za-z"
    return f"length(regexp_replace({t}, '[^{keep}]', '', 'g'))"


def _share(t: str, which: str) -> str:
    return f"CASE WHEN {_letters(t)} > 0 THEN {_letters(t, which)}::DOUBLE / {_letters(t)} ELSE 0 END"


_LABELS = ", ".join(f"({i}, {_q(x)}, lower('This code review comment is about {x}.'))" for i, x in enumerate(CATEGORY_KEYWORDS))


def _grams(src: str, key: str, text: str) -> str:
    return f"""SELECT {key}, substr(' ' || w || ' ', i, 3) AS g, count(*)::DOUBLE AS n FROM (
    SELECT {key}, w, unnest(range(1, length(w) + 1)) AS i FROM (
      SELECT {key}, unnest({tokens(text)}) AS w FROM {src}) WHERE w <> '') GROUP BY ALL"""


ORACLE.update({
    "embedded_documents": f"""WITH d AS (
  SELECT text, e.embedding AS v, e.embedding IS NOT NULL AND len(e.embedding) = 64
         AND len(list_filter(e.embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AS good
  FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id),
s AS (SELECT CASE WHEN good THEN 'precomputed' WHEN text IS NOT NULL THEN 'model' END AS embedding_source,
             CASE WHEN good THEN v[1]::DOUBLE WHEN text IS NOT NULL THEN {_share('text', 'a')} END AS a,
             CASE WHEN good THEN v[5]::DOUBLE WHEN text IS NOT NULL THEN {_share('text', 'e')} END AS e FROM d)
SELECT embedding_source, count(*) AS n, round(avg(a), {D}) AS mean_first, round(avg(e), {D}) AS mean_fifth,
       CASE WHEN embedding_source IS NOT NULL THEN 64 END AS width FROM s GROUP BY embedding_source""",
    "label_similarity_category": f"""WITH {SCORED_DOCS},
neg AS (SELECT doc_id, clean_body FROM scored_docs WHERE is_negative),
label(nth, name, prompt) AS (VALUES {_LABELS}),
pg AS ({_grams('label', 'nth', 'prompt')}),
idf AS (SELECT g, ln(5.0 / count(*)) AS w FROM pg GROUP BY g HAVING count(*) < 5),
p AS (SELECT nth, g, n * w AS x FROM pg JOIN idf USING (g)),
pn AS (SELECT nth, sqrt(sum(x * x)) AS norm FROM p GROUP BY nth),
t AS (SELECT doc_id, g, n * w AS y FROM ({_grams('neg', 'doc_id', 'clean_body')}) JOIN idf USING (g)),
tn AS (SELECT doc_id, sqrt(sum(y * y)) AS norm FROM t GROUP BY doc_id),
dots AS (SELECT doc_id, nth, sum(x * y) AS dot FROM t JOIN p USING (g) GROUP BY 1, 2),
every AS (SELECT tn.doc_id, pn.nth, round(coalesce(dot, 0) / pn.norm / tn.norm, 9) AS cosine
  FROM tn CROSS JOIN pn LEFT JOIN dots ON dots.doc_id = tn.doc_id AND dots.nth = pn.nth),
best AS (SELECT doc_id, nth FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, nth) = 1)
SELECT neg.doc_id, coalesce(label.name, {keyword_category('clean_body')}) AS friction_category
FROM neg LEFT JOIN best USING (doc_id) LEFT JOIN label USING (nth)""",
    "box_stats_sketched": """SELECT event_type, count(value) AS n, 3 AS n_quantiles, true AS within_bound FROM events
WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""",
    "sample_points": f"""SELECT event_id, event_type, round(value, {D}) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id::VARCHAR)) AS nth FROM events)
WHERE nth <= 200""",
    "ordered_groups": """SELECT agent, row_number() OVER (ORDER BY CASE agent WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END, agent) AS position
FROM (SELECT DISTINCT o_orderpriority AS agent FROM orders WHERE o_orderpriority IS NOT NULL)""",
    "baseline_joins": ORACLE["baseline_union"],
    "top_labels_by_source": """SELECT topic, source, n, rank FROM (
  SELECT label AS topic, source, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS rank
  FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2) WHERE rank <= 3""",
    "monthly_trend_reviews": f"""{SI}
SELECT strftime(created_at, '%Y-%m') AS year_month, agent, round(avg(friction_score), {D}) AS mean,
       count(*) AS "count" FROM scored_items WHERE created_at IS NOT NULL AND source = 'review' GROUP BY 1, 2""",
    "temporal_trend_agents": ORACLE["spearman_temporal_agents"],
})

ORACLE["merge_rates_by_time"] = f"""{SI}
SELECT agent, round(avg(CAST(merged_at IS NOT NULL AS INTEGER)), {D}) AS merge_rate, count(*) AS "count"
FROM scored_items GROUP BY agent"""
ORACLE["chi2_two_by_two"] = f"""WITH e AS (SELECT event_type = 'click' AS a, value > 50 AS b FROM events
  WHERE event_type IS NOT NULL AND value IS NOT NULL),
{chi2_sql('e', 'a', 'b', 'chi2_two_by_two')}"""


def _named_test(name: str, query: str) -> str:
    return f"SELECT '{name}' AS test, n, statistic FROM ({query})"


ORACLE["tests_six_statistics"] = " UNION ALL ".join([
    _named_test("kruskal_wallis_agents", ORACLE["kruskal_agents"]),
    _named_test("pointbiserial", f"""{SI} SELECT count(*) AS n, round(corr(friction_score,
        CAST(coalesce(contains(lower(state), 'merge'), false) AS INTEGER)), {D}) AS statistic FROM scored_items"""),
    _named_test("time_to_merge", ORACLE["spearman_time"]),
    _named_test("iterations", ORACLE["spearman_iterations"]),
    _named_test("kruskal_wallis_categories", ORACLE["kruskal_categories"]),
    _named_test("chi2_category_agent", ORACLE["chi2_category_agent"])])
