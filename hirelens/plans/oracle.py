"""DuckDB oracle SQL, one statement per registered query.

Each statement rebuilds the same stand-in tables from the driver's views (SURVEY §7.2)
with plain SQL, then computes the query's answer independently of Spark. Column names
and types are aliased to match the Spark result.
"""

from __future__ import annotations

from hirelens.functions.text import BOILERPLATE, EMAIL, HTML_TAG, MONEY, NOT_KEPT, PAY_LINE, URL
from hirelens.schemas import STATUSES

from hirelens.plans.params import AS_OF, EMBEDDING_DIM, EMBEDDING_MODEL, MODEL_CHARS, TRAINED_AT


def _re(expr: str, pattern: str, opts: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', ' ', '{opts}')"


def clean_sql(expr: str) -> str:
    """R0–R8 in DuckDB (RE2)."""
    out = f"coalesce({expr}, '')"
    for p, o in [(HTML_TAG, "g"), (URL, "g"), (EMAIL, "g"), (MONEY, "gi"), (PAY_LINE, "gi")]:
        out = _re(out, p, o)
    for p in BOILERPLATE:
        out = _re(out, p, "gis")
    out = _re(out, NOT_KEPT, "g")
    out = _re(out, r"\s+", "g")
    return f"trim({out})"


POSTINGS_CTE = """
postings AS (
  SELECT doc_id AS job_id, concat_ws(' ', lang, source) AS title, text AS description,
         source AS company_name, lang AS formatted_experience_level, 0 AS ingest
  FROM documents
  UNION ALL
  SELECT doc_id, concat_ws(' ', lang, source), text || chr(10) || 'Reposted listing.',
         source, lang, 1
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
)"""

CORPUS_CTES = POSTINGS_CTE + f""",
kept AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ingest) AS rn
    FROM postings WHERE description IS NOT NULL AND title IS NOT NULL) WHERE rn = 1
),
cleaned AS (
  SELECT *, {clean_sql('description')} AS clean_description
  FROM kept WHERE length(description) > 200
),
clean AS (SELECT * FROM cleaned WHERE length(clean_description) > 100),
lists AS (
  SELECT l_orderkey AS job_id,
         list_sort(list(DISTINCT coalesce(lower(trim(p_name)), ''))) AS skill_categories
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey
),
final AS (
  SELECT c.job_id, c.title, c.formatted_experience_level AS exp_level, c.clean_description,
         coalesce(l.skill_categories, []::VARCHAR[]) AS skill_categories
  FROM clean c LEFT JOIN lists l ON c.job_id = l.job_id
),
cat_counts AS (
  SELECT category, count(*) AS postings
  FROM (SELECT unnest(skill_categories) AS category FROM final)
  GROUP BY category HAVING count(*) >= 10
)"""

ORACLE: dict[str, str] = {}

ORACLE["category_top30"] = f"""
WITH {CORPUS_CTES}
SELECT category, postings FROM cat_counts ORDER BY postings DESC, category LIMIT 30"""

ORACLE["job_skill_lists"] = f"""
WITH {CORPUS_CTES}
SELECT job_id, skill_categories FROM lists"""

ORACLE["corpus_dedup"] = f"""
WITH {POSTINGS_CTE}
SELECT job_id, title, description, formatted_experience_level FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ingest) AS rn
  FROM postings WHERE description IS NOT NULL AND title IS NOT NULL) WHERE rn = 1"""

ORACLE["experience_dist"] = f"""
WITH {CORPUS_CTES}
SELECT exp_level, count(*) AS postings FROM final WHERE exp_level IS NOT NULL GROUP BY exp_level"""

ORACLE["clean_documents"] = f"""
SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents"""

ORACLE["clean_pages"] = f"""
SELECT page_id, {clean_sql('html')} AS clean_text FROM pages"""

ORACLE["corpus_final"] = f"""
WITH {CORPUS_CTES}
SELECT job_id, title, exp_level, clean_description, skill_categories FROM final"""

ORACLE["corpus_funnel"] = f"""
WITH {CORPUS_CTES}
SELECT (SELECT count(*) FROM postings) AS raw_rows,
       (SELECT count(*) FROM kept) AS after_dedup,
       (SELECT count(*) FROM cleaned) AS after_length,
       (SELECT count(*) FROM clean) AS after_cleaning,
       (SELECT count(*) FROM final WHERE len(skill_categories) > 0) AS with_tags"""

ORACLE["corpus_metadata"] = f"""
WITH {CORPUS_CTES},
top AS (SELECT category, postings FROM cat_counts ORDER BY postings DESC, category LIMIT 30),
lv AS (SELECT exp_level, count(*) AS n FROM final WHERE exp_level IS NOT NULL GROUP BY exp_level)
SELECT strftime(TIMESTAMP '{TRAINED_AT}', '%Y-%m-%dT%H:%M:%S') AS trained_at,
       (SELECT count(*) FROM final) AS total_jds,
       (SELECT count(*) FROM cat_counts) AS total_categories,
       (SELECT coalesce(to_json(list({{'name': category, 'count': postings}}
                                      ORDER BY postings DESC, category)), '[]') FROM top)::VARCHAR
         AS top_categories,
       (SELECT coalesce(to_json(map_from_entries(list({{'k': exp_level, 'v': n}} ORDER BY exp_level))),
                        '{{}}') FROM lv)::VARCHAR AS exp_distribution,
       50 AS retrain_threshold, 0 AS analyses_since_retrain,
       '{EMBEDDING_MODEL}' AS embedding_model, {EMBEDDING_DIM} AS embedding_dim"""


def statuses_sql() -> str:
    return ", ".join(f"'{s}'" for s in STATUSES)


APPS_CTE = """
apps0 AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS company,
         'role ' || o_orderstatus AS role,
         CASE WHEN o_orderstatus = 'F' THEN
                CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'offer' ELSE 'rejected' END
              WHEN o_orderstatus = 'O' THEN
                CASE WHEN o_orderpriority = '1-URGENT' THEN 'interview'
                     WHEN o_orderpriority = '2-HIGH' THEN 'screening' ELSE 'applied' END
              ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'withdrawn' ELSE 'saved' END END AS status,
         o_orderdate AS ts
  FROM orders
),
apps AS (
  SELECT id, user_id, company, role, status,
         CASE WHEN status <> 'saved' THEN CAST(ts AS DATE) END AS applied_date,
         NULL::VARCHAR AS source_url, NULL::VARCHAR AS notes, ts AS created_at, ts AS updated_at
  FROM apps0
)"""

ANALYSES_CTE = """
alists AS (
  SELECT l_orderkey,
         list_sort(list(DISTINCT CASE WHEN l_linenumber = 1 THEN upper(p_name) ELSE p_name END))
           AS required_skills
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
analyses AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
         coalesce(a.required_skills, []::VARCHAR[]) AS required_skills,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'mid_level' WHEN '2-HIGH' THEN 'early_career'
              WHEN '3-MEDIUM' THEN 'student' WHEN '5-LOW' THEN 'fresher' END AS level
  FROM orders LEFT JOIN alists a ON o_orderkey = a.l_orderkey
)"""

CHANGES_CTE = """
ev AS (SELECT e.*, CAST(floor(event_id / 3) AS BIGINT) AS target FROM events e),
changes AS (
  SELECT event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete'
              ELSE 'patch' END AS op,
         CASE WHEN event_type = 'signup' THEN -(event_id + 1) ELSE target END AS id,
         CASE WHEN value < 10 OR o.o_custkey IS NULL THEN ev.user_id ELSE o.o_custkey END AS user_id,
         CASE WHEN event_type = 'signup' THEN
                MAP {'company': CASE WHEN value < 5 THEN ' ' ELSE 'Company ' || CAST(ev.user_id AS VARCHAR) END,
                     'role': 'Engineer', 'notes': props}
              WHEN event_type = 'purchase' THEN
                MAP {'status': ['saved', 'applied', 'screening', 'interview', 'offer', 'rejected',
                                'withdrawn', 'hired'][CAST(floor(value) AS BIGINT) % 8 + 1],
                     'applied_date': strftime(ts, '%Y-%m-%d')}
              WHEN event_type = 'click' THEN MAP {'notes': props}
              WHEN event_type = 'view' THEN MAP {'viewed_at': strftime(ts, '%Y-%m-%d %H:%M:%S')}
              ELSE MAP {}::MAP(VARCHAR, VARCHAR) END AS fields
  FROM ev LEFT JOIN orders o ON ev.target = o.o_orderkey
)"""

ORACLE["tracker_list"] = f"""
WITH {APPS_CTE}
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY applied_date DESC NULLS FIRST, id)
               AS INTEGER) AS pos FROM apps"""

ORACLE["tracker_list_by_status"] = f"""
WITH {APPS_CTE}
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY applied_date DESC NULLS FIRST, id)
               AS INTEGER) AS pos FROM apps WHERE status = 'interview'"""

ORACLE["status_counts"] = f"""
WITH {APPS_CTE}
SELECT user_id, status, count(*) AS n FROM apps GROUP BY user_id, status"""

ORACLE["status_wide"] = f"""
WITH {APPS_CTE}
SELECT user_id, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)}
FROM apps GROUP BY user_id"""

ORACLE["status_map"] = f"""
WITH {APPS_CTE}, c AS (SELECT user_id, status, count(*) AS n FROM apps GROUP BY user_id, status)
SELECT user_id, to_json(map_from_entries(list({{'k': status, 'v': n}} ORDER BY status)))::VARCHAR AS counts
FROM c GROUP BY user_id"""

ORACLE["tracker_board"] = f"""
WITH {APPS_CTE}, b AS (
  SELECT *, CAST(list_position([{statuses_sql()}], status) AS INTEGER) AS stage FROM apps)
SELECT user_id, stage, status, id,
       CAST(row_number() OVER (PARTITION BY user_id, stage ORDER BY applied_date DESC NULLS FIRST, id)
            AS INTEGER) AS card
FROM b"""

ORACLE["latest_per_user"] = f"""
WITH {ANALYSES_CTE}
SELECT user_id, id, created_at, level FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM analyses) WHERE rn = 1"""

ORACLE["owned_lookup"] = f"""
WITH {APPS_CTE}, {CHANGES_CTE}
SELECT c.seq, c.id, c.user_id, a.id IS NOT NULL AS found
FROM changes c LEFT JOIN apps a ON c.id = a.id AND c.user_id = a.user_id
WHERE c.op <> 'insert'"""


def weekly_sql(where: str = "TRUE", p: str = "", name: str = "weekly") -> str:
    return f"""
{p}wa AS (SELECT id, CAST(date_trunc('week', created_at) AS DATE) AS week_of, required_skills
       FROM analyses WHERE {where}),
{p}we AS (SELECT DISTINCT id, week_of, lower(trim(s)) AS skill
       FROM (SELECT id, week_of, unnest(required_skills) AS s FROM {p}wa)),
{p}wt AS (SELECT week_of, count(*) AS source_count FROM {p}wa GROUP BY week_of),
{name} AS (
  SELECT e.skill AS skill_name, e.week_of, CAST(count(*) AS INTEGER) AS frequency,
         CAST(any_value(t.source_count) AS INTEGER) AS source_count
  FROM {p}we e JOIN {p}wt t ON e.week_of = t.week_of WHERE e.skill <> ''
  GROUP BY e.skill, e.week_of
)"""


RECENT_SQL = """
recent AS (SELECT * FROM analyses WHERE required_skills IS NOT NULL
           ORDER BY created_at DESC, id LIMIT 100),
rs AS (SELECT lower(trim(unnest(required_skills))) AS skill FROM recent),
user_top AS (SELECT skill, count(*) AS n FROM rs WHERE skill <> '' GROUP BY skill
             ORDER BY n DESC, skill LIMIT 20)"""

ORACLE["recent_skill_trends"] = f"""
WITH {ANALYSES_CTE}, {RECENT_SQL}
SELECT skill, n FROM user_top"""

ORACLE["weekly_trends"] = f"""
WITH {ANALYSES_CTE}, {weekly_sql()}
SELECT skill_name, week_of, frequency, source_count FROM weekly"""

ORACLE["rising_skills"] = f"""
WITH {ANALYSES_CTE}, {weekly_sql()}
SELECT skill_name, week_of, frequency,
       lag(frequency) OVER (PARTITION BY skill_name ORDER BY week_of) AS prev_frequency,
       frequency - lag(frequency) OVER (PARTITION BY skill_name ORDER BY week_of) AS delta
FROM weekly"""

ORACLE["rising_skills_calendar"] = f"""
WITH {ANALYSES_CTE}, {weekly_sql()},
span AS (SELECT skill_name, min(week_of) AS f, max(week_of) AS l FROM weekly GROUP BY skill_name),
spine AS (SELECT skill_name,
                 CAST(unnest(generate_series(CAST(f AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 7 DAY))
                      AS DATE) AS week_of
          FROM span),
filled AS (SELECT s.skill_name, s.week_of, coalesce(w.frequency, 0) AS frequency
           FROM spine s LEFT JOIN weekly w ON s.skill_name = w.skill_name AND s.week_of = w.week_of)
SELECT skill_name, week_of, frequency,
       lag(frequency) OVER (PARTITION BY skill_name ORDER BY week_of) AS prev_frequency,
       frequency - lag(frequency) OVER (PARTITION BY skill_name ORDER BY week_of) AS delta
FROM filled"""

ORACLE["trend_feed"] = f"""
WITH {CORPUS_CTES}, {ANALYSES_CTE}, {RECENT_SQL},
top AS (SELECT category, postings FROM cat_counts ORDER BY postings DESC, category LIMIT 30),
u AS (SELECT 'ml_trends' AS source, category AS skill, postings AS n FROM top
      UNION ALL SELECT 'user_trends', skill, n FROM user_top),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, skill) AS INTEGER) AS rank FROM u)
SELECT source, skill, n, rank FROM r WHERE rank <= 20"""

ORACLE["retrain_check"] = """
SELECT count(*) AS analyses, 0 AS since, 50 AS threshold, count(*) - 0 >= 50 AS should_retrain
FROM orders"""

ORACLE["trend_upsert"] = f"""
WITH {ANALYSES_CTE},
{weekly_sql("created_at < TIMESTAMP '1998-01-01'", "b_", "base_w")},
{weekly_sql("created_at >= TIMESTAMP '1997-12-01'", "n_", "new_w")}
SELECT * FROM base_w b WHERE NOT EXISTS (
  SELECT 1 FROM new_w n WHERE n.skill_name = b.skill_name AND n.week_of = b.week_of)
UNION ALL SELECT * FROM new_w"""


ORACLE["trend_deltas"] = f"""
WITH {ANALYSES_CTE},
after AS (
  SELECT id, created_at, required_skills FROM analyses WHERE created_at >= TIMESTAMP '1998-01-01'
  UNION ALL
  SELECT id, CASE WHEN id % 31 = 5 THEN created_at + INTERVAL 7 DAY ELSE created_at END,
         CASE WHEN id % 31 = 5 THEN required_skills[:len(required_skills) - 1] ELSE required_skills END
  FROM analyses WHERE created_at < TIMESTAMP '1998-01-01' AND id % 29 <> 3),
{weekly_sql().replace("FROM analyses", "FROM after")}
SELECT skill_name, week_of, frequency, source_count FROM weekly"""


# ---- model replies, skills and matching ----------------------------------------

def toks_sql(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^a-z0-9+#.]+'), lambda x: x <> '')"


def terms_sql(expr: str) -> str:
    """Terms of skill texts: full stops that end a word are blanked first."""
    return toks_sql(f"regexp_replace(lower({expr}), '\\.+([^a-z0-9.]|$)', ' \\1', 'g')")


DICT_CTE = f"""
dict AS (SELECT skill, count(*) AS labels, len(string_split(skill, ' ')) AS n_words
         FROM (SELECT array_to_string({terms_sql('p_name')}, ' ') AS skill FROM part)
         WHERE skill <> '' GROUP BY skill)"""


def grams_sql(name: str, src: str, keys: str, text: str, extra: str = "") -> str:
    """CTEs {name}_t (term lists) and {name} (1-3 term runs; no label is longer) over
    table ``src``."""
    ex = f", {extra}" if extra else ""
    return f"""
{name}_t AS (SELECT {keys}{ex}, {terms_sql(text)} AS t FROM {src}),
{name} AS (
  SELECT {keys}{ex}, unnest(t) AS g FROM {name}_t
  UNION ALL SELECT {keys}{ex}, t[i] || ' ' || t[i + 1]
  FROM (SELECT {keys}{ex}, t, unnest(range(1, len(t))) AS i FROM {name}_t)
  UNION ALL SELECT {keys}{ex}, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]
  FROM (SELECT {keys}{ex}, t, unnest(range(1, len(t) - 1)) AS i FROM {name}_t)
)"""


def order_lines_sql(name: str, line: str, where: str = "true") -> str:
    return f"""
{name} AS (SELECT l_orderkey AS order_id, string_agg(line, chr(10) ORDER BY l_linenumber, line) AS lines
  FROM (SELECT l_orderkey, l_linenumber, {line} AS line
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where}) GROUP BY l_orderkey)"""


POSTING_LINES = order_lines_sql("plines", "CASE WHEN l_linenumber % 3 = 0 THEN 'Nice to have: ' || p_name "
                                          "ELSE 'Must know ' || upper(p_name) || '.' END")

POSTING_TEXTS = f"""{POSTING_LINES},
ptexts AS (
  SELECT doc_id AS job_id, concat_ws(' ', lang, source) AS jd_role, coalesce(source, '') AS jd_company,
         concat_ws(chr(10), text, concat_ws(' ', 'Title:', lang, source),
                   concat_ws(' ', 'Company:', source), lines) AS text
  FROM documents LEFT JOIN plines ON doc_id = order_id)"""

REQUESTS_CTE = f"""{POSTING_LINES},
{order_lines_sql('rlines', "'Built a ' || p_name || ', alone.'", "l_returnflag <> 'R'")},
resumes AS (SELECT o_orderkey AS resume_id, o_custkey AS user_id,
                   concat_ws(chr(10), 'Experience', lines) AS raw_text
            FROM orders LEFT JOIN rlines ON o_orderkey = order_id),
reqs AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey % 23 = 7 THEN -1 - o_orderkey
              ELSE o_orderkey END AS resume_id,
         o_custkey + CASE WHEN o_orderkey % 13 = 3 THEN 1 ELSE 0 END AS user_id,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS application_id,
         CASE WHEN o_orderkey % 11 = 4 THEN ''
              ELSE concat_ws(chr(10), 'Role: engineer ' || o_orderstatus,
                             'Company: house ' || o_orderpriority, lines) END AS jd_text,
         'engineer ' || o_orderstatus AS jd_role, 'house ' || o_orderpriority AS jd_company,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'mid_level' WHEN '2-HIGH' THEN 'early_career'
              WHEN '3-MEDIUM' THEN 'student' ELSE 'fresher' END AS level
  FROM orders LEFT JOIN plines ON o_orderkey = order_id),
checked AS (
  SELECT q.*, raw_text,
         CASE WHEN q.resume_id IS NULL THEN 'resume_id missing' WHEN jd_text = '' THEN 'jd_text missing'
              WHEN r.resume_id IS NULL THEN 'resume not found' ELSE 'accepted' END AS outcome
  FROM reqs q LEFT JOIN resumes r ON q.resume_id = r.resume_id AND q.user_id = r.user_id),
accepted AS (SELECT * FROM checked WHERE outcome = 'accepted')"""

ORACLE["analysis_requests"] = f"""
WITH {REQUESTS_CTE}
SELECT request_id, resume_id, user_id, application_id, jd_text, level, outcome FROM checked"""


REPLIES_CTE = r"""
r AS (SELECT event_id,
        CASE WHEN event_type = 'click' THEN '  ' || props || chr(10)
             WHEN event_type = 'view' THEN '```json' || chr(10) || props || chr(10) || '```'
             WHEN event_type = 'purchase' THEN '```' || chr(10) || props || chr(10) || '```' || chr(10)
             WHEN event_type = 'signup' THEN props || ' junk'
             ELSE '[' || props || ']' END AS raw
      FROM events),
s1 AS (SELECT event_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS c FROM r),
s2 AS (SELECT event_id, CASE WHEN starts_with(c, '```') THEN string_split(c, '```')[2] ELSE c END AS c FROM s1),
s3 AS (SELECT event_id, regexp_replace(CASE WHEN starts_with(c, 'json') THEN substr(c, 5) ELSE c END,
                                       '^\s+|\s+$', '', 'g') AS c FROM s2),
s4 AS (SELECT event_id, coalesce(json_valid(c) AND c <> '', false) AS valid FROM s3),
s5 AS (SELECT s4.event_id, valid, CASE WHEN valid THEN c END AS c FROM s4 JOIN s3 USING (event_id))"""

ORACLE["safe_parse_json"] = f"""
WITH {REPLIES_CTE}
SELECT event_id, valid AND json_type(c) = 'OBJECT' AS ok,
       CASE WHEN NOT valid THEN 'invalid_json' WHEN json_type(c) <> 'OBJECT' THEN 'not_object' END AS reason,
       CASE WHEN valid AND json_type(c) = 'OBJECT' AND json_exists(c, '$.k')
            THEN CAST(json_extract(c, '$.k') AS BIGINT) ELSE 0 END AS k
FROM s5"""

ORACLE["skill_dictionary"] = f"""
WITH {DICT_CTE}
SELECT skill, labels, CAST(n_words AS INTEGER) AS n_words FROM dict"""

ORACLE["doc_skills"] = f"""
WITH {DICT_CTE}, {POSTING_TEXTS}, {grams_sql('dg', 'ptexts', 'job_id', 'text')},
found AS (SELECT job_id, list_sort(list(DISTINCT g)) AS skills FROM dg JOIN dict ON g = skill GROUP BY job_id)
SELECT p.job_id AS doc_id, coalesce(skills, []::VARCHAR[]) AS skills FROM ptexts p LEFT JOIN found USING (job_id)"""

POSTING_LISTS = """
{name}_h AS (SELECT {keys}, g, min(CAST(pref AS INTEGER)) AS pref_only
             FROM {grams} JOIN dict ON g = skill GROUP BY ALL),
{name} AS (SELECT {keys},
         coalesce(list_sort(list(g) FILTER (WHERE pref_only = 0)), []::VARCHAR[]) AS required_skills,
         coalesce(list_sort(list(g) FILTER (WHERE pref_only = 1)), []::VARCHAR[]) AS preferred_skills
       FROM {name}_h GROUP BY ALL)"""

PREF_RE = "(?i)preferred|nice to have|bonus|plus"

ORACLE["posting_skills"] = f"""
WITH {DICT_CTE}, {POSTING_TEXTS},
pl AS (SELECT job_id, unnest(string_split(text, chr(10))) AS line FROM ptexts),
pl2 AS (SELECT job_id, line, regexp_matches(line, '{PREF_RE}') AS pref FROM pl),
{grams_sql('pg', 'pl2', 'job_id', 'line', 'pref')},
{POSTING_LISTS.format(name='plists', keys='job_id', grams='pg')}
SELECT p.job_id, jd_role, jd_company, coalesce(required_skills, []::VARCHAR[]) AS required_skills,
       coalesce(preferred_skills, []::VARCHAR[]) AS preferred_skills
FROM ptexts p LEFT JOIN plists USING (job_id)"""

PAIRS_CTE = """
pairs AS (
  SELECT u.conv_id, u.turn AS resume_turn, u.text AS resume_text, a.text AS jd_text
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

REPORT_CTE = f"""
{DICT_CTE}, {REQUESTS_CTE},
{grams_sql('rg', 'accepted', 'request_id', 'raw_text')},
rl AS (SELECT request_id, list_sort(list(DISTINCT g)) AS resume_skills
       FROM rg JOIN dict ON g = skill GROUP BY ALL),
jl AS (SELECT request_id, unnest(string_split(jd_text, chr(10))) AS line FROM accepted),
jl2 AS (SELECT request_id, line, regexp_matches(line, '{PREF_RE}') AS pref FROM jl),
{grams_sql('jg', 'jl2', 'request_id', 'line', 'pref')},
{POSTING_LISTS.format(name='jlists', keys='request_id', grams='jg')},
j AS (
  SELECT p.request_id, resume_id, user_id, application_id, level, jd_role, jd_company,
         coalesce(rl.resume_skills, []::VARCHAR[]) AS rs,
         coalesce(jlists.required_skills, []::VARCHAR[]) AS req,
         coalesce(jlists.preferred_skills, []::VARCHAR[]) AS pref
  FROM accepted p LEFT JOIN rl USING (request_id) LEFT JOIN jlists USING (request_id)),
k AS (
  SELECT *, list_distinct(list_concat(req, pref)) AS jd,
         len(req) + 0.5 * len(pref) AS den,
         len(list_intersect(req, rs)) + 0.5 * len(list_intersect(pref, rs)) AS num
  FROM j),
report AS (
  SELECT request_id, resume_id, user_id, application_id, level, rs AS resume_skills,
         req AS required_skills, pref AS preferred_skills, jd_role, jd_company,
         list_sort(list_intersect(jd, rs)) AS matched_skills,
         list_sort(list_filter(jd, lambda x: NOT list_contains(rs, x))) AS gap_skills,
         round(CASE WHEN den > 0 THEN num / den ELSE 0.0 END, 6) AS match_score,
         req AS _req
  FROM k),
report2 AS (
  SELECT * EXCLUDE (_req),
         CASE WHEN match_score >= 0.8 THEN 'strong' WHEN match_score >= 0.6 THEN 'good'
              WHEN match_score >= 0.4 THEN 'moderate' WHEN match_score >= 0.2 THEN 'weak'
              ELSE 'poor' END AS band,
         to_json(list_transform(gap_skills, lambda s: {{'type': 'add_skill',
                 'text': 'Add ' || s || ' to your resume',
                 'priority': CASE WHEN list_contains(_req, s) THEN 'high' ELSE 'medium' END}}))::VARCHAR
           AS suggestions
  FROM report)"""

ORACLE["match_report"] = f"""
WITH {REPORT_CTE}
SELECT * FROM report2"""

ORACLE["analysis_json_out"] = f"""
WITH {REPORT_CTE}
SELECT request_id, to_json({{'request_id': request_id, 'resume_id': resume_id, 'user_id': user_id,
  'application_id': application_id, 'level': level,
  'resume_skills': resume_skills, 'required_skills': required_skills,
  'preferred_skills': preferred_skills, 'jd_role': jd_role, 'jd_company': jd_company,
  'matched_skills': matched_skills, 'gap_skills': gap_skills, 'match_score': match_score,
  'band': band, 'suggestions': json(suggestions)}})::VARCHAR AS json
FROM report2"""

ORACLE["analysis_append"] = f"""
WITH {REPORT_CTE}
SELECT sha256(CAST(r.request_id AS VARCHAR)) AS id,
       r.user_id, r.resume_id, r.application_id, p.jd_text, r.jd_role, r.jd_company, required_skills,
       preferred_skills, resume_skills, matched_skills, gap_skills, match_score, suggestions,
       TIMESTAMP '{AS_OF}' AS created_at,
       (match_score IS NULL OR match_score BETWEEN 0.0 AND 1.0) AS score_ok
FROM report2 r JOIN accepted p ON r.request_id = p.request_id"""

ORACLE["score_eval"] = f"""
WITH {DICT_CTE}, {POSTING_TEXTS},
ld AS (SELECT job_id AS doc_id, text FROM ptexts WHERE job_id IN (SELECT doc_id FROM labels)),
{grams_sql('lg', 'ld', 'doc_id', 'text')},
hits AS (SELECT doc_id, count(DISTINCT g) AS hits FROM lg JOIN dict ON g = skill GROUP BY doc_id),
sc AS (SELECT l.doc_id, l.quality,
              round(coalesce(h.hits, 0) / greatest(1, (SELECT count(*) FROM dict)), 6) AS score
       FROM labels l LEFT JOIN hits h USING (doc_id)),
pc AS (SELECT *, CAST(round_even(score * 100, 0) AS INTEGER) AS percent FROM sc)
SELECT quality, count(*) AS docs, round(avg(percent), 6) AS mean_percent,
       round(avg(abs(percent - 60)), 6) AS mean_abs_error
FROM pc GROUP BY quality"""

ORACLE["pair_scores"] = f"""
WITH {PAIRS_CTE},
pt AS (SELECT conv_id, resume_turn, unnest({toks_sql('resume_text')}) AS tok, 1 AS ca, 0 AS cb FROM pairs
       UNION ALL
       SELECT conv_id, resume_turn, unnest({toks_sql('jd_text')}) AS tok, 0 AS ca, 1 AS cb FROM pairs),
tf AS (SELECT conv_id, resume_turn, tok, sum(ca) AS ca, sum(cb) AS cb FROM pt GROUP BY ALL),
ag AS (SELECT conv_id, resume_turn, CAST(sum(ca * cb) AS DOUBLE) AS dot, CAST(sum(ca * ca) AS DOUBLE) AS na,
              CAST(sum(cb * cb) AS DOUBLE) AS nb FROM tf GROUP BY ALL),
s AS (SELECT p.conv_id, p.resume_turn,
             coalesce(round(greatest(0.0, least(1.0, CASE WHEN na > 0 AND nb > 0
                      THEN dot / (sqrt(na) * sqrt(nb)) ELSE 0.0 END)), 6), 0.0) AS score
      FROM pairs p LEFT JOIN ag USING (conv_id, resume_turn))
SELECT conv_id, resume_turn, score, CAST(round_even(score * 100, 0) AS INTEGER) AS percent FROM s"""

ORACLE["top_matches"] = """
WITH r AS (SELECT vec_id AS resume_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE label = 0),
p AS (SELECT vec_id AS posting_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE label <> 0),
s AS (SELECT resume_id, posting_id,
             greatest(0.0, least(1.0, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))))
               AS score
      FROM r CROSS JOIN p),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, posting_id)
                     AS INTEGER) AS rank FROM s)
SELECT resume_id, posting_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5"""


# ---- table maintenance ------------------------------------------------------------

ALLOWED_SQL = "'company', 'role', 'status', 'applied_date', 'source_url', 'notes'"

OUTCOMES_CTE = f"""
{APPS_CTE}, {CHANGES_CTE},
v AS (
  SELECT *, map_contains(fields, 'status') AS has_status,
         CASE WHEN map_contains(fields, 'status') THEN fields['status'] ELSE 'applied' END AS ins_status,
         len(list_filter(map_keys(fields), lambda k: k IN ({ALLOWED_SQL}))) AS n_allowed,
         (NOT map_contains(fields, 'applied_date') OR fields['applied_date'] IS NULL
          OR TRY_CAST(fields['applied_date'] AS DATE) IS NOT NULL) AS date_ok
  FROM changes),
v2 AS (
  SELECT *, CASE
    WHEN op = 'insert' AND (trim(coalesce(fields['company'], '')) = ''
                            OR trim(coalesce(fields['role'], '')) = '') THEN 'company and role are required'
    WHEN op = 'insert' AND NOT coalesce(ins_status IN ({statuses_sql()}), false) THEN 'invalid status'
    WHEN op = 'insert' AND NOT date_ok THEN 'invalid date'
    WHEN op = 'patch' AND n_allowed = 0 THEN 'no valid fields'
    WHEN op = 'patch' AND has_status AND NOT coalesce(fields['status'] IN ({statuses_sql()}), false)
      THEN 'invalid status'
    WHEN op = 'patch' AND ((map_contains(fields, 'company') AND fields['company'] IS NULL)
                           OR (map_contains(fields, 'role') AND fields['role'] IS NULL))
      THEN 'company and role cannot be null'
    WHEN op = 'patch' AND NOT date_ok THEN 'invalid date'
  END AS invalid FROM v),
first_ins AS (SELECT id, arg_min(user_id, seq) AS owner, min(seq) AS created_seq
              FROM v2 WHERE op = 'insert' AND invalid IS NULL GROUP BY id),
life AS (
  SELECT id, owner, created_seq FROM (
    SELECT id, user_id AS owner, -4611686018427387904 AS created_seq FROM apps
    WHERE id IN (SELECT id FROM v2)
    UNION ALL SELECT id, owner, created_seq FROM first_ins)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_seq) = 1),
dels AS (SELECT v2.id, min(seq) AS delete_seq FROM v2 JOIN life ON v2.id = life.id
         WHERE op = 'delete' AND v2.user_id = life.owner AND v2.seq > life.created_seq GROUP BY v2.id),
o AS (
  SELECT v2.*, life.owner, life.created_seq, dels.delete_seq,
         coalesce(life.owner IS NOT NULL AND v2.user_id = life.owner AND life.created_seq < v2.seq
                  AND (dels.delete_seq IS NULL OR v2.seq <= dels.delete_seq), false) AS found
  FROM v2 LEFT JOIN life ON v2.id = life.id LEFT JOIN dels ON v2.id = dels.id),
outc AS (
  SELECT *, CASE WHEN op = 'insert' THEN
                   CASE WHEN invalid IS NOT NULL THEN invalid WHEN created_seq = seq THEN 'applied'
                        ELSE 'duplicate id' END
                 WHEN NOT found THEN 'not found' WHEN invalid IS NOT NULL THEN invalid
                 ELSE 'applied' END AS outcome
  FROM o)"""

ORACLE["change_validation"] = f"""
WITH {OUTCOMES_CTE}
SELECT seq, op, id, user_id, outcome FROM outc"""


def _patched(k: str, cast: str | None = None) -> str:
    val = f"s.patch['{k}']"
    if cast:
        val = f"TRY_CAST({val} AS {cast})"
    return f"CASE WHEN s.patch IS NOT NULL AND map_contains(s.patch, '{k}') THEN {val} ELSE r.{k} END AS {k}"


ORACLE["apply_changes"] = f"""
WITH {OUTCOMES_CTE},
done AS (SELECT * FROM outc WHERE outcome = 'applied'),
deleted AS (SELECT DISTINCT id FROM done WHERE op = 'delete'),
ins AS (SELECT id, user_id, trim(fields['company']) AS company, trim(fields['role']) AS role,
               ins_status AS status, TRY_CAST(fields['applied_date'] AS DATE) AS applied_date,
               fields['source_url'] AS source_url, fields['notes'] AS notes,
               TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
        FROM done WHERE op = 'insert' AND delete_seq IS NULL),
pe AS (SELECT id, seq, unnest(map_keys(fields)) AS k, unnest(map_values(fields)) AS v
       FROM done WHERE op = 'patch'),
lastv AS (SELECT id, k, arg_max({{'v': v}}, seq).v AS v FROM pe WHERE k IN ({ALLOWED_SQL}) GROUP BY id, k),
sets AS (SELECT id, map_from_entries(list({{'k': k, 'v': v}})) AS patch FROM lastv GROUP BY id),
rws AS (SELECT * FROM apps WHERE id NOT IN (SELECT id FROM deleted) UNION ALL SELECT * FROM ins)
SELECT r.id, r.user_id, {_patched('company')}, {_patched('role')}, {_patched('status')},
       {_patched('applied_date', 'DATE')}, {_patched('source_url')}, {_patched('notes')}, r.created_at,
       CASE WHEN s.patch IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE r.updated_at END AS updated_at
FROM rws r LEFT JOIN sets s ON r.id = s.id"""

ORACLE["changes_written"] = ORACLE["apply_changes"]

ORACLE["delete_propagation"] = f"""
WITH {APPS_CTE},
gu AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0),
ga AS (SELECT id, CASE WHEN status = 'withdrawn' THEN 'asked' ELSE 'users' END AS because
       FROM apps WHERE status = 'withdrawn' OR user_id IN (SELECT id FROM gu)),
gr AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 3 THEN 'asked' ELSE 'users' END AS because
       FROM orders WHERE o_orderkey % 19 = 3 OR o_custkey IN (SELECT id FROM gu)),
an AS (SELECT a.o_orderkey AS id, a.o_custkey AS user_id, r.o_orderkey AS resume_id,
              CASE WHEN a.o_orderstatus <> 'P' THEN a.o_orderkey END AS application_id
       FROM orders a LEFT JOIN orders r ON r.o_orderkey = a.o_orderkey - a.o_orderkey % 7
                                        AND a.o_orderkey - a.o_orderkey % 7 > 0),
tok AS (SELECT event_id AS id, user_id FROM events WHERE event_type = 'signup'),
rws AS (
  SELECT 'users' AS table_name, c_custkey AS id, NULL::BIGINT AS user_id, NULL::BIGINT AS resume_id,
         NULL::BIGINT AS application_id, CASE WHEN c_custkey IN (SELECT id FROM gu) THEN 'asked' END AS deleted_because
  FROM customer
  UNION ALL SELECT 'applications', apps.id, user_id, NULL, NULL, because FROM apps LEFT JOIN ga ON apps.id = ga.id
  UNION ALL SELECT 'resumes', o_orderkey, o_custkey, NULL, NULL, because FROM orders LEFT JOIN gr ON o_orderkey = gr.id
  UNION ALL SELECT 'analyses', id, user_id,
                   CASE WHEN resume_id NOT IN (SELECT id FROM gr) THEN resume_id END,
                   CASE WHEN application_id NOT IN (SELECT id FROM ga) THEN application_id END,
                   CASE WHEN user_id IN (SELECT id FROM gu) THEN 'users' END FROM an
  UNION ALL SELECT 'refresh_tokens', id, user_id, NULL, NULL,
                   CASE WHEN user_id IN (SELECT id FROM gu) THEN 'users' END FROM tok)
SELECT table_name, id, CASE WHEN deleted_because IS NULL THEN user_id END AS user_id,
       CASE WHEN deleted_because IS NULL THEN resume_id END AS resume_id,
       CASE WHEN deleted_because IS NULL THEN application_id END AS application_id, deleted_because
FROM rws"""

ORACLE["cascade_delete"] = f"""
WITH {APPS_CTE}
SELECT id, user_id FROM apps WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""

ORACLE["cascade_set_null"] = f"""
WITH {APPS_CTE}
SELECT id, CASE WHEN status = 'withdrawn' THEN NULL ELSE id END AS application_id FROM apps"""

ORACLE["orphan_rows"] = f"""
WITH {APPS_CTE}
SELECT id, user_id FROM apps WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""

ORACLE["new_users"] = """
SELECT user_id AS ext_id, sha256(CAST(user_id AS VARCHAR)) AS id, min(ts) AS created_at
FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
GROUP BY user_id"""


# ---- streaming, CSV and file intake -------------------------------------------------

ORACLE["stream_weekly_trends"] = ORACLE["weekly_trends"]
ORACLE["corpus_vectors"] = f"""
WITH {CORPUS_CTES},
cnt AS (SELECT job_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
                 lambda x: CAST(2 * length(clean_description) - length(replace(clean_description, x, ''))
                                - length(replace(clean_description, upper(x), '')) AS DOUBLE)) AS c FROM final),
nrm AS (SELECT job_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM cnt)
SELECT job_id, list_transform(c, lambda x: round(CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE 0.0 END AS FLOAT) AS DOUBLE), 5)) AS vector
FROM nrm"""

ORACLE["window_vectors"] = ORACLE["corpus_vectors"].replace(
    "AS c FROM final)",
    f"AS c FROM (SELECT job_id, substr(clean_description, 1, {MODEL_CHARS}) AS clean_description FROM final))")
ORACLE["stream_weekly_restarted"] = ORACLE["weekly_trends"]
ORACLE["weekly_trends_json_lists"] = ORACLE["weekly_trends"]

ORACLE["tenant_latest"] = f"""
WITH {APPS_CTE}
SELECT user_id, id, created_at, status, applications FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn,
         count(*) OVER (PARTITION BY user_id) AS applications FROM apps) WHERE rn = 1"""

ORACLE["stream_late_rows"] = f"""
WITH {ANALYSES_CTE},
marks AS (SELECT max(created_at) FILTER (WHERE id % 17 <> 4) - INTERVAL 7 DAY AS held_from,
                 max(created_at) - INTERVAL 7 DAY AS last FROM analyses),
wk AS (SELECT a.id, CAST(date_trunc('week', created_at) AS DATE) AS week_of,
              date_trunc('week', created_at) + INTERVAL 7 DAY AS week_end,
              list_filter(list_transform(required_skills, lambda x: lower(trim(x))), lambda x: x <> '') AS skills,
              id % 17 = 4 AND date_trunc('week', created_at) + INTERVAL 7 DAY <= held_from AS late, last
       FROM analyses a, marks),
named AS (SELECT week_of, week_end, last, skill
          FROM (SELECT id, week_of, week_end, last, unnest(list_distinct(skills)) AS skill FROM wk WHERE NOT late)
          UNION ALL SELECT week_of, week_end, last, NULL FROM wk WHERE NOT late)
SELECT 'late' AS kind, week_of, NULL AS skill_name, id, CAST(1 AS BIGINT) AS n FROM wk WHERE late
UNION ALL
SELECT 'closed', week_of, skill, NULL, count(*) FROM named WHERE week_end < last GROUP BY week_of, skill"""
ORACLE["corpus_csv_roundtrip"] = ORACLE["category_top30"]
ORACLE["corpus_artefacts"] = ORACLE["corpus_metadata"]

def weights_sql(src: str, key: str, text: str) -> str:
    return f"""
tc AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({toks_sql(text)}) AS term FROM {src})
       GROUP BY ALL),
vocab AS (SELECT term, ln(CAST((SELECT count(*) FROM {src}) + 1 AS DOUBLE) / (count(*) + 1)) AS idf
          FROM tc GROUP BY term),
rw AS (SELECT {key}, term, tf * idf AS w FROM tc JOIN vocab USING (term)),
weights AS (SELECT {key}, term, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY {key})), 0), 0.0) AS weight
            FROM rw)"""


ORACLE["term_vectors"] = f"""
WITH {CORPUS_CTES}, {weights_sql('final', 'job_id', 'clean_description')}
SELECT job_id, term, round(weight, 6) AS weight FROM weights"""

ORACLE["request_cosines"] = f"""
WITH {REQUESTS_CTE},
both_texts AS (SELECT 'r' || resume_id AS text_id, raw_text AS text FROM resumes
               UNION ALL SELECT 'q' || request_id, jd_text FROM accepted),
{weights_sql('both_texts', 'text_id', 'text')},
dots AS (SELECT request_id, sum(a.weight * b.weight) AS dot
         FROM accepted JOIN weights a ON a.text_id = 'r' || resume_id
         JOIN weights b ON b.text_id = 'q' || request_id AND b.term = a.term GROUP BY request_id),
sc AS (SELECT request_id, round(greatest(0.0, least(1.0, coalesce(dot, 0.0))), 6) AS score
       FROM accepted LEFT JOIN dots USING (request_id))
SELECT request_id, score, CAST(round_even(score * 100, 0) AS INTEGER) AS percent FROM sc"""

ORACLE["resume_append"] = rf"""
SELECT sha256(concat('upload/', conv_id, '/', turn, '/', name)) AS id, conv_id AS user_id, name AS file_name,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS raw_text, []::VARCHAR[] AS extracted_skills,
       TIMESTAMP '{AS_OF}' AS created_at
FROM (SELECT *, CASE WHEN turn = 0 THEN 'cv.docx' ELSE 'cv.DOCX' END AS name FROM conversations)
WHERE role = 'user' AND turn IN (0, 2) AND regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''"""

ORACLE["resume_intake_checks"] = r"""
WITH f AS (
  SELECT 'resume_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) ||
         CASE WHEN turn = 0 THEN '.docx' WHEN turn = 2 THEN '.DOCX' WHEN turn = 4 THEN '.pdf'
              ELSE '.txt' END AS file_name,
         regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t
  FROM conversations WHERE role = 'user'),
s AS (
  SELECT file_name, t,
         CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf reader not available'
              WHEN lower(file_name) NOT LIKE '%.docx' THEN 'unsupported type'
              WHEN t = '' THEN 'no text' ELSE 'accepted' END AS status
  FROM f)
SELECT file_name, status, CASE WHEN status = 'accepted' THEN t END AS raw_text,
       CASE WHEN status = 'accepted' THEN []::VARCHAR[] END AS extracted_skills
FROM s"""
