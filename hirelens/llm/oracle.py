"""DuckDB SQL for the training-data queries that SQL can express, written from their
contracts: exact set joins and components, whole quotient lists, windows by position."""

from __future__ import annotations

from hirelens.llm import mixing, near_dup, rules

ORACLE: dict[str, str] = {}

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op3_near_dup"] = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
        UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * k >= {near_dup.PERCENT} * (x.n + y.n - k)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents
                     UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)"""


def seeded_sql(*parts: str) -> str:
    text = f"concat_ws('|', '{mixing.SEED}', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def _quotas_sql(parties: str, group: str, party: str, weight: str, seats: str) -> str:
    """Every quotient of every party, the highest ``seats`` of a group taken."""
    return f"""SELECT {group}, {party}, count(*) AS quota FROM (
    SELECT {group}, {party}, {seats} AS seats, row_number() OVER (
      PARTITION BY {group} ORDER BY CAST({weight} AS DOUBLE) / (2 * seat + 1) DESC, {party}, seat) AS place
    FROM (SELECT *, unnest(range(0, {seats})) AS seat FROM {parties} WHERE {weight} > 0))
  WHERE place <= seats GROUP BY {group}, {party}"""


def _clip(at: str) -> str:
    return f"least(greatest({at} - begin, 0), size)"


ORACLE["op8_mixing"] = f"""
WITH texts AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
                      CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS th FROM documents),
sizes AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, th) - 1 AS copy FROM texts),
src AS (SELECT source, sum(size) AS source_size, count(*) AS n,
               row_number() OVER (ORDER BY source NULLS LAST) AS party FROM sizes GROUP BY source),
wt AS (SELECT *, {list(mixing.WEIGHTS)}[(party - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
              CAST({mixing.REPEAT} AS DOUBLE) * source_size AS most FROM src),
lv AS (SELECT *, (CAST({mixing.SHARE} AS DOUBLE) * sum(source_size) OVER ()
                  - (sum(most) OVER (ORDER BY most / weight, party) - most))
                 / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY most / weight, party) - weight)) AS level
       FROM wt),
lvl AS (SELECT level FROM lv WHERE level <= most / weight ORDER BY most / weight, party LIMIT 1),
goals AS (SELECT source, source_size, n, party, least(most, weight * (SELECT level FROM lvl)) AS target, 0 AS mix
          FROM wt),
seated AS (SELECT *, CAST(floor(CAST({mixing.SHARE} AS DOUBLE) * (SELECT sum(source_size) FROM goals) / {mixing.BLOCK}) AS BIGINT) AS seats FROM goals),
quota AS ({_quotas_sql('seated', 'mix', 'party', 'target', 'seats')}),
sharded AS (
  SELECT z.doc_id, z.th, z.copy, z.size, g.party, g.source_size, g.target, coalesce(q.quota, 0) AS seats,
         {seeded_sql("'shard'", 'z.doc_id', 'z.th', 'z.copy')} % CAST(ceil(g.n / {mixing.SHARD}) AS BIGINT) AS shard
  FROM sizes z JOIN goals g ON z.source IS NOT DISTINCT FROM g.source LEFT JOIN quota q ON q.party = g.party),
shards AS (SELECT party, shard, seats, sum(size) AS words,
                  CAST(ceil(sum(size) / {mixing.BLOCK}) AS BIGINT) AS blocks FROM sharded GROUP BY ALL),
dealt0 AS ({_quotas_sql('shards', 'party', 'shard', 'words', 'seats')}),
dealt AS (SELECT s.party, s.shard, blocks, least(coalesce(quota, 0), {mixing.REPEAT} * blocks) AS quota
          FROM shards s LEFT JOIN dealt0 d ON s.party = d.party AND s.shard = d.shard),
ring AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS base,
                CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS more,
                CASE WHEN blocks > 0 THEN {seeded_sql("'block'", 'party', 'shard')} % blocks ELSE 0 END AS start
         FROM dealt),
placed AS (SELECT *, sum(size) OVER (PARTITION BY party, shard ORDER BY {seeded_sql("'order'", 'doc_id', 'th', 'copy')}, doc_id, th, copy
                                     ROWS UNBOUNDED PRECEDING) - size AS begin FROM sharded)
SELECT doc_id, size, source_size, target,
       base * size + {_clip(f'least(start + more, blocks) * {mixing.BLOCK}')} - {_clip(f'start * {mixing.BLOCK}')}
       + {_clip(f'greatest(0, start + more - blocks) * {mixing.BLOCK}')} AS taken
FROM placed JOIN ring USING (party, shard)"""


def _share(measure: str) -> str:
    count, per, _, _ = rules.MEASURES[measure]
    return f"CAST({count} AS DOUBLE) / nullif({per}, 0)"


def _fits_sql(measure: str) -> str:
    _, _, below, above = rules.MEASURES[measure]
    spread = f"CAST({rules.FENCE} AS DOUBLE) * ({measure}[2] - {measure}[1])"
    value = f"coalesce({_share(measure)}, 0)"
    high = f"{value} <= coalesce({measure}[2] + greatest({spread}, {above}), {value})"
    if below is None:
        return high
    return f"{high} AND {value} >= coalesce({measure}[1] - greatest({spread}, {below}), {value})"


_QUARTILES = ", ".join(f"quantile_disc({_share(m)}, [0.25, 0.75]) AS {m}" for m in rules.MEASURES)


def _drawn(own: str, parent: str, n: str, i: int) -> str:
    """Quartile i of ``own``, with n texts, drawn towards the parent's."""
    share = f"(CAST({n} AS DOUBLE) / ({n} + CAST({rules.LEAST} AS DOUBLE)))"
    return f"coalesce({parent}[{i}] + {share} * ({own}[{i}] - {parent}[{i}]), {own}[{i}], {parent}[{i}])"


def _limit(m: str) -> str:
    language = f"l.{m}" if m in rules.WITHIN_LANGUAGE else \
        f"[{_drawn(f'l.{m}', f'a.{m}', 'l.n', 1)}, {_drawn(f'l.{m}', f'a.{m}', 'l.n', 2)}]"
    return f"[{_drawn(f'o.{m}', language, 'o.n', 1)}, {_drawn(f'o.{m}', language, 'o.n', 2)}] AS {m}"


_LIMITS = ", ".join(_limit(m) for m in rules.MEASURES)

ORACLE["op9_quality_rules"] = f"""
WITH b AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM b)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat
        FROM (SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM win JOIN twice USING (doc_id, g))
        GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM b)
       WHERE regexp_matches(l, '{WORDS}') GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines
      FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
own AS (SELECT lang, source, count(*) AS n, {_QUARTILES} FROM m GROUP BY lang, source),
bylang AS (SELECT lang, count(*) AS n, {_QUARTILES} FROM m GROUP BY lang),
whole AS (SELECT {_QUARTILES} FROM m),
lim AS (SELECT o.lang, o.source, {_LIMITS}
        FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang, whole a),
v AS (SELECT m.*, (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words)
             AS base_failed,
             {' AND '.join(_fits_sql(m) for m in rules.MEASURES)} AS fits
      FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fits AS kept FROM v"""
