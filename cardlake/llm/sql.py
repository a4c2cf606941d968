"""DuckDB versions of the queries that SQL can express on whole tables."""

from __future__ import annotations

from ..plans.training import SQL_NAMED, SQL_SESSION

_P2 = r"""WITH RECURSIVE s AS (SELECT DISTINCT sessionId, seed FROM decision_recs WHERE seed IS NOT NULL AND seed <> 0 AND regexp_replace(sessionId, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g') <> ''),
e AS (SELECT DISTINCT a.seed AS u, b.seed AS v FROM s a JOIN s b ON a.sessionId = b.sessionId WHERE a.seed <> b.seed),
r(u, v) AS (SELECT DISTINCT seed, seed FROM s UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS g FROM r GROUP BY u),
m AS (SELECT s.sessionId, min(c.g) AS g FROM s JOIN c ON s.seed = c.u GROUP BY s.sessionId),
n AS (SELECT g FROM m GROUP BY g HAVING count(*) > 1)
SELECT m.sessionId, m.g AS groupSeed FROM m JOIN n ON m.g = n.g"""

_P3 = r"""WITH m0 AS (SELECT sessionId, messageId, turnIndex AS turn, CASE WHEN abs("timestamp") < 100000000000 THEN "timestamp" * 1000 ELSE "timestamp" END AS ms,
 CASE lower(regexp_replace(role, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g')) WHEN 'system' THEN 'system' WHEN 'developer' THEN 'system' WHEN 'instruction' THEN 'system'
  WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'player' THEN 'user' WHEN 'customer' THEN 'user'
  WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'agent' THEN 'assistant' WHEN 'ai' THEN 'assistant' END AS rl,
 coalesce(regexp_replace("text", '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g'), '') <> '' AS has,
 row_number() OVER (PARTITION BY sessionId, messageId ORDER BY receivedAt NULLS LAST) AS k
 FROM session_messages WHERE regexp_replace(sessionId, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g') <> ''),
m AS (SELECT *, max(turn) OVER (PARTITION BY sessionId ORDER BY coalesce(ms, -1) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM m0 WHERE k = 1),
o AS (SELECT *, coalesce(turn, seen) AS anchor, row_number() OVER (PARTITION BY sessionId ORDER BY coalesce(turn, seen, -1000000000000), turn IS NULL, coalesce(ms, -1), messageId) AS pos FROM m),
x AS (SELECT *, lead(rl) OVER w AS nr, lead(has) OVER w AS nh FROM o WINDOW w AS (PARTITION BY sessionId ORDER BY pos)),
f AS (SELECT sessionId, arg_min(coalesce(rl, '?'), pos) AS fr FROM o WHERE rl IS DISTINCT FROM 'system' GROUP BY sessionId),
g AS (SELECT sessionId, anchor, count(turn) AS nn, count(*) - count(turn) AS nl FROM o WHERE anchor IS NOT NULL GROUP BY sessionId, anchor),
h AS (SELECT sessionId, nn > 1 OR coalesce(anchor - lag(anchor) OVER w - 1 > lag(nl) OVER w, false) AS bad FROM g WINDOW w AS (PARTITION BY sessionId ORDER BY anchor)),
v AS (SELECT sessionId, count(*) FILTER (WHERE rl IN ('user', 'assistant') AND has) = 0 OR count(*) FILTER (WHERE rl IS NULL) > 0
 OR count(*) FILTER (WHERE rl = 'user' AND NOT coalesce(nr = 'assistant' AND nh, false)) > 0 AS bad FROM x GROUP BY sessionId)
SELECT v.sessionId FROM v LEFT JOIN f ON v.sessionId = f.sessionId LEFT JOIN (SELECT sessionId, bool_or(bad) AS hole FROM h GROUP BY sessionId) q ON v.sessionId = q.sessionId
WHERE v.bad OR coalesce(f.fr, '?') <> 'user' OR coalesce(q.hole, false)"""

_CARD = r"((?:ace|two|three|four|five|six|seven|eight|nine|ten|jack|queen|king|10|[2-9atjqk]) of (?:heart|diamond|club|spade)s?|(?:10|[2-9atjqk])[hdcs♥♦♣♠])"
_P5 = rf"""WITH n AS ({SQL_NAMED}), f AS (SELECT ses, cid, min(rowId) AS first FROM n WHERE ses IS NOT NULL AND cid IS NOT NULL GROUP BY ses, cid),
k AS (SELECT n.*, CASE WHEN json_valid(decision) AND json_type(decision) = 'OBJECT' THEN json_extract_string(decision, '$.chosenDescribe') END AS says
 FROM n LEFT JOIN f ON n.ses = f.ses AND n.cid = f.cid WHERE n.turnIndex IS NOT NULL AND n.ses IS NOT NULL AND (f.first IS NULL OR f.first = n.rowId)),
p AS (SELECT ses, turnIndex AS turn, rowId, rtrim(trim(regexp_replace(lower(says), '[\s\p{{Z}}\p{{Cf}}]+', ' ', 'g')), ' .!') AS p FROM k),
q AS (SELECT *, regexp_extract(p, '(?:^|[^\p{{L}}\d]){_CARD}(?:[^\p{{L}}\d]|$)', 1) AS card, regexp_extract_all(p, '(?:columns?|cols?|piles?|tableau)\s*#?\s*(\d+)', 1) AS places FROM p WHERE p <> ''),
r AS (SELECT *, CASE WHEN card LIKE '% of %' THEN coalesce(map {{'ace': 'a', 'two': '2', 'three': '3', 'four': '4', 'five': '5', 'six': '6', 'seven': '7', 'eight': '8', 'nine': '9', 'ten': '10', 'jack': 'j', 'queen': 'q', 'king': 'k', 't': '10'}}[split_part(card, ' of ', 1)], split_part(card, ' of ', 1)) || substr(split_part(card, ' of ', 2), 1, 1)
 ELSE replace(left(card, length(card) - 1), 't', '10') || translate(right(card, 1), '♥♦♣♠', 'hdcs') END AS c,
 CASE WHEN contains(p, 'waste') THEN 'waste' ELSE places[1] END AS src, CASE WHEN contains(p, 'foundation') THEN 'foundation' WHEN contains(p, 'waste') THEN places[1] ELSE places[2] END AS dst FROM q),
a AS (SELECT ses, turn, CASE WHEN card <> '' AND src IS NOT NULL AND dst IS NOT NULL THEN 'move:' || c || ':' || src || ':' || dst
 WHEN card = '' AND regexp_matches(p, 'recycle|waste (pile )?back (in)?to (the )?stock|turn the waste|waste\s*(→|->|=>|to)\s*stock|redeal') THEN 'recycle'
 WHEN card = '' AND regexp_matches(p, '^(draw\b|take next stock|take (a|one|the next) card|deal from (the )?stock|stock\s*(→|->|=>|to)\s*waste)') THEN 'draw' ELSE 'other:' || p END AS act FROM r),
b AS (SELECT *, CASE WHEN lag(act) OVER w = act AND turn - lag(turn) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY ses ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY ses ORDER BY turn) AS run FROM b)
SELECT ses AS sessionId, min(turn) AS firstTurn, max(turn) AS lastTurn FROM i GROUP BY ses, run HAVING max(turn) > min(turn)"""

SQL = {"p2_found": _P2, "p3_found": _P3, "p5_found": _P5}
assert SQL_SESSION in SQL_NAMED
