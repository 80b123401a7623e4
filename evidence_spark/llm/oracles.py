"""DuckDB SQL for the queries whose text is long: conversation repair and hard negatives."""

from __future__ import annotations

NEVER = "1000000000000"


def _edit(cost: str, letter: str, rest: str, line: str | None = None) -> str:
    """A repair that begins with one edit: its cost (c), letters (e) and repaired rows (o); line is the edit's own row, if it has one."""
    rows = f"{rest}.o" if line is None else f"{line} || CASE WHEN {rest}.o = '' THEN '' ELSE chr(10) || {rest}.o END"
    return f"{{'c': {rest}.c + {cost}, 'e': '{letter}' || {rest}.e, 'o': {rows}}}"


def _first_edits(state: str, role: str, behind: str, keep: dict[str, str]) -> str:
    """The best repair of row r and those behind it from a state that wants a role, without an insert before r."""
    late = f"CASE WHEN r.fault IN (1, 2) THEN {NEVER} WHEN r.fault = 3 THEN 5 ELSE 0 END"
    kept = [_edit(f"CASE WHEN left(r.role, 1) = '{i}' THEN {late} ELSE {NEVER} END", "K", f"d.{to}", "r.role || ':' || r.text") for i, to in keep.items()]
    options = [_edit("2", "D", f"d.{state}"), _edit(f"1 + {late}", "R", f"d.{behind}", f"'{role}:' || r.text"), *kept]
    return f"least({', '.join(options)})"


_CRC = """xor(4294967295, list_reduce(
    flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([CAST(ord(substring(k, i, 1)) AS BIGINT)], CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END,
    CAST(4294967295 AS BIGINT)))"""

#: A table of the best repairs of rows i+1 to n from each state (z start, s, u, a), one step of the recursion for each row from the end.
REPAIR = f"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS code
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
hurt AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM hurt),
numbered AS (
    SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair
    FROM placed),
counted AS (
    SELECT c.conv_id, count(r.pos) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps,
        count(*) FILTER (r.fault = 1) AS blank, count(*) FILTER (r.fault = 2) AS duplicate, count(*) FILTER (r.fault = 3) AS truncated,
        count(*) FILTER (r.pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
best AS (
    SELECT conv_id, n AS i, {{'c': CAST(0 AS BIGINT), 'e': '', 'o': ''}} AS z, {{'c': CAST(10 AS BIGINT), 'e': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} AS s,
        {{'c': CAST(5 AS BIGINT), 'e': 'I', 'o': 'assistant:'}} AS u, {{'c': CAST(0 AS BIGINT), 'e': '', 'o': ''}} AS a
    FROM counted
    UNION ALL
    SELECT conv_id, i, least(z, {_edit("5", "I", "u", "'user:'")}), least(s, {_edit("5", "I", "u", "'user:'")}), u, a
    FROM (SELECT conv_id, i, z, s, least(u, {_edit("5", "I", "a", "'assistant:'")}) AS u, least(a, {_edit("5", "I", "u", "'user:'")}) AS a
        FROM (SELECT d.conv_id, d.i - 1 AS i,
            {_first_edits("z", "user", "u", {"s": "s", "u": "u"})} AS z,
            {_first_edits("s", "user", "u", {"u": "u"})} AS s,
            {_first_edits("u", "assistant", "a", {"a": "a"})} AS u,
            {_first_edits("a", "user", "u", {"u": "u"})} AS a
            FROM best d JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.i)))
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, b.z.c AS cost, b.z.e AS audit, sha256(b.z.o) AS repaired_sha256
FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
