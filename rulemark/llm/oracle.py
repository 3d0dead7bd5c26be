"""DuckDB twins that are long."""

from __future__ import annotations

from rulemark.llm.quality_rules import BOILERPLATE
from rulemark.llm.url_filter import LISTED_WORDS

QUALITY_RULES = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
    x AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
    g AS (SELECT rid, i, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
    r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL),
    c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY 1),
    l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
    m AS (
        SELECT rid, line, length(line) AS size, regexp_replace(line, '[^!#*$%&|<>{}~\^\\]+', '', 'g') AS s,
            list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l
    ), k AS (
        SELECT *, len(w) AS n, length(s) - length(replace(s, '|', '')) AS bars, length(s) - length(replace(s, '!', '')) AS marks FROM m WHERE len(w) > 0
    ), v AS (
        SELECT rid, line, size, regexp_matches(right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1), '[.!?:;,"''\)\]…。」！？»”’]')
            AND NOT (bars >= 2 AND bars * 100 >= n * 20) AND NOT ((length(s) - marks) * 100 > size * 10) AND NOT (marks >= 3 AND marks * 100 >= n * 30)
            AND NOT (n >= 10 AND len(list_distinct(w)) * 100 < n * 35) AND NOT (n <= 12 AND regexp_matches(lower(line), '@phrases@')) AS good FROM k
    ), s AS (
        SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(size) AS total, coalesce(sum(size) FILTER (good), 0) AS kept_chars, count(*) FILTER (NOT good) AS removed FROM v GROUP BY 1
    ), f AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(total, 0) AS BIGINT) AS total,
            CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed
        FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= total * 50 AS kept, kept_chars, n_lines_removed FROM f
""".replace("@phrases@", "|".join(BOILERPLATE))

#: The table of the CRC-32 checksum, and the checksum of bytes given as a list of numbers.
CRC_TABLE = """crc_step(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_step WHERE k = 8)"""
CRC = "xor(4294967295, list_reduce(list_concat([4294967295], @bytes@), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])))"
BYTES = "list_transform(range(0, CAST(length(hex(encode(@text@))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(@text@)), 2 * i + 1, 2) AS BIGINT))"


def crc(text: str) -> str:
    return CRC.replace("@bytes@", BYTES.replace("@text@", text))


LOWER = "translate(@, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = f"""
    WITH r AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT rid, page_id, {LOWER.replace("@", "regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    l AS (SELECT *, string_split(host, '.') AS labels FROM p),
    k AS (SELECT DISTINCT rid, unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')), [host || path])) AS key FROM l WHERE host <> ''),
    listed AS (SELECT DISTINCT key FROM k WHERE list_has_any(regexp_split_to_array({LOWER.replace("@", "key")}, '[^a-z0-9]+'), {list(LISTED_WORDS)})),
    hit AS (SELECT DISTINCT rid FROM k SEMI JOIN listed USING (key)),
    rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    fit AS (SELECT rid, max_by(rhost || rpath, length(rhost || rpath)) AS "rule", max_by(verdict, length(rhost || rpath)) AS verdict FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
    SELECT page_id, host, path, "rule", coalesce(verdict, CASE WHEN hit.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fit USING (rid) LEFT JOIN hit USING (rid)
"""

IMPORTANCE = rf"""
    WITH RECURSIVE {CRC_TABLE}, d AS (SELECT row_number() OVER () AS rid, doc_id, {LOWER.replace("@", "coalesce(text, '')")} AS t FROM documents),
    w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
    f AS (SELECT rid, unnest(w) AS word FROM w),
    g AS (SELECT unnest(regexp_extract_all({LOWER.replace("@", "coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    v AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM f UNION ALL SELECT word, 0, 1 FROM g) GROUP BY 1),
    h AS (SELECT word, s, t, {crc("word")} % 10000 AS bucket FROM v, crc_table),
    n AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS ns, CAST(coalesce(sum(t), 0) AS DOUBLE) AS nt FROM v),
    b AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM h GROUP BY 1),
    gains AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1) * (ns + 10000) / ((s + 1) * (nt + 10000)))) AS BIGINT) AS gain FROM b, n),
    m AS (SELECT rid, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS mean FROM f JOIN h USING (word) JOIN gains USING (bucket) GROUP BY 1),
    c AS (SELECT rid, w.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(mean, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (rid)),
    s AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM c),
    o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS nth, count(*) OVER () AS total FROM s WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * total // 100 THEN nth END AS rank FROM s LEFT JOIN o USING (rid)
"""


def _least(*options: str) -> str:
    """The least of candidate (cost, audit) structs, nulls left out."""
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _plus(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"


def _layer() -> str:
    """One turn from states x0 to x3: first the edits of the turn, then the insertions in order of the states they lead to."""
    drop = lambda s: _plus(s, "4", "D")
    keep = lambda s, i: _plus(s, "extra", "K", f"live AND initial = '{i}'")
    role = lambda s: _plus(s, "3 + extra", "R", "live")
    return f"""m AS (SELECT conv, i, {drop("x0")} AS y0, {_least(drop("x1"), keep("x0", "s"))} AS y1,
            {_least(drop("x2"), *(f(s, "u") if f is keep else f(s) for s in ("x0", "x1", "x3") for f in (keep, role)))} AS y2, {_least(drop("x3"), keep("x2", "a"), role("x2"))} AS y3 FROM j)"""


CONVERSATIONS = rf"""
    WITH RECURSIVE {CRC_TABLE}, r AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
    ), x AS (SELECT *, {crc("key")} % 20 AS kind FROM r, crc_table),
    d AS (
        SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM x WHERE kind <> 0
    ), o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    e AS (SELECT *, substr(role, 1, 1) AS initial, regexp_replace(text, '[ 	-
]+$', '') AS solid, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM o),
    f AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
    t AS (SELECT conv, i, role, text, initial, fault NOT IN ('blank', 'duplicate') AS live, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
    walk AS (
        SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS x0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS x1, {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS x2, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS x3 FROM t
        UNION ALL
        (WITH j AS (SELECT walk.conv, t.i, initial, live, extra, x0, x1, x2, x3 FROM walk JOIN t ON t.conv = walk.conv AND t.i = walk.i + 1), {_layer()},
        n AS (SELECT conv, i, y0, y1, y3 AS z3, {_least("y2", _plus("y0", "3", "I"), _plus("y1", "3", "I"), _plus("y3", "3", "I"))} AS z2 FROM m)
        SELECT conv, i, y0, y1, z2, {_least("z3", _plus("z2", "3", "I"))} FROM n)
    ), best AS (
        SELECT conv, {_least("x0", "x3")} AS b FROM walk QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1
    ), edits AS (SELECT conv, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS p FROM best),
    placed AS (SELECT conv, p, substr(audit, p, 1) AS edit, p - length(regexp_replace(substr(audit, 1, p), '[^I]', '', 'g')) AS i FROM edits),
    left_ AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY p) AS k FROM placed WHERE edit <> 'D'),
    named AS (SELECT left_.conv, k, edit, role, text, max(CASE WHEN k = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY left_.conv) AS shift FROM left_ LEFT JOIN t ON t.conv = left_.conv AND t.i = left_.i),
    body AS (
        SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM named GROUP BY 1
    ), counts AS (
        SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.b.c, 0) AS cost, coalesce(best.b.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations) AS c LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN body USING (conv)
"""
