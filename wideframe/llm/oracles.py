"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import decontaminate, lexical, mixing, secrets

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"

ORACLES["op9_repeats"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS g FROM starts),
low AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT doc_id, i FROM win JOIN low USING (g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(13) r(k)),
every AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op2_top_products"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

# Links of documents that share no shingle do not exist, so the join runs over shared shingles.
ORACLES["op6_near_duplicates"] = f"""
WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS.format(text="t")} AS ws FROM low),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN low_id USING (doc_id)"""

# Sizes of the readable form: three marks of 6, 6 and 7 signs a turn, and a backslash for every backslash and control string.
_CONTROLS = r"<turn>|<text>|</turn>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|### User:|### Assistant:|### System:"
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _CONTROLS + "'))"
_SAID = r"\### Assistant: </turn> ok"
ORACLES["op7_chat"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(19 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def _matches(kind: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """Spans of one kind: running sums over the gaps and matches of each text."""
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, {secrets.KINDS.index(kind)} AS rank, '{kind}' AS kind, stop - length(hit) AS start, stop FROM (
        SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
            SELECT doc_id, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i, unnest(regexp_extract_all(t, {p})) AS hit,
                   unnest(regexp_extract_all(t, {p}, {group})) AS value,
                   unnest(regexp_split_to_array(t, {p})[1:len(regexp_extract_all(t, {p}))]) AS gap FROM d)) WHERE {keep}"""


_OPAQUE = f"length(value) >= {secrets.LEAST_OPAQUE} AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"
_SPANS = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop), '')"
ORACLES["op3_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches("assign", secrets.ASSIGN, f"length(value) >= {secrets.LEAST_VALUE}", 1)} UNION ALL {_matches("access", secrets.ACCESS)}
    UNION ALL {_matches("hex", secrets.HEX)}),
weak AS ({_matches("identity", secrets.IDENTITY)} UNION ALL {_matches("opaque", secrets.OPAQUE.replace("*+", "*"), _OPAQUE)}
    UNION ALL {_matches("endpoint", secrets.ENDPOINT)}),
parts AS (SELECT *, CASE WHEN kind IN ('access', 'identity') THEN 'identity' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role
          FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (SELECT * FROM parts a WHERE kind IN ('identity', 'opaque', 'endpoint') AND EXISTS (
    SELECT 1 FROM parts b WHERE a.doc_id = b.doc_id AND b.start <= a.stop + {secrets.SCOPE} AND b.stop >= a.start - {secrets.SCOPE}
    AND (b.start >= a.stop OR b.stop <= a.start) AND (a.role = 'secret') <> (b.role = 'secret'))),
one AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, {_SPANS} AS spans FROM base GROUP BY doc_id),
every AS (SELECT doc_id, {_SPANS} AS spans FROM (SELECT doc_id, kind, start, rank, stop FROM base
          UNION ALL SELECT doc_id, kind, start, rank, stop FROM linked) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(one.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM d LEFT JOIN one USING (doc_id) LEFT JOIN every USING (doc_id)"""


_SIGN, _WORD, _CAPITAL, _JOINED, _LISTED, _NUMBER, _UNIT = range(7)


def _read(table: str, key: str) -> str:
    """The words of each text in each form, as ``{table}_words (id, form, ws)``: tokens with what lies before them, their kinds, and names put together."""
    d, pattern = decontaminate, _quoted(r"([^\p{L}\p{M}0-9%€$]*)([0-9]+(?:[.,:][0-9]+)*|[\p{L}\p{M}]+|[%€$])")
    signs = ", ".join(_quoted(x) for x in d.SIGNS)
    units = ", ".join(_quoted(x) for x in d.UNITS + d.SIGNS)
    return f"""
{table}_raw AS (SELECT row_number() OVER () AS r, {key} AS id, regexp_extract_all(coalesce(text, ''), {pattern}, 1) AS g, regexp_extract_all(coalesce(text, ''), {pattern}, 2) AS w
    FROM {table} WHERE {key} IS NOT NULL),
{table}_tokens AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS b FROM (SELECT r, id, unnest(range(1, len(w) + 1)) AS i, unnest(g) AS g, unnest(w) AS w FROM {table}_raw)),
{table}_kinds AS (SELECT r, id, i, lower(w) AS word, CASE WHEN regexp_matches(w, '^[0-9]') THEN {_NUMBER} WHEN regexp_matches(b, '^[0-9]') AND lower(w) IN ({units}) THEN {_UNIT}
    WHEN w IN ({signs}) THEN {_SIGN} WHEN regexp_matches(w, '^\\p{{Lu}}') AND g = ' ' AND regexp_matches(b, '^[\\p{{L}}\\p{{M}}]') THEN {_JOINED}
    WHEN regexp_matches(w, '^\\p{{Lu}}') AND (ends_with(g, ', ') OR ends_with(g, '; ')) THEN {_LISTED} WHEN regexp_matches(w, '^\\p{{Lu}}') THEN {_CAPITAL} ELSE {_WORD} END AS kind FROM {table}_tokens),
{table}_forms AS (SELECT *, CASE form WHEN {d.CONTEXT} THEN kind IN ({_JOINED}, {_LISTED}) WHEN {d.PLAIN} THEN false ELSE kind IN ({_CAPITAL}, {_JOINED}, {_LISTED}) END AS name
    FROM {table}_kinds, (VALUES ({d.CONTEXT}), ({d.PLAIN}), ({d.CAPITAL})) f(form)),
{table}_goes AS (SELECT *, name AND kind = {_JOINED} AND coalesce(lag(name) OVER (PARTITION BY r, form ORDER BY i), false) AS goes_on FROM {table}_forms),
{table}_chains AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY r, form ORDER BY i) AS c FROM {table}_goes WHERE kind <> {_SIGN}),
{table}_words AS (SELECT DISTINCT id, form, ws FROM (SELECT r, id, form, list(x ORDER BY c) AS ws FROM (
    SELECT r, id, form, c, CASE WHEN bool_or(kind = {_NUMBER}) THEN '«n:' WHEN bool_or(kind = {_UNIT}) THEN '«u:' WHEN bool_or(name) THEN '«e:' ELSE '' END || string_agg(word, ' ' ORDER BY i) AS x
    FROM {table}_chains GROUP BY r, id, form, c) GROUP BY r, id, form))"""


_TEMPLATE = "array_to_string(list_transform(w, lambda x: CASE WHEN starts_with(x, '«') THEN x[1:2] ELSE x END), ' ')"
_PLACE = "doc_id, item_id, form, shift"
ORACLES["op4_decontaminate"] = f"""
WITH {_read("benchmark", "item_id")}, {_read("documents", "doc_id")},
sized AS (SELECT id AS item_id, form, ws, least(len(ws), {decontaminate.WINDOW}) AS size FROM benchmark_words),
item_windows AS (SELECT item_id, form, size, need, pos, w AS iw, {_TEMPLATE} AS t FROM (
    SELECT item_id, form, size, least(len(ws) - size + 1, {decontaminate.RUN}) AS need, i - 1 AS pos, ws[i:i + size - 1] AS w FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM sized))),
doc_windows AS (SELECT doc_id, form, size, place, w AS dw, {_TEMPLATE} AS t FROM (
    SELECT doc_id, form, size, i - 1 AS place, ws[i:i + size - 1] AS w FROM (
        SELECT id AS doc_id, form, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS i FROM documents_words, (SELECT DISTINCT size FROM item_windows)))),
hits AS (SELECT DISTINCT doc_id, item_id, form, place - pos AS shift, pos, size, need, iw, dw FROM doc_windows JOIN item_windows USING (form, size, t)
    WHERE iw = dw OR len(list_filter(iw, lambda x: NOT starts_with(x, '«'))) >= {decontaminate.LITERAL} * size),
placed AS (SELECT {_PLACE}, pos, size, need, bool_or(iw = dw) AS own FROM hits GROUP BY ALL),
runs AS (SELECT {_PLACE}, a.pos, a.pos + a.need + a.size - 1 AS stop, bool_and(b.own) AS exact FROM placed a JOIN placed b USING ({_PLACE})
    WHERE b.pos BETWEEN a.pos AND a.pos + a.need - 1 GROUP BY {_PLACE}, a.pos, a.need, a.size HAVING count(*) = a.need),
slots AS (SELECT DISTINCT {_PLACE}, pos + k AS p, iw[k + 1] AS mine, dw[k + 1] AS theirs FROM (SELECT *, unnest(range(size)) AS k FROM hits) WHERE starts_with(iw[k + 1], '«')),
odd AS (SELECT {_PLACE}, a.p AS p0, b.p AS p FROM slots a JOIN slots b USING ({_PLACE}, mine) WHERE a.p < b.p AND a.theirs <> b.theirs),
kept AS (SELECT doc_id, item_id, max(CASE WHEN exact THEN 1 ELSE 0 END) AS exact FROM runs
    WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.doc_id = runs.doc_id AND odd.item_id = runs.item_id AND odd.form = runs.form AND odd.shift = runs.shift AND p0 >= runs.pos AND p < runs.stop)
    GROUP BY doc_id, item_id),
docs AS (SELECT doc_id, count(*) AS n_items, CAST(sum(exact) AS BIGINT) AS n_exact, string_agg(item_id, ',' ORDER BY item_id) AS items FROM kept GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(n_exact, 0) AS n_exact, coalesce(items, '') AS items
FROM documents LEFT JOIN docs USING (doc_id)"""


def _weight(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END" if weights else str(mixing.DEFAULT_WEIGHT)


def _level(depth: int) -> str:
    """The shares of one level of the tree, by running sums over siblings from the first to be full."""
    names, weights = mixing.TREE, (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})
    here, parent, child = ", ".join(names[:depth + 1]), ", ".join(names[:depth]), names[depth]
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CAST(capacity AS DOUBLE) / weight, {child}"
    budget = "(SELECT sum(tokens) * {0} // {1} FROM leaf)".format(*mixing.PART_OF_TOKENS) if not depth else "share"
    nodes = f"(SELECT {here}, sum(tokens) * {mixing.EPOCHS} AS capacity FROM leaf GROUP BY {here})"
    source = nodes if not depth else f"{nodes} JOIN (SELECT {parent}, share FROM level{depth - 1}) USING ({parent})"
    return f"""
a{depth} AS (SELECT {here}, capacity, {_weight(child, weights[depth])} AS weight, {budget} AS budget FROM {source}),
b{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
       sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM a{depth}),
c{depth} AS (SELECT *, capacity * open <= (budget - filled) * weight AS is_full FROM b{depth}),
e{depth} AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS rest,
       sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS whole,
       sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS run FROM c{depth}),
level{depth} AS (SELECT {here}, CASE WHEN is_full THEN capacity ELSE (rest * run) // whole - (rest * (run - weight)) // whole END AS share FROM e{depth})"""


_NUMBER = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
_DOMAIN = f"CASE WHEN {_NUMBER} = '' THEN 'other' ELSE {list(mixing.DOMAINS)}[CAST({_NUMBER} AS BIGINT) % {len(mixing.DOMAINS)} + 1] END"
ORACLES["op5_mixture"] = f"""
WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS tokens FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
{_level(0)}, {_level(1)}, {_level(2)},
plan AS (SELECT domain, lang, source, share // leaf.tokens AS whole, share % leaf.tokens AS rest FROM leaf JOIN level2 USING (domain, lang, source) WHERE share > 0),
r AS (SELECT d.*, whole, rest, md5('0:' || CAST(whole AS VARCHAR) || ':' || doc_id) AS h FROM d JOIN plan USING (domain, lang, source) WHERE tokens > 0),
t AS (SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest THEN 1 ELSE 0 END AS times FROM r)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM t"""

# CRC-32 bit by bit: a byte is mixed in, then eight shifts follow, each a step of the fold.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""
ORACLES["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {_CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT conv_id, pos, k, words FROM o JOIN c USING (conv_id) WHERE pos >= h
      UNION ALL SELECT c.conv_id, pos, k, words FROM c JOIN o ON o.conv_id = c.head WHERE pos < h),
s AS (SELECT c.conv_id, coalesce(list(k ORDER BY pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(words ORDER BY pos) FILTER (k IS NOT NULL), []) AS ws
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, ks[1:d] AS path, d, len(ks) AS n, coalesce(ws[d], 0) AS words FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                 sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sub AS (SELECT path[1:a] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub ON sub.path = f.path LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.path = f.path[1:f.d - 1]"""

_TERMS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + lexical.TERM + "')"
ORACLES["op12_lexical_search"] = f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM (SELECT doc_id, {_TERMS.format("text")} AS ts FROM documents WHERE doc_id IS NOT NULL) WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L FROM d),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(N_) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_) // L))))) AS BIGINT) AS score
      FROM asked JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
