"""The same results in DuckDB SQL, for the operators SQL can express. Methods differ on purpose: windows are compared as text."""

from __future__ import annotations

from pressline.llm import chat, decontaminate, licenses, merkle, quality, secrets, spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    """Runs of digits, letters and characters beyond ASCII of a lower-cased text."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licenses_sql(templates: tuple[licenses.Template, ...] = licenses.TEMPLATES) -> str:
    rows = []
    for t, template in enumerate(templates):
        own = [w.decode() for w in licenses.words(template.text)]
        need = licenses.Index.of((template,), {}).need[0]
        listed = ", ".join(map(quoted, own))
        rows.append(f"({t}, {quoted(template.label)}, {str(template.exact).lower()}, {need}, {len(set(own))}, [{listed}])")
    return rf"""
WITH templates(t, label, exact, need, n, seq) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {_words("text")} AS words FROM documents),
wp AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM d),
members AS (SELECT t, unnest(list_distinct(seq)) AS w FROM templates),
hits AS (SELECT doc_id, t, wp.w, p // {licenses.STRIDE} AS b FROM wp JOIN members USING (w)),
blocks AS (
  SELECT DISTINCT doc_id, t, w, unnest([b, b - 1]) AS b FROM hits
),
shares AS (
  SELECT doc_id, t, count(DISTINCT w) AS c FROM blocks WHERE b >= 0 GROUP BY doc_id, t, b
),
places AS (
  SELECT wp.doc_id, t, p FROM wp JOIN templates ON exact AND wp.w = seq[1] JOIN d USING (doc_id)
  WHERE words[p + 1 : p + len(seq)] = seq
),
found AS (
  SELECT doc_id, label, c / n AS share, false AS base FROM shares JOIN templates USING (t) WHERE NOT exact AND c >= need
  UNION ALL SELECT doc_id, label, 1.0, true FROM places JOIN templates USING (t)
),
f AS (
  SELECT doc_id, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM found GROUP BY doc_id
),
c AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b FROM places GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_base, c.a::BIGINT AS first_word, c.b::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    names = ("few", "repeats", "symbols", "lines")
    priors = ", ".join(
        f"(sum({x}) + 0.5) / (sum(n) + 1) AS m_{x}, (sum(({x} / n) ** 2) - sum({x} / n) ** 2 / count(*)) / (count(*) - 1) AS v_{x}"
        for x in names
    )
    strengths = ", ".join(
        f"CASE WHEN v_{x} - m_{x} * (1 - m_{x}) * inv / k > 0 THEN least(1e4, greatest(2.0, "
        f"m_{x} * (1 - m_{x}) / (v_{x} - m_{x} * (1 - m_{x}) * inv / k) - 1)) ELSE 1e4 END AS s_{x}" for x in names
    )
    worst = ", ".join(f"({x} + m_{x} * s_{x}) / (n + s_{x})" for x in names)
    w = quality.WINDOW
    return rf"""
WITH d AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {w - 2})) AS i FROM d WHERE len(words) >= {w}),
wins AS (SELECT doc_id, i, array_to_string(words[i : i + {w - 1}], ' ') AS x FROM starts),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {w})) AS p FROM twice) GROUP BY doc_id),
c AS (
  SELECT doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
),
r AS (
  SELECT *, n_words < {limits.least_words} AS few, 100 * n_repeat_words > {limits.most_repeat_percent} * n_words AS repeats,
    100 * n_symbols > {limits.most_symbols_percent} * word_chars AS symbols, 100 * n_dup_lines > {limits.most_dup_lines_percent} * n_lines AS lines
  FROM c
),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({x}) AS {x}" for x in names)} FROM r GROUP BY source),
p AS (SELECT count(*) AS k, sum(1 / n) AS inv, {priors} FROM h),
q AS (SELECT *, {strengths} FROM p),
bad AS (SELECT source, greatest({worst}) >= {limits.host_rate} AS bad FROM h, q)
SELECT r.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
  few OR repeats AS base_failed, NOT (few OR repeats OR bad) AS kept
FROM r JOIN bad ON r.source IS NOT DISTINCT FROM bad.source
"""


def urls_sql(rules: list[tuple[str, str, str]]) -> str:
    """The rules of the pages' own URLs; no given page names an alias, so groups decide nothing in them."""
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    return rf"""
WITH rules(verdict, host, path) AS (VALUES {rows}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
m AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


def decontaminate_sql() -> str:
    w = decontaminate.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, {_words("text")} AS words FROM documents),
b AS (SELECT item_id, {_words("text")} AS words FROM benchmark),
s AS (SELECT item_id, words, least(len(words), {w}) AS k FROM b WHERE len(words) > 0),
wins AS (SELECT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM s)),
dw AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM s) WHERE len(words) >= k),
m AS (
  SELECT doc_id, i, dw.k, item_id FROM (SELECT *, array_to_string(words[i : i + k - 1], ' ') AS x FROM dw) dw
  JOIN wins ON wins.k = dw.k AND wins.x = dw.x
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def warc_sql() -> str:
    return r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
c AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM c
"""


def chat_sql() -> str:
    def escaped(c: str) -> str:
        return rf"regexp_replace(regexp_replace(replace({c}, '\', '\\'), '(<)(\||/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')"

    marks = len(chat.TEXT) + len(chat.END)
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
a AS (
  SELECT *, row_number() OVER o - 1 AS idx, coalesce(sum(ceil(strlen(text) / 4) + 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
w AS (SELECT *, floor(before / {chat.STRETCH}) AS win, length({escaped("role")}) + length({escaped("text")}) + {marks} AS size FROM a),
s AS (
  SELECT conv_id, win, lead(win) OVER o AS nxt, lead(start) OVER o AS next_start, count(*) OVER (PARTITION BY conv_id) - 1 AS more
  FROM (SELECT conv_id, win, min(before) AS start FROM w GROUP BY conv_id, win) WINDOW o AS (PARTITION BY conv_id ORDER BY win)
),
n AS (
  SELECT conv_id, role, text, turn, size + {len(chat.TURN)} + (size + {len(chat.AGAIN)}) * CASE
    WHEN idx = 0 AND role = 'system' THEN more
    WHEN nxt IS NOT NULL AND next_start - before <= {chat.HISTORY} THEN 1 ELSE 0 END AS chars
  FROM w JOIN s USING (conv_id, win)
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM n GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM g
"""


# The table of the CRC-32 by bytes, from its polynomial.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text below U+0100 in UTF-8; ``crc`` is the table above."""
    codes = f"""flatten(list_transform(string_split({text}, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [194 + (unicode(x)::BIGINT >> 6 & 1), 128 + (unicode(x)::BIGINT & 63)] END))"""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def spelling_sql() -> str:
    return rf"""
WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL
),
h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, t WHERE length(run) >= {spelling.MIN_LENGTH}),
v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {spelling.DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word
    FROM h
  ) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT x.word, v.word AS near, v.n AS near_n FROM x JOIN v ON x.less = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
),
j AS (
  SELECT v.word, CASE WHEN near_n >= {spelling.RATIO} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= {spelling.RATIO} * n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)
),
chain(word, root, form) AS (
  SELECT word, word, form FROM j UNION ALL SELECT chain.word, j.word, j.form FROM chain JOIN j ON chain.form = j.word
)
SELECT j.word, j.form, root, n, n_near::BIGINT AS n_near, form_n FROM j JOIN chain ON chain.word = j.word AND chain.form IS NULL
"""


def merkle_sql() -> str:
    k = merkle.FANOUT

    def leaf(text: str) -> str:
        parts = [text if c == "text" else c for c in merkle.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in parts) + ")"

    def grown(lists: str) -> str:
        """Lists of digests level by level, ending with one."""
        return f"""SELECT tree, 0 AS level, l FROM {lists} UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(l), {k}), lambda i: sha256(array_to_string(l[i + 1 : i + {k}], ''))) FROM up WHERE len(l) > 1"""

    def siblings(i: str) -> str:
        return f"""coalesce(array_to_string(l[{i} - {i} % {k} + 1 : {i}], ''), '') AS before,
    coalesce(array_to_string(l[{i} + 2 : {i} - {i} % {k} + {k}], ''), '') AS after"""

    return rf"""
WITH RECURSIVE t AS ({CRC_TABLE}),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS now
  FROM documents, t
),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
lists AS (SELECT tree, list(leaf ORDER BY r) AS l FROM l GROUP BY tree),
up AS ({grown("lists")}),
s AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS r FROM up WHERE len(l) = 1),
s_list AS (SELECT '' AS tree, list(subroot ORDER BY r) AS l FROM s),
s_up AS ({grown("s_list").replace("FROM up", "FROM s_up")}),
steps AS (
  SELECT tree, r, level, {siblings(f"(r // pow({k}, level)::BIGINT)")} FROM l JOIN up USING (tree) WHERE len(up.l) > 1
  UNION ALL
  SELECT l.tree, l.r, 1000 + level, {siblings(f"(s.r // pow({k}, level)::BIGINT)")} FROM l JOIN s USING (tree), s_up WHERE len(s_up.l) > 1
),
path AS (SELECT tree, r, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a FROM steps GROUP BY tree, r),
fold(tree, r, i, acc) AS (
  SELECT tree, r, 0, now FROM l
  UNION ALL SELECT tree, r, i + 1, sha256(b[i + 1] || acc || a[i + 1]) FROM fold JOIN path USING (tree, r) WHERE i < len(b)
),
top AS (SELECT l[1] AS root FROM s_up WHERE len(l) = 1)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(array_to_string(list_transform(range(len(b)), lambda i: b[i + 1] || a[i + 1]), ''), '')) AS proof_sha256,
  acc AS folded_root, acc = root AS verified
FROM l JOIN s USING (tree) LEFT JOIN path ON path.tree = l.tree AND path.r = l.r
JOIN fold ON fold.tree = l.tree AND fold.r = l.r AND fold.i = coalesce(len(b), 0), top
"""


def secrets_sql() -> str:
    parts = []
    for number, kind in enumerate(secrets.KINDS):
        pattern = quoted(kind.pattern)
        parts.append(rf"""SELECT *, {number} AS kind, length(val) >= {kind.least} AND length(regexp_replace(val, '[^0-9]', '', 'g')) >= {kind.digits}
    AND len(list_distinct(string_split(val, ''))) >= {kind.varied} AS wanted FROM (
    SELECT doc_id, source, lang, unnest(m) AS said, unnest(regexp_extract_all(text, {pattern}, {kind.value})) AS val,
      unnest(regexp_split_to_array(text, {pattern})[: len(m)]) AS piece, generate_subscripts(m, 1) AS nr
    FROM (SELECT doc_id, source, lang, text, regexp_extract_all(text, {pattern}) AS m FROM documents WHERE regexp_matches(text, {pattern})))""")
    names = ", ".join(quoted(kind.name) for kind in secrets.KINDS)
    wider = ", ".join(map(str, secrets.WIDER))
    counts = ", ".join(
        f"count(*) FILTER (kind = {i}) AS n_{kind.name}" for i, kind in enumerate(secrets.KINDS) if kind.base
    )
    return rf"""
WITH f AS ({" UNION ALL ".join(parts)}),
p AS (
  SELECT *, sum(length(piece) + length(said)) OVER (PARTITION BY doc_id, kind ORDER BY nr) AS "end" FROM f
),
c AS (SELECT doc_id, source, lang, kind, val, "end" - length(said) AS start, "end" FROM p WHERE wanted),
kept AS (
  SELECT * FROM c WHERE kind NOT IN ({wider}) OR NOT EXISTS (
    SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind < c.kind AND b.start < c."end" AND c.start < b."end")
),
o AS (SELECT val, count(DISTINCT coalesce('=' || source, '')) AS owners FROM kept GROUP BY val),
j AS (
  SELECT doc_id, kind, start, owners, [{names}][kind + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT AS span
  FROM kept JOIN o USING (val) WHERE kind NOT IN ({wider}) OR owners = 1
),
g AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, kind) FILTER (kind NOT IN ({wider})) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {secrets.COPIED_OWNERS}) AS n_copied
  FROM j GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in ("assign", "access", "hex", "live", "copied"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
