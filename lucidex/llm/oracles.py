"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import decontaminate, fill_in_middle, filter_audit, hash_tree, merkle, quality, repeats

_SPACE = r"[\x20\x09-\x0D]+"


def op1() -> str:
    """Base counts by unnested windows; thresholds from the same log-linear buckets."""
    shift = f"greatest(length(bin(x)) - {quality.SUB_BITS + 1}, 0)"
    base = 2**quality.SUB_BITS
    def floor(b: str) -> str:
        at = f"(CASE WHEN {b} < {2 * base} THEN 0 ELSE {b} // {base} - 1 END)"
        return f"(({b} - {at} * {base})::BIGINT << {at})"

    q = lambda p: f"min(bucket) FILTER (WHERE upto * 1000 >= docs * {p})"
    some = lambda p: f"min(bucket) FILTER (WHERE bucket > 0 AND (upto - zero) * 1000 >= (docs - zero) * {p})"
    least = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.FLOOR.items()) + " END"
    fenced = ", ".join(f"'{k}'" for k in quality.FENCED)
    prior = quality.PRIOR * quality.WEIGHT

    return f"""
WITH w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win), (SELECT unnest(range({quality.WINDOW})) AS j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length FROM m),
long AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure, unnest([symbols, dup_lines, repeats, word_length]) AS x FROM f WHERE NOT base_failed),
sketch AS (SELECT lang, source, measure, CASE WHEN x < {base} THEN x ELSE {shift} * {base} + (x >> {shift}) END AS bucket, count(*) AS n FROM long GROUP BY ALL),
g AS (SELECT DISTINCT lang, source, measure FROM sketch),
l AS (SELECT lang, measure, bucket, {prior} * sum(n) // sum(sum(n)) OVER (PARTITION BY lang, measure) AS w FROM sketch GROUP BY lang, measure, bucket),
e AS (SELECT measure, bucket, {prior} * sum(n) // sum(sum(n)) OVER (PARTITION BY measure) AS w FROM sketch GROUP BY measure, bucket),
mix AS (SELECT lang, source, measure, bucket, sum(w) AS w FROM (SELECT lang, source, measure, bucket, n * {quality.WEIGHT} AS w FROM sketch
    UNION ALL SELECT g.lang, g.source, g.measure, l.bucket, l.w FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure
    UNION ALL SELECT g.lang, g.source, g.measure, e.bucket, e.w FROM g JOIN e ON g.measure = e.measure) GROUP BY ALL),
b AS (SELECT lang, source, measure, {q(250)} AS b25, {q(500)} AS b50, {q(750)} AS b75, {q(quality.TAIL)} AS bt, {some(100)} AS bf, {some(900)} AS bm, max(zero) * 1000 // max(docs) AS zeros
    FROM (SELECT lang, source, measure, bucket, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, measure) AS docs, coalesce(sum(w) FILTER (WHERE bucket = 0) OVER (PARTITION BY lang, source, measure), 0) AS zero FROM mix) GROUP BY ALL),
t AS (SELECT lang, source, measure, {floor('b25')} AS q25, {floor('(b50 + 1)')} - 1 AS q50, {floor('(b75 + 1)')} - 1 AS q75, {floor('(bt + 1)')} - 1 AS tail, {floor('bf')} AS few, {floor('(bm + 1)')} - 1 AS many, zeros FROM b),
h AS (SELECT lang, source, measure, greatest(CASE WHEN measure = 'symbols' AND zeros >= {quality.ZEROS} THEN coalesce(CASE WHEN many <= {quality.APART} * few THEN few // 2 ELSE floor(sqrt((few * many)::DOUBLE))::BIGINT END, 0) WHEN measure IN ({fenced}) THEN q75 + {quality.FENCE} * (q75 - q25) ELSE tail + (tail - q50) // 2 END, {least}) AS hi, q25 - {quality.FENCE} * (q75 - q25) AS lo FROM t),
lim AS (SELECT lang, source, max(hi) FILTER (WHERE measure = 'symbols') AS a, max(hi) FILTER (WHERE measure = 'dup_lines') AS b, max(hi) FILTER (WHERE measure = 'repeats') AS c, max(hi) FILTER (WHERE measure = 'word_length') AS d, max(lo) FILTER (WHERE measure = 'word_length') AS e FROM h GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(symbols > a OR dup_lines > b OR repeats > c OR word_length > d OR word_length < e, false) AS kept
FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source"""


def _descend(key: str, leaves: list[hash_tree.Leaf]) -> str:
    """The way down as nested choices: only the chosen child's own children draw."""
    tree = hash_tree.nodes(leaves)

    def below(node: int) -> str:
        children = tree[node]["children"]
        if not children:
            return str(tree[node]["shard"])
        draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5({key} || '{c['path']}'), 1, 13))::BIGINT + 1.0::DOUBLE) / {float(2**52)}::DOUBLE) / {c['weight']}::DOUBLE, 'n': {c['node']}}}" for c in children)
        return f"CASE list_min([{draws}]).n {' '.join(f'WHEN {c["node"]} THEN {below(c["node"])}' for c in children)} END"

    return below(0)


def op4(shards: int = 8) -> str:
    """The descent by md5 draws; the checksum by its own table, byte by byte."""
    table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    key = "key"
    return f"""
WITH t AS MATERIALIZED (SELECT {table} AS crc), d AS (SELECT doc_id, coalesce('k' || doc_id, 'null') AS key, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
b AS (SELECT doc_id, key, size, hex(encode(text)) AS h FROM d),
c AS (SELECT doc_id, key, size, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, {_descend(key, hash_tree.sized(shards))} AS shard, {_descend(key, hash_tree.sized(shards + 1))} AS grown_shard, md5(concat_ws('/', key, size, text_crc32)) AS hash FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY hash, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def op5() -> str:
    """Item windows joined with document windows of their length."""
    n = decontaminate.WINDOW
    words = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, w, least({n}, len(w)) AS k FROM (SELECT item_id, {words.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, p.k, i FROM p JOIN g ON p.k = g.k AND p.s = g.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""


def op9() -> str:
    """Every window as hex digits; all but the first of equal ones go."""
    n = repeats.LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * n})) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {n - 1})) AS p FROM d)),
x AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
r AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM (SELECT doc_id, p, sum(CASE WHEN p <= q + {n} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM x)) GROUP BY doc_id, island),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN from_hex(h) ELSE from_hex(array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN length(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '')) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def op11() -> str:
    """Trees by nested list functions; likeness by numbering equal nodes and joining them."""
    digits = merkle.DIGITS
    hashed = lambda level, content: f"substr(sha256('{level}' || {content}), 1, {digits})"
    leaf = f"list_transform(regexp_extract_all(p, '{merkle.LEAF}'), lambda l: {{'hash': {hashed('l', 'l')}, 'size': length(l)}})"
    joined = "array_to_string(list_transform({0}, lambda x: x.hash), '')"
    paragraph = f"list_transform(string_split(s, chr(10)), lambda p: {{'hash': {hashed('p', joined.format(leaf))}, 'leaves': {leaf}}})"
    section = f"list_transform(string_split(text, chr(10) || chr(10)), lambda s: {{'hash': {hashed('s', joined.format(paragraph))}, 'paragraphs': {paragraph}}})"
    change = lambda a, b: f"coalesce(list_filter(range(len({a})), lambda i: {a}[i + 1].hash IS DISTINCT FROM {b}[i + 1].hash)[1], len({a}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next_text FROM documents),
e AS (SELECT *, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next_text, (length(text) // 2)::BIGINT) AS edited FROM d),
x AS (SELECT doc_id, 'a' AS side, text FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', next_text FROM e),
t AS MATERIALIZED (SELECT doc_id, side, sections, sha256('d' || {joined.format('sections')}) AS root FROM (SELECT doc_id, side, {section} AS sections FROM x)),
n AS (SELECT doc_id, side, root AS hash, 1 AS size FROM t UNION ALL SELECT doc_id, side, s.hash, 1 FROM (SELECT doc_id, side, unnest(sections) AS s FROM t)
    UNION ALL SELECT doc_id, side, p.hash, 1 FROM (SELECT doc_id, side, unnest(s.paragraphs) AS p FROM (SELECT doc_id, side, unnest(sections) AS s FROM t))
    UNION ALL SELECT doc_id, side, l.hash, l.size FROM (SELECT doc_id, side, unnest(p.leaves) AS l FROM (SELECT doc_id, side, unnest(s.paragraphs) AS p FROM (SELECT doc_id, side, unnest(sections) AS s FROM t)))),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side, hash) AS k FROM n),
w AS (SELECT doc_id, side, sum(size) AS w FROM n GROUP BY ALL),
c AS (SELECT o.doc_id, o.side, sum(CASE WHEN s.hash IS NULL THEN 0 ELSE o.size END) AS common FROM m o LEFT JOIN (SELECT * FROM m WHERE side = 'a') s ON s.doc_id = o.doc_id AND s.hash = o.hash AND s.k = o.k WHERE o.side <> 'a' GROUP BY ALL),
r AS (SELECT c.doc_id, c.side, 2.0::DOUBLE * common / (o.w + s.w) AS near FROM c JOIN w o ON o.doc_id = c.doc_id AND o.side = c.side JOIN w s ON s.doc_id = c.doc_id AND s.side = 'a'),
g AS (SELECT a.doc_id, a.root AS fingerprint, b.root AS edited_fingerprint, a.sections AS x, b.sections AS y, CASE WHEN a.root <> b.root THEN {change('a.sections', 'b.sections')} END AS changed_section FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.side = 'a' AND b.side = 'b'),
h AS (SELECT doc_id, fingerprint, edited_fingerprint, changed_section, coalesce(x[changed_section + 1].paragraphs, []) AS x, coalesce(y[changed_section + 1].paragraphs, []) AS y FROM g)
SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, b.near AS near_edited, c.near AS near_next, changed_section, CASE WHEN changed_section IS NOT NULL THEN {change('x', 'y')} END AS changed_paragraph
FROM e JOIN h ON h.doc_id = e.doc_id JOIN r b ON b.doc_id = e.doc_id AND b.side = 'b' JOIN r c ON c.doc_id = e.doc_id AND c.side = 'c'"""


def op12() -> str:
    """Every document through every order and step."""
    a = filter_audit
    at = lambda k: f"v[ascii(substr(filter_order, {k}, 1)) - 64]"
    letters = [f"(SELECT unnest(['A','B','C','D','E']) AS {x})" for x in "pqrst"]
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < {a.MIN_WORDS}, 100 * len(list_distinct(w)) < {a.MIN_DISTINCT_PERCENT} * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {a.MAX_CAPITAL_PERCENT} * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS v FROM d LEFT JOIN l USING (doc_id)),
o AS (SELECT p || q || r || s || t AS filter_order FROM {', '.join(letters)} WHERE len(list_distinct([p, q, r, s, t])) = 5),
k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, good, toxic, filter_order, step, {at('step')} AS fails, len(list_filter(range(1, step), lambda i: {at('i')})) > 0 AS gone, len(list_filter(v, lambda y: y)) = 1 AS once FROM m, k),
g AS (SELECT part, filter_order, step, count(*) FILTER (WHERE NOT gone AND NOT fails) AS kept, count(*) FILTER (WHERE NOT gone AND fails) AS removed, count(*) FILTER (WHERE gone AND fails) AS redundant, count(*) FILTER (WHERE fails AND once) AS unique_fails,
    count(*) FILTER (WHERE NOT gone AND fails AND good = 1) AS good_lost, count(*) FILTER (WHERE NOT gone AND fails AND toxic = 1) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM g"""


def op13() -> str:
    """Lines cut at the drawn ranks and joined again."""
    m = fill_in_middle
    draw = lambda i: f"('0x' || substr(s, {1 + 8 * i}, 8))::BIGINT"
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{m.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, {draw(0)} AS a, {draw(1)} AS b, {draw(2)} AS c, {draw(3)} AS e, len(u) AS n FROM d),
r AS (SELECT doc_id, text, u, n, least(a % (n + 1), b % (n + 1)) AS i, greatest(a % (n + 1), b % (n + 1)) AS j, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR c % 100 >= {m.FIM_RATE} THEN 'plain' WHEN e % 100 < {m.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, {part(1, 'i')} AS p, {part('i + 1', 'j')} AS m, {part('j + 1', 'n')} AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
