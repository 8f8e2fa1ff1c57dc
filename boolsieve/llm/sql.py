"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from boolsieve.llm import divergence, licenses, mixing, url_filter
from boolsieve.llm.decontaminate import WINDOW

#: Lower-cases A-Z alone.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(LOWER.format("text"))} AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), {WINDOW}) AS m,
        unnest([w[i : i + least(len(w), {WINDOW}) - 1] for i in range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)]) AS g
      FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS pos, w FROM d, lens WHERE len(w) >= m),
hits AS (SELECT DISTINCT x.r, x.pos, x.m, p.item FROM (SELECT r, m, pos, w[pos : pos + m - 1] AS g FROM g) x JOIN p ON p.m = x.m AND p.g = x.g),
covered AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(pos, pos + m)) AS word FROM (SELECT DISTINCT r, pos, m FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def mixing_sql(docs: str, weights: dict[str, float], size: float, columns: str, seed: int = mixing.SEED) -> str:
    """The rows of ``mixing.mix`` over the relation ``docs``."""
    weight = " ".join(f"WHEN source = '{k}' THEN {float(v)!r}" for k, v in weights.items())
    return f"""
WITH c AS (SELECT source, count(*) AS n, CASE {weight} ELSE 1.0 END::DOUBLE AS w FROM {docs} GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(w) AS w FROM c),
q AS (SELECT c.source, CAST({float(size)!r} AS DOUBLE) * t.n * c.w / t.w / c.n AS rate FROM c, t),
s AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {mixing.LARGEST_MEAN!r}) AS INTEGER)) AS draws, rate / greatest(1, CAST(ceil(rate / {mixing.LARGEST_MEAN!r}) AS INTEGER)) AS mean FROM q),
k AS (SELECT source, rate, draws, list_reduce([{{'c': exp(-mean), 'p': exp(-mean), 'all': [exp(-mean)], 'i': 0}}]
        || list_transform(range(1, {mixing._STEPS} + 1), lambda i: {{'c': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'all': []::DOUBLE[], 'i': i}}),
        lambda a, b: {{'c': a.c + a.p * mean / b.i, 'p': a.p * mean / b.i, 'all': list_append(a.all, a.c + a.p * mean / b.i), 'i': b.i}}).all AS cdf FROM s),
u AS (SELECT d.*, k.rate, CAST(list_sum(list_transform(CASE WHEN k.draws = 1 THEN ['{seed}:'] ELSE list_transform(range(1, k.draws + 1), lambda i: '{seed}/' || i || ':') END,
        lambda name: len(list_filter(k.cdf, lambda x: x <= CAST('0x' || substr(md5(name || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE / {float(1 << 52)!r})))) AS BIGINT) AS copies
      FROM {docs} d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
e AS (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM u)
SELECT {columns}, copy, rate, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key FROM e
"""




def _licenses_sql() -> str:
    per = []
    for t in licenses.BASE + licenses.NOTICES:
        n, k = len(t.words), len(t.key.split())
        listed = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        need = 1.0 if t.base else licenses.THRESHOLD
        where = "[s for s in range(0, len(w) - {m} + 1)]".format(m=n if t.base else t.key_at + k) if t.base else f"range(-{t.key_at}, greatest(len(w) - {t.key_at + k} + 1, -{t.key_at}))"
        key = f"w[s + {t.key_at + 1} : s + {t.key_at + k}] = {listed}[{t.key_at + 1} : {t.key_at + k}]"
        share = f"len(list_filter(range(1, {n + 1}), lambda j: s + j >= 1 AND s + j <= len(w) AND w[s + j] = {listed}[j]))::DOUBLE / {n}.0::DOUBLE"
        made = f"{{'label': '{t.label}', 'start': s, 'share': {share}, 'base': {str(t.base).lower()}}}"
        got = f"list_filter(list_transform(list_filter({where}, lambda s: s + {t.key_at} >= 0 AND {key}), lambda s: {made}), lambda m: m.share >= {need!r})"
        per.append(f"CASE WHEN {' AND '.join(f"list_contains(w, '{k}')" for k in t.key.split())} THEN {got} ELSE [] END")
    return f"""
WITH d AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
f AS (SELECT doc_id, w, {" || ".join(per)} AS found FROM d),
b AS (SELECT doc_id, len(w) AS n, found, list_filter(found, lambda m: m.base) AS base FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(base, lambda m: m.start)) AS BIGINT) AS first_word, CAST(list_max(list_transform(base, lambda m: m.start)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(base, lambda m: m.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda m: m.label))), ','), '') AS labels,
  coalesce(list_max(list_transform(found, lambda m: m.share)), 0.0)::DOUBLE AS score
FROM b
"""


def _urls_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = []
    for r in url_filter.BASE_RULES:
        host, _, path = r.name.partition("/")
        fits.append(f"SELECT u, '{r.name}' AS rule, '{r.verdict}' AS verdict FROM h WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')")
    own = " OR ".join(["host = ''", *[f"regexp_matches(host || path, '{r.pattern}')" for r in url_filter.OWN_RULES]])
    return f"""
WITH h AS (SELECT DISTINCT url AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS ({" UNION ALL ".join(fits)}),
best AS (SELECT u, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY u)
SELECT p.page_id, h.host, h.path, best.rule, CASE WHEN best.rule IS NOT NULL THEN best.verdict WHEN {own} THEN 'block' ELSE 'allow' END AS verdict
FROM pages p JOIN h ON p.url IS NOT DISTINCT FROM h.u LEFT JOIN best ON p.url = best.u
"""


_ESC = r"regexp_replace(regexp_replace({}, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*(/?INST|GEN)\])', '\1\\\2', 'g')"
_OP9 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + CASE WHEN role = 'assistant' THEN 12 ELSE 22 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_LETTERS = r"regexp_extract_all({}, '[^\x00-\x60\x7B-\x7F]+')"
_P = "(1 + CAST(1000000000 * (CAST({0} AS HUGEINT) + 2) // (CAST({1} AS HUGEINT) + 2 * v) AS BIGINT))"
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS.format(LOWER.format("text"))} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
n AS (SELECT lang, source, kept.term, coalesce(c, 0) AS c, lang_c, lang_n, v, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c, {_P.format("c", "n")} AS p, {_P.format("lang_c", "lang_n")} AS q FROM n),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(number: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", number, "text")) + ")"


#: CRC-32 of a decimal number, byte by byte with a table made of the reversed polynomial.
_CRC = """xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
  lambda c, b: xor(crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)))"""
_UP = "list_transform(range(0, (len({0}) + 1) // 2), lambda i: sha256({0}[2 * i + 1] || coalesce({0}[2 * i + 2], '')))"
_OP12 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b::UBIGINT] || repeat([0::UBIGINT], 8),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other FROM documents, crc),
placed AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(lang, l, hs) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL SELECT lang, l + 1, {_UP.format("hs")} FROM nodes WHERE len(hs) > 1),
subroots AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE len(hs) = 1),
top(l, hs) AS (SELECT 0, list(subroot ORDER BY place) FROM subroots UNION ALL SELECT l + 1, {_UP.format("hs")} FROM top WHERE len(hs) > 1),
levels AS (SELECT lang, list(hs ORDER BY l) AS ls FROM nodes WHERE len(hs) > 1 GROUP BY lang),
tops AS (SELECT coalesce(list(hs ORDER BY l) FILTER (len(hs) > 1), []) AS ls, max(hs[1]) FILTER (len(hs) = 1) AS root FROM top),
ways AS (SELECT p.*, subroot, root,
    list_transform(range(0, coalesce(len(w.ls), 0)), lambda l: {{'right': (p.pos >> l) & 1 = 1, 'side': w.ls[l + 1][xor(p.pos >> l, 1) + 1]}})
    || list_transform(range(0, len(tops.ls)), lambda l: {{'right': (s.place >> l) & 1 = 1, 'side': tops.ls[l + 1][xor(s.place >> l, 1) + 1]}}) AS way
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN levels w ON p.lang IS NOT DISTINCT FROM w.lang, tops),
folded AS (SELECT *, list_reduce([{{'right': false, 'side': coalesce(other, leaf)}}] || way, lambda h, x:
    {{'right': false, 'side': sha256(CASE WHEN x.side IS NULL THEN h.side WHEN x.right THEN x.side || h.side ELSE h.side || x.side END)}}).side AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_filter(list_transform(way, lambda x: x.side), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded
"""

_OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op4_licenses": _licenses_sql(),
    "op6_urls": _urls_sql(),
    "op8_decontaminate": _OP8,
    "op9_chat": _OP9,
    "op10_mix": mixing_sql("documents", mixing.WEIGHTS, mixing.SIZE, "doc_id, source, lang, n_chars, text"),
    "op11_divergence": _OP11,
    "op12_manifest": _OP12,
    "op13_topk": _OP13,
}
