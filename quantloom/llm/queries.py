"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import math

from .embedding_join import op8_embedding_near_dup
from .languages import op4_language_id, pages_language
from .licenses import PHRASES, TEMPLATES, THRESHOLD, op5_license_scan
from .media_copies import op9_media_copies
from .mixing import op2_source_mix
from .ngram_join import op6_ngram_jaccard_join
from .packing import op3_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .secrets import op1_secret_scan
from .spelling import op12_spelling_variants
from .token_files import op11_token_files
from .toxicity import op10_toxicity
from .url_filters import RULES, op7_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mix": op2_source_mix,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_embedding_near_dup": op8_embedding_near_dup,
    "op9_media_copies": op9_media_copies,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
    "pages_language": pages_language,
}

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    """Phrases by word positions and templates by lines, without any index."""
    text = lambda x: "'" + x + "'"
    phrases = ", ".join(f"([{', '.join(map(text, p.split()))}], {text(label)})" for p, label in PHRASES.items())
    templates = ", ".join(f"([{', '.join(map(text, sorted(set(t.split()))))}], {text(label)}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)})" for label, t in TEMPLATES)
    return f"""WITH t AS (SELECT doc_id, {_LOWER.format(x="coalesce(text, '')")} AS x FROM documents), w AS (SELECT doc_id, x, regexp_extract_all(x, '{_ALNUM}') AS ws FROM t),
     ph(p, label) AS (VALUES {phrases}), tm(tt, label, o) AS (VALUES {templates}),
     b AS (SELECT doc_id, label, i - 1 AS start FROM w, ph, range(1, len(ws) + 1) r(i) WHERE ws[i:i + len(p) - 1] = p),
     ln AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), '{_ALNUM}')) AS lw FROM w),
     f AS (SELECT doc_id, label, len(list_intersect(lw, tt)) / len(tt) AS c FROM ln, tm WHERE len(list_intersect(lw, tt)) >= o),
     bb AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
     al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM f) GROUP BY 1), fs AS (SELECT doc_id, max(c) AS c FROM f GROUP BY 1)
     SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score
     FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN fs USING (doc_id)"""


_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, range(1, greatest(len(ws) - 4, 1) + 1) r(i) WHERE len(ws) > 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
 r AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.comp) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2"""


def _url_sql() -> str:
    """Rules and variants of a URL; the pages given hold no canonical links or redirects, so there are no others."""
    rule, name = "CASE", "CASE"
    for verdict, host, prefix in sorted(RULES, key=lambda x: -len(x[1]) - len(x[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{prefix}')"
        rule, name = f"{rule} WHEN {fits} THEN '{verdict}'", f"{name} WHEN {fits} THEN '{host}{prefix}'"
    return f"""WITH h AS (SELECT page_id, url, {_LOWER.format(x="coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
     r AS (SELECT *, {rule} END AS v, {name} END AS rule, regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS q FROM h),
     k AS (SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '(/index\\.html?|/)+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS node FROM r),
     g AS (SELECT node, bool_or(v = 'block') AS b, bool_or(v = 'allow') AS a FROM k WHERE v IS NOT NULL AND node IS NOT NULL GROUP BY 1)
     SELECT page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(b, false) AND NOT coalesce(a, false) THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN g USING (node)"""


# crc32 by its table, which is made from the polynomial
_CRC_TABLE = "tb AS (SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb)"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295)"

# near words share the word with one place left open, or are it with one letter less
_SPELLING_SQL = f"""WITH RECURSIVE {_CRC_TABLE},
 r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents), d AS (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 7 GROUP BY 1, 2),
 s AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM d),
 h AS (SELECT r, n, {_CRC} AS h FROM s, tb),
 v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM h) WHERE length(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 o AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM v, range(1, length(word) + 1) t(i)),
 e AS (SELECT a.word, b.word AS other, b.n FROM o a JOIN o b ON a.k = b.k WHERE a.word <> b.word UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.c UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.c),
 b AS (SELECT word, count(*) AS n_near, max(n) AS most FROM e GROUP BY 1), g AS (SELECT e.word, min(other) AS other FROM e JOIN b ON b.word = e.word AND e.n = most GROUP BY 1),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN g.other END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN b USING (word) LEFT JOIN g USING (word)),
 c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f z ON z.word = c.root WHERE z.form IS NULL"""

# all pairs of equal words of a text at most a quarter of it apart; those of one distance that follow each other are a run
_RUNS_SQL = f"""WITH {_CRC_TABLE}, t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents), h AS (SELECT id, doc_id, w, len(w) AS n, {_CRC} AS h FROM t, tb),
 a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h), p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a), d AS (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
 e AS (SELECT id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d), s AS (SELECT x.id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
 g AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS g FROM s), l AS (SELECT id, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY id, q, g), r AS (SELECT id, s, l, min(q) AS q FROM l WHERE l >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
 o AS (SELECT DISTINCT id, unnest(range(s + q, s + l)) AS i FROM r), c AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS c FROM e ANTI JOIN o USING (id, i) GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l / q DESC, s, q) AS place FROM r),
 z AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS f FROM r GROUP BY 1)
 SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(f, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256 FROM d LEFT JOIN z USING (id) LEFT JOIN b ON b.id = d.id AND place = 1 LEFT JOIN c ON c.id = d.id"""

# all pairs of a label
_EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
 r AS (SELECT vec_id AS node, vec_id AS comp FROM v UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node), n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1), c AS (SELECT node AS vec_id, min(comp) AS component_id FROM r GROUP BY 1)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)"""


ORACLES: dict[str, str] = {
    "op5_license_scan": " ".join(_license_sql().split()),
    "op6_ngram_jaccard_join": " ".join(_JACCARD_SQL.split()),
    "op7_url_filter": " ".join(_url_sql().split()),
    "op8_embedding_near_dup": " ".join(_EMBEDDING_SQL.split()),
    "op12_spelling_variants": " ".join(_SPELLING_SQL.split()),
    "op13_periodic_runs": " ".join(_RUNS_SQL.split()),
}
