"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import K, template_rows
from .mixing import QUANTUM
from .url_filter import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: The SQL unrolls the levels of the tree, which the operator goes down as far as the data do: paths of the checked tables are less deep.
SQL_LEVELS = 5


def _url_filter(max_children=16, min_share=0.05, min_labels=20, z_max=1.96, threshold=0.6, prior=10.0) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, a) for a, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in fits) + " END"
    ctes = [
        r"""m AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['a', 'b']) AS x FROM pages)""",
        f"""u AS (SELECT page_id, {_LOWER.format("x.a")} AS host, x.b AS path FROM m)""",
        rf"""p AS (SELECT page_id, host, path, {rule} AS rule, {action} AS action,
             regexp_replace(regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '[0-9A-Fa-f]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g') AS shape FROM u)""",
        """shapes AS (SELECT host, shape, string_split(shape, '/') AS parts, '' AS way, count(*) AS n, count(*) FILTER (action = 'block') AS block, count(*) FILTER (action = 'allow') AS allow FROM p GROUP BY host, shape)""",
    ]
    last = "shapes"
    for i in range(1, SQL_LEVELS + 1):
        ctes += [
            f"live{i} AS (SELECT *, parts[{i}] AS seg, coalesce(parts[{i + 1}], '') AS nxt FROM {last} WHERE len(parts) >= {i})",
            f"kinds{i} AS (SELECT host, way, seg, nxt, sum(n) AS n, sum(block) AS block, sum(allow) AS allow FROM live{i} GROUP BY ALL)",
            f"branch{i} AS (SELECT host, way, seg, sum(n) AS n, sum(block) AS block, sum(allow) AS allow, max({{'n': n, 'c': nxt}}).c AS commonest FROM kinds{i} GROUP BY host, way, seg)",
            f"stats{i} AS (SELECT host, way, count(*) AS children, sum(n) AS total, sum(block) AS pb, sum(allow) AS pa, max({{'n': n, 'c': commonest}}).c AS common FROM branch{i} GROUP BY host, way)",
            f"""rated{i} AS (SELECT *, block + allow AS own, pb + pa - block - allow AS rest, (block + 1.0::DOUBLE) / (block + allow + 2.0::DOUBLE) AS r1,
              (pb - block + 1.0::DOUBLE) / (pb + pa - block - allow + 2.0::DOUBLE) AS r2, (pb + 1.0::DOUBLE) / (pb + pa + 2.0::DOUBLE) AS pooled FROM branch{i} JOIN stats{i} USING (host, way))""",
            f"""gen{i} AS (SELECT host, way, seg, CASE WHEN seg <> '' AND ((children > {max_children} AND n < total * {min_share}::DOUBLE) OR (own >= {min_labels} AND rest >= {min_labels} AND commonest = common
              AND (r1 - r2) * (r1 - r2) / (pooled * (1 - pooled) * (1 / (own + 2.0::DOUBLE) + 1 / (rest + 2.0::DOUBLE))) < {z_max * z_max}::DOUBLE)) THEN '*' ELSE seg END AS name FROM rated{i})""",
            f"tree{i} AS (SELECT x.host, shape, parts, x.way || '/' || name AS way, n, block, allow FROM live{i} x JOIN gen{i} USING (host, way, seg) UNION ALL SELECT host, shape, parts, way, n, block, allow FROM {last} WHERE len(parts) < {i})",
        ]
        last = f"tree{i}"
    ctes += [
        f"hosts AS (SELECT shape, (sum(block) + {prior * 0.5}::DOUBLE) / (sum(block) + sum(allow) + {prior}::DOUBLE) AS prior FROM shapes GROUP BY shape)",
        f"tp AS (SELECT x.host, shape, way AS template, n, block, allow, prior FROM {last} x JOIN hosts USING (shape))",
        f"per AS (SELECT host, template, (sum(block) + {prior}::DOUBLE * (sum(round(prior * n, 9)::DECIMAL(38, 9))::DOUBLE / sum(n))) / (sum(block) + sum(allow) + {prior}::DOUBLE) AS purity FROM tp GROUP BY host, template)",
        f"verdicts AS (SELECT host, shape, template, CASE WHEN purity > {threshold}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM tp JOIN per USING (host, template))",
    ]
    return f"""WITH {', '.join(ctes)}
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN template END AS template, CASE WHEN rule IS NULL THEN v.verdict ELSE action END AS verdict
FROM p LEFT JOIN verdicts v USING (host, shape)"""


def _license_scan(min_cover=0.7, gap=3) -> str:
    rows = [f"({t}, {i}, '{' '.join(gram)}', {grams}, '{label}', {str(exact).lower()})" for t, i, *gram, grams, label, exact in template_rows()]
    return rf"""WITH grams(template, tpos, gram, grams, label, exact) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, w, unnest(range(len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K}),
votes AS (SELECT r, template, grams, label, exact, tpos, pos, pos - tpos AS diagonal FROM (SELECT r, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM g) JOIN grams USING (gram)),
places AS (SELECT r, label, diagonal AS first_word FROM votes WHERE exact GROUP BY r, template, grams, label, diagonal HAVING count(*) = grams),
near AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {gap} THEN 0 ELSE 1 END AS fresh FROM votes WHERE NOT exact),
clusters AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS cluster FROM near),
spans AS (SELECT r, label, count(DISTINCT tpos) / any_value(grams)::DOUBLE AS cover FROM clusters GROUP BY r, template, label, cluster HAVING cover >= {min_cover}::DOUBLE),
base AS (SELECT r, count(*) AS n, min(first_word) AS a, max(first_word) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY r),
every AS (SELECT r, label, 1.0::DOUBLE AS cover FROM places UNION ALL SELECT r, label, cover FROM spans),
sums AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM every GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(sums.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN sums USING (r)"""


_EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

# Targets by rounds of sharing (each round fixes the sources that are over their cap), and one running sum over all packets.
_MIX = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
share AS (
  SELECT 0 AS round, list({'source': source, 'n': n, 'weight': weight, 'target': NULL::DOUBLE} ORDER BY source NULLS LAST) AS all_, sum(n) * 1.5::DOUBLE AS budget FROM s
  UNION ALL
  SELECT round + 1, list_transform(all_, lambda x: {'source': x.source, 'n': x.n, 'weight': x.weight, 'target': CASE WHEN x.target IS NOT NULL THEN x.target
      WHEN 2.0::DOUBLE * x.n * list_sum(list_transform(list_filter(all_, lambda y: y.target IS NULL), lambda y: y.weight)) <= x.weight * (budget - coalesce(list_sum(list_transform(all_, lambda y: y.target)), 0)) THEN 2.0::DOUBLE * x.n END}), budget
  FROM share WHERE round <= (SELECT count(*) FROM s)),
fixed AS (SELECT all_, budget - coalesce(list_sum(list_transform(all_, lambda y: y.target)), 0) AS free, list_sum(list_transform(list_filter(all_, lambda y: y.target IS NULL), lambda y: y.weight)) AS weights FROM share ORDER BY round DESC LIMIT 1),
t AS (SELECT x.source AS source, x.n AS source_size, coalesce(x.target, free * x.weight / weights) AS target FROM (SELECT unnest(all_) AS x, free, weights FROM fixed)),
r AS (SELECT row_number() OVER () AS r, d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT r, source, target, least(QUANTUM, size - skip) AS words, before + epoch * source_size + least(skip + QUANTUM, size) AS finish_at FROM (SELECT *, unnest(range(0, size, QUANTUM)) AS skip FROM r) CROSS JOIN (VALUES (0), (1)) e(epoch)),
o AS (SELECT r, words, sum(words) OVER (ORDER BY finish_at / target, source NULLS LAST, finish_at ROWS UNBOUNDED PRECEDING) - words AS before FROM p),
got AS (SELECT r, sum(greatest(0, least(words, (SELECT floor(sum(size) * 1.5::DOUBLE) FROM d) - before)))::BIGINT AS taken FROM o GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN got USING (r)""".replace("QUANTUM", str(QUANTUM))

# Every kept term of every group, with zeros, by the definition of the distance.
_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, total, v FROM own JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM dense),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM dense GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

# Prefixes as lists of turns; a subtree is found by its members, without a walk.
_CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT), lambda v, x: list_reduce([xor(v, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda w, y: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384::UBIGINT) ELSE w >> 1 END)), 4294967295::UBIGINT)"
_TRIE = rf"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns FROM t GROUP BY c),
h AS (SELECT *, ({_CRC} % 6)::BIGINT AS h FROM l),
b AS (SELECT h.c, list_concat(coalesce(base.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN l base ON base.c = h.c - h.c % 100),
m AS (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM b),
p AS (SELECT c, d, len(turns) = d AS ends, coalesce(length(turns[d].text), 0) AS chars, min(c) OVER (PARTITION BY d, turns[1:d]) AS node FROM m),
n AS (SELECT node, d, count(*) AS n_convs, any_value(chars) AS chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM p GROUP BY node, d),
k AS (SELECT n.*, up.node AS parent FROM n LEFT JOIN p up ON up.c = n.node AND up.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM k GROUP BY ALL),
sub AS (SELECT p.node, p.d, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved FROM p JOIN n x ON x.node = p.c AND x.d >= p.d LEFT JOIN kids ON kids.node = x.node AND kids.d = x.d GROUP BY ALL)
SELECT k.node AS conv_id, k.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN sub USING (node, d) LEFT JOIN kids USING (node, d)"""


def oracles() -> dict[str, str]:
    return {"op1_url_filter": _url_filter(), "op4_exact_dedup": _EXACT_DEDUP, "op7_license_scan": _license_scan(), "op10_source_mix": _MIX, "op11_prefix_trie": _TRIE, "op12_source_divergence": _DIVERGENCE}
