"""DuckDB SQL twins of the queries that SQL can express: plain definitions, without
any of the methods of the operators.

The others have none: packed ids and token counts need a vocabulary file, XXH64 isn't a
DuckDB function (SimHash, the order of the mix), fitted models and HTML trees aren't SQL;
tests/llm compares those with brute-force versions."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: Every window of every item looked up at every place of every document.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
items AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
                  FROM items WHERE len(w) > 0)),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM d JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (g, n)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
           FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""

#: All cosines.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          AND list_inner_product(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)"""


def _url_filter(depth: int = 8) -> str:
    # the given paths have five segments at most
    host = f"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}')"
    path = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    ctes = [
        f"u AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages)",
        "numbers AS (SELECT DISTINCT url, host, path, TRY_CAST(regexp_extract(url, "
        "'/(\\d+)(?:/|\\.html)?(?:[?#]|$)', 1) AS BIGINT) AS doc_id FROM u)",
        "marks AS (SELECT host, path, count(*) AS l, sum(bad) AS b FROM (SELECT host, path, CASE WHEN quality = 0 OR toxic = 1 "
        "THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM numbers JOIN labels USING (doc_id)) "
        "WHERE bad IS NOT NULL GROUP BY host, path)",
        "p0 AS (SELECT host, path, n, coalesce(l, 0) AS l, coalesce(b, 0) AS b, string_split(path, '/')[2:] AS s, '' AS t "
        "FROM (SELECT host, path, count(*) AS n FROM u GROUP BY host, path) LEFT JOIN marks USING (host, path))"]
    for d in range(depth):
        ctes += [
            f"c{d} AS (SELECT host, t, s[{d + 1}] AS seg, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM p{d} WHERE len(s) > {d} GROUP BY 1, 2, 3)",
            f"v{d} AS (SELECT *, CASE WHEN regexp_matches(seg, '[0-9]') THEN kids > 1 ELSE kids >= 8 AND n < 0.05 * total END AS variable "
            f"FROM (SELECT *, sum(n) OVER (PARTITION BY host, t) AS total, count(*) OVER (PARTITION BY host, t) AS kids FROM c{d}))",
            f"w{d} AS (SELECT *, CASE WHEN variable THEN '{{' || regexp_replace(regexp_replace(seg, '[0-9]+', '0', 'g'), "
            "'[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 'a', 'g') || '}' END AS shape, variable AND l > 0 AS tested "
            f"FROM v{d})",
            f"x{d} AS (SELECT *, count(*) FILTER (tested) OVER g AS m, sum(l) FILTER (tested) OVER g AS wl, sum(b) FILTER (tested) OVER g AS wb "
            f"FROM w{d} WINDOW g AS (PARTITION BY host, t, shape))",
            # twice the log likelihood ratio
            f"y{d} AS (SELECT *, tested AND m > 1 AND wb > 0 AND wb < wl AND 2 * (CASE WHEN b > 0 THEN b * ln(b / l * wl / wb) ELSE 0 END + "
            f"CASE WHEN l > b THEN (l - b) * ln((l - b) / l * wl / (wl - wb)) ELSE 0 END) > 4 + 2 * ln(m) AS own FROM x{d})",
            f"t{d} AS (SELECT host, t, seg, CASE WHEN own THEN seg WHEN variable THEN shape WHEN l > 0 AND abs(b - rate * l) > "
            "2 * sqrt(rate * (1 - rate) * l) THEN seg ELSE '+' END AS token FROM (SELECT *, "
            "CASE WHEN sum(l) FILTER (NOT variable) OVER (PARTITION BY host, t) > 0 THEN "
            "sum(b) FILTER (NOT variable) OVER (PARTITION BY host, t) / sum(l) FILTER (NOT variable) OVER (PARTITION BY host, t) END AS rate "
            f"FROM y{d}))",
            f"p{d + 1} AS (SELECT p.host, p.path, p.n, p.l, p.b, p.s, p.t || coalesce('/' || token, '') AS t FROM p{d} p "
            f"LEFT JOIN t{d} ON t{d}.host = p.host AND t{d}.t = p.t AND t{d}.seg = p.s[{d + 1}])"]
    ctes += [
        f"shaped AS (SELECT host, path, l, b, CASE WHEN len(s) > {depth} THEN t || '/**' ELSE t END AS template FROM p{depth})",
        "prior AS (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(l), 0) + 2) AS p FROM p0)",
        "hosts AS (SELECT host, (sum(b) + 4 * any_value(p)) / (sum(l) + 4) AS p FROM shaped, prior GROUP BY host)",
        "pure AS (SELECT host, template, (sum(b) + 4 * any_value(p)) / (sum(l) + 4) AS purity FROM shaped JOIN hosts USING (host) "
        "GROUP BY host, template)"]

    def fits(h: str, p: str) -> str:
        return f"(u.host = '{h}' OR ends_with(u.host, '.{h}')) AND starts_with(u.path, '{p}')"

    # longest first
    rules = [("example.com/de/", fits("example.com", "/de/"), "block"), ("example.net/en/", fits("example.net", "/en/"), "allow"),
             ("org/fr/", fits("org", "/fr/"), "allow"), ("net/", fits("net", "/"), "block")]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, c, _ in rules)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for _, c, v in rules)
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT page_id, u.host, u.path, CASE {rule} END AS rule, template, "
            f"round(purity, 9) AS purity, CASE {verdict} WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict "
            "FROM u JOIN shaped USING (host, path) JOIN pure USING (host, template)")


#: Every kept term of every pair of groups, in 128-bit whole numbers.
SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0)::HUGEINT + v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n::HUGEINT + v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
          FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
               FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 200"""

ORACLE: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op9_embedding_dedup": EMBEDDING_DEDUP,
    "op10_url_filter": _url_filter(),
    "op11_source_divergence": SOURCE_DIVERGENCE,
}
