"""DuckDB SQL for the operators that SQL can express."""

HOST_RULES = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
win AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8),
seen AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p:p + 7]) AS n FROM win),
cover AS (
  SELECT doc_id, least(8, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 8)) AS c FROM seen WHERE n > 1),
repeats AS (SELECT doc_id, sum(c) AS n_repeat_words FROM cover GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
c AS (
  SELECT w.doc_id, host, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS extra FROM c),
h AS (SELECT host, count(*) AS n, sum((base_failed OR extra)::INT) AS k FROM r GROUP BY host),
s AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*) AS hosts, sum(k * k / n)::DOUBLE AS q FROM h),
v AS (SELECT k / n AS p, (q - k * k / n) / n - (k / n) * (1 - k / n) * hosts / n AS spread FROM s),
b AS (SELECT p, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, p * (1 - p) / spread - 1)) ELSE 1e6 END AS m FROM v),
g AS (SELECT host, round((k + p * m) / (n + m), 6) AS host_rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.5 AS kept, host_rate
FROM r JOIN g ON r.host IS NOT DISTINCT FROM g.host
"""

SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole,
         coalesce(sum(2 * source_size) OVER before, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM s
  WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (whole - cap_before) / weight_left > cap::DOUBLE / weight AS capped FROM o),
rest AS (
  SELECT any_value(whole) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS rest, sum(weight) FILTER (WHERE NOT capped) AS weighing FROM f),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE rest::DOUBLE * weight / weighing::DOUBLE END AS target FROM f, rest),
u AS (
  SELECT doc_id, d.source, size, source_size, target, k AS seed,
         CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate,
         ('0x' || substr(md5(k || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN range(16) r(k)),
c AS (SELECT *, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM u),
p AS (
  SELECT source, seed FROM (
    SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), seed) AS place FROM c GROUP BY source, seed)
  WHERE place = 1)
SELECT doc_id, size, source_size, target, taken FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.seed = p.seed
"""

VORONOI_TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

PHRASES = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
p AS (SELECT lang, w, count(*) AS m FROM w WHERE len(w) > 0 GROUP BY ALL),
g AS (SELECT lang, m, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, 4) r(size) WHERE len(w) >= size),
f AS (SELECT lang, size, w[i:i + size - 1] AS ws, sum(m) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, ws, f AS a FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.ws, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:c.size]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_of AS (SELECT lang, size AS longer_size, a AS longer, unnest([ws[1:2], ws[2:3]]) AS ws FROM c WHERE size = 3),
gone AS (SELECT DISTINCT b.lang, b.ws FROM best b JOIN inner_of i ON i.lang = b.lang AND i.ws = b.ws AND 100 * i.longer >= 50 * b.a),
kept AS (SELECT best.lang, array_to_string(best.ws, ' ') AS phrase, a, l, r, score FROM best ANTI JOIN gone ON gone.lang = best.lang AND gone.ws = best.ws),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
URL_FILTERS = r"""
WITH hosts(host_rule, path_rule, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
pats(pattern, v, re) AS (VALUES
  ('||ads-track.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads-track\.'), ('||free-bets.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?free-bets\.'),
  ('||ads.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads\.'), ('||adserver.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?adserver\.'),
  ('||casino.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?casino\.'), ('||poker.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?poker\.'),
  ('/ads/', 'block', '/ads/'), ('/adclick/', 'block', '/adclick/'), ('/banners/', 'block', '/banners/'), ('/wp-login.php', 'block', '/wp-login\.php'), ('/cgi-bin/', 'block', '/cgi-bin/'),
  ('/login^', 'block', '/login([^a-z0-9_.%-]|\z)'), ('/signup^', 'block', '/signup([^a-z0-9_.%-]|\z)'), ('/cart^', 'block', '/cart([^a-z0-9_.%-]|\z)'), ('/checkout^', 'block', '/checkout([^a-z0-9_.%-]|\z)'),
  ('/porn/', 'block', '/porn/'), ('?sessionid=', 'block', '\?sessionid='), ('&sessionid=', 'block', '&sessionid='), ('.exe|', 'block', '\.exe\z'), ('.zip|', 'block', '\.zip\z'), ('.apk|', 'block', '\.apk\z'),
  ('@@||docs.', 'allow', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?docs\.'), ('@@/robots.txt|', 'allow', '/robots\.txt\z')),
u AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h),
j AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
             (SELECT max({'n': length(host_rule || path_rule), 'rule': host_rule || path_rule, 'v': hosts.v}) FROM hosts
              WHERE (p.host = host_rule OR ends_with(p.host, '.' || host_rule)) AND starts_with(p.path, path_rule)) AS best,
             (SELECT min(pattern) FROM pats WHERE pats.v = 'block' AND regexp_matches(p.low, re)) AS pattern,
             (SELECT count(*) FROM pats WHERE pats.v = 'allow' AND regexp_matches(p.low, re)) AS excepted FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN pattern IS NOT NULL AND excepted = 0 THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM j
"""

ORACLES = {"op1_host_rules": HOST_RULES, "op3_voronoi_topk": VORONOI_TOPK, "op4_source_mixing": SOURCE_MIXING, "op11_phrase_mining": PHRASES, "op12_url_filters": URL_FILTERS}
