"""DuckDB SQL of the operators' queries that SQL can express; the others are tested against plain versions."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _record(html: str) -> str:
    body = f"coalesce({html}, '')"
    end = "chr(13) || chr(10)"
    return f"""'WARC/1.0' || {end} || 'WARC-Type: resource' || {end} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {end}
    || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Length: ' || strlen({body})::VARCHAR || {end} || {end} || {body} || {end} || {end}"""


_CUT = "CASE WHEN page_id % 97 = 13 THEN left(html, length(html) - 1) ELSE html END"

_BARE = r"regexp_replace({}, '(?s)^(.*?://[^#]*)#.*$', '\1')"



def _lloyd(rounds: int = 6) -> str:
    """Codebooks c0 .. c<rounds> and the assignments a0 .. a<rounds> to them, one after the other."""
    out = ["c0 AS MATERIALIZED (SELECT p, e, v FROM q JOIN (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (id))"]
    for k in range(rounds + 1):
        out.append(f"""d{k} AS (SELECT id, q.p, e, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM q JOIN c{k} c ON c.p = q.p),
a{k} AS MATERIALIZED (SELECT id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM d{k} GROUP BY id, p)""")
        if k < rounds:
            out.append(f"""m{k} AS (SELECT p, e, spot, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT a.p, a.e, unnest(q.v) AS x, unnest(range(len(q.v))) AS spot FROM a{k} a JOIN q USING (id, p)) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(any_value(n.v), any_value(c.v)) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(x ORDER BY spot) AS v FROM m{k} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e GROUP BY c.p, c.e)""")
    return ",\n".join(out)


#: CRC-32 of a text's UTF-8 bytes, from a table of remainders that recursion makes.
_CRC_TABLE = """crc_step(n, k, c) AS (SELECT n, 0, n FROM (SELECT unnest(range(256))::BIGINT AS n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS crcs FROM crc_step WHERE k = 8)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0}) * 2, 2), lambda b: ('0x' || substr(hex(encode({0})), (b + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""

SQL: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)""",
    "op2_merkle_fixity": f"""
WITH a AS (SELECT page_id AS id, sha256({_record("html")}) AS h, count(*) AS c, any_value(strlen({_record("html")})) AS bytes FROM pages GROUP BY page_id, {_record("html")}),
b AS (SELECT page_id AS id, sha256({_record(_CUT)}) AS h, count(*) AS c FROM pages GROUP BY page_id, {_record(_CUT)}),
own AS (SELECT *, floor(id / 16)::BIGINT AS node, sum(bytes * c) OVER (ORDER BY id, h) - bytes * c AS spot FROM a),
la AS (SELECT node, id, min(spot) AS spot, list((h, c) ORDER BY h) AS hs FROM own GROUP BY 1, 2),
lb AS (SELECT id, list((h, c) ORDER BY h) AS hs FROM b GROUP BY 1),
bad AS (SELECT la.node, la.id, la.spot FROM la JOIN lb ON la.id = lb.id WHERE la.hs <> lb.hs),
n AS (SELECT node, sum(bytes * c)::BIGINT AS bytes, sum(c)::BIGINT AS n, min(spot)::BIGINT AS first_offset FROM own GROUP BY node),
d AS (SELECT node, count(*) AS n_damaged, string_agg(id || ':' || spot || ':corrupt', ',' ORDER BY id) AS damaged FROM bad GROUP BY node)
SELECT node, first_offset, n, bytes, coalesce(n_damaged, 0) AS n_damaged, coalesce(damaged, '') AS damaged, n_damaged IS NULL AS intact FROM n LEFT JOIN d USING (node)""",
    "op5_fair_mix": f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, len({_SPACED})::BIGINT AS size, ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT AS place FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM rows_ GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS turn FROM w
),
t AS (SELECT *, CASE WHEN budget = 0 THEN 0.0 ELSE least(cap, coalesce((arg_min(level, turn) FILTER (level * weight <= cap) OVER ()) * weight, cap)) END AS target FROM l),
k AS (
  SELECT r.*, t.source_size, t.target, t.budget, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ r JOIN t ON r.source IS NOT DISTINCT FROM t.source
),
c AS (SELECT k.*, copy, (upto + (copy - 1) * source_size) / target AS finish FROM k, (SELECT unnest([1, 2, 3]) AS copy) WHERE size > 0 AND copy <= ceil(target / source_size) + 1),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS drawn FROM c),
took AS (SELECT source, doc_id, place, upto, count(*) AS copies FROM q WHERE drawn <= budget GROUP BY ALL)
SELECT k.doc_id, k.size, k.source_size, k.target, (k.size * coalesce(took.copies, 0))::BIGINT AS taken FROM k
LEFT JOIN took ON k.source IS NOT DISTINCT FROM took.source AND k.doc_id IS NOT DISTINCT FROM took.doc_id AND k.place = took.place AND k.upto = took.upto""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[p:p + least(10, len(w)) - 1] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT r, p, n, w[p:p + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, p, n, item_id FROM pos JOIN win USING (g)),
words AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS at FROM hit),
nw AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
ni AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN nw USING (r) LEFT JOIN ni USING (r)""",
    "op9_url_filters": rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') || regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag
  FROM pages WHERE contains(url, '://')
),
links AS (
  SELECT url, coalesce(nullif(regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''), regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)) AS link FROM tags
),
split_ AS (
  SELECT url, link, regexp_extract(link, '(?s)^([^?#]*)', 1) AS t, regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS query, coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') AS here FROM links WHERE link <> ''
),
merged AS (SELECT *, CASE WHEN t = '' THEN here WHEN starts_with(t, '/') THEN t ELSE regexp_extract(here, '(?s)^(.*/)', 1) || t END AS m FROM split_),
walked AS (
  SELECT *, list_reduce(list_prepend('', string_split(m, '/')[2:]), lambda up, step: CASE WHEN step = '..' THEN regexp_replace(up, '/[^/]*$', '') WHEN step = '.' THEN up ELSE up || '/' || step END)
    || CASE WHEN regexp_matches(m, '/\.\.?$') THEN '/' ELSE '' END AS path FROM merged
),
full_ AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || query END AS goal FROM walked
),
edges AS (SELECT DISTINCT {_BARE.format("url")} AS a, {_BARE.format("goal")} AS b FROM full_),
both_ AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
u AS (SELECT DISTINCT {_BARE.format("coalesce(url, '')")} AS url FROM pages UNION SELECT a FROM both_),
h AS (SELECT url, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(decision, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
met AS (SELECT url, decision, rh || rp AS rule FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT url, arg_max(rule, (length(rule), decision = 'allow')) AS rule, arg_max(decision, (length(rule), decision = 'allow')) AS decision FROM met GROUP BY url),
alias AS (SELECT r.a AS url, min(decision) AS told FROM reach r JOIN best ON best.url = r.b GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(decision, told, 'allow') AS verdict FROM pages
JOIN h ON h.url = {_BARE.format("coalesce(pages.url, '')")} LEFT JOIN best ON best.url = h.url LEFT JOIN alias ON alias.url = h.url""",
    "op10_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
both_ AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least_.b, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = d.doc_id""",
    "op11_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least_ AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS spot FROM win JOIN least_ USING (g) WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)),
lost AS (SELECT r, count(*) AS n, list(spot) AS spots FROM gone GROUP BY r),
each_ AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY spot) AS text FROM each_ ANTI JOIN gone USING (r, spot) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)""",
    "op12_vector_codes": f"""
WITH kept AS (SELECT vec_id, row_number() OVER () AS id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT id, vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM kept, range(8) t(p)),
{_lloyd()},
r AS (SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a6 GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN r USING (id), s""",
    "op13_resampling": f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
own AS (SELECT r, f, count(*) AS c FROM (SELECT r, unnest(w) AS f FROM docs) GROUP BY ALL),
wanted AS (SELECT f, count(*) AS c FROM (SELECT unnest({_PLAIN}) AS f FROM benchmark) GROUP BY ALL),
crc AS (SELECT f, {_CRC.format("f")} % 10000 AS b FROM (SELECT f FROM own UNION SELECT f FROM wanted), crc_table),
s AS (SELECT b, sum(c) AS n FROM own JOIN crc USING (f) GROUP BY b),
t AS (SELECT b, sum(c) AS n FROM wanted JOIN crc USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
weight AS (SELECT r, floor(sum(c * g) / sum(c))::BIGINT AS weight FROM own JOIN crc USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weight USING (r)
),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked""",
}
