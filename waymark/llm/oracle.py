"""The queries as DuckDB SQL, written from their contracts."""

from waymark.llm.licenses import TEMPLATES

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (ARRAY[5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone
  FROM per_source
  WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopping AS (
  SELECT *, 3 * source_size * (weights - gone) <= (total - capped) * weight AS stops FROM ranked
), free AS (
  SELECT *, sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER () AS stopped,
    sum(CASE WHEN stops THEN weight ELSE 0 END) OVER () AS stopped_weight
  FROM stopping
), goal AS (
  SELECT source, source_size, CAST(total AS BIGINT) AS total,
    CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(weight * (total - stopped) AS DOUBLE) / CAST(weights - stopped_weight AS DOUBLE) END AS target
  FROM free
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size) AS n
  FROM sized
), timed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.total, s.source, s.n,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.n) AS before
  FROM numbered s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, CAST(copy * source_size + before AS DOUBLE) / target AS finish
  FROM timed, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0
), summed AS (
  SELECT finish, total, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM copies
), cut AS (SELECT coalesce(max(finish), -1) AS cut FROM summed WHERE upto <= total),
taken AS (
  SELECT source, n, count(*) AS copies FROM copies, cut WHERE finish <= cut GROUP BY source, n
)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(k.copies, 0) * t.size AS BIGINT) AS taken
FROM timed t LEFT JOIN taken k ON t.source IS NOT DISTINCT FROM k.source AND t.n = k.n
"""

# The control strings of the chat template, guarded by one
# backslash after their first character, and the characters around a turn.
GUARD = (
    r"(<)(\\*)(</SYS>>|<SYS>>|ANS>|/s>|s>)|(\[)(\\*)(/INST\]|/ROLE\]|INST\]|ROLE=)|(\|)(\\*)(\])"
)

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS earlier,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
      ELSE 15 + length(role) + len(regexp_extract_all(role, '{GUARD}')) END
      + length(text) + len(regexp_extract_all(text, '{GUARD}')) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN earlier IN ('system', 'assistant') THEN role = 'user'
    WHEN earlier = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM placed GROUP BY conv_id
"""

# The templates are input of the scan (label, text), not part of its logic.
_TEMPLATES = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)

LICENSES = rf"""
WITH templates AS (
  SELECT label, list_distinct(string_split(text, ' ')) AS words FROM (VALUES {_TEMPLATES}) AS t(label, text)
), numbered AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), phrases AS (
  SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'),
    (['cc', 'by', 'nc'], 'cc-by-nc')) AS p(phrase, label)
), places AS (
  SELECT n, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS place
  FROM numbered, phrases
), blocks AS (
  SELECT n, list_distinct(words[s + 1 : s + 64]) AS words
  FROM (SELECT n, words, unnest(range(0, greatest(len(words) - 64, 0) + 32, 32)) AS s FROM numbered)
), found AS (
  SELECT n, label, len(list_intersect(b.words, t.words)) / CAST(len(t.words) AS DOUBLE) AS share
  FROM blocks b, templates t WHERE len(list_intersect(b.words, t.words)) >= ceil(0.9 * len(t.words) - 1e-9)
), based AS (
  SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY n
), labelled AS (
  SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT n, label FROM places UNION SELECT n, label FROM found) GROUP BY n
), best AS (SELECT n, max(share) AS share FROM found GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM numbered LEFT JOIN based USING (n) LEFT JOIN labelled USING (n) LEFT JOIN best USING (n)
"""


def _phrases() -> str:
    """Phrases of one to three words by how often they stand."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS n, unnest([array_to_string(w[i : i + {n - 1}], ' ') FOR i IN range(1, len(w) + {2 - n})]) AS phrase FROM pieces"
        for n in (1, 2, 3)
    )
    parts = " UNION ALL ".join(
        f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS head, array_to_string(w[{k + 1}:], ' ') AS tail FROM candidates WHERE n > {k}"
        for k in (1, 2)
    )
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts),
counted AS (SELECT lang, n, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
words AS (SELECT lang, CAST(sum(f) AS BIGINT) AS words FROM counted WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE n > 1 AND f >= 10),
cuts AS (
  SELECT c.*, h.f AS l, t.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM ({parts}) c JOIN counted h ON c.lang = h.lang AND c.head = h.phrase JOIN counted t ON c.lang = t.lang AND c.tail = t.phrase
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE n = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE n = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * b.a
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, words AS n, score FROM kept JOIN words USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000
"""


# The rules, as host, path and verdict.
URL_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def _urls(order: int = 5) -> str:
    """Both character models, order by order, and the judgement they lead to."""
    levels = []
    for k in range(order + 1):
        below = "1.0::DOUBLE / 1114112 AS b_a, 1.0::DOUBLE / 1114112 AS b_r" if not k else f"p{k - 1}.p_a AS b_a, p{k - 1}.p_r AS b_r"
        join = "" if not k else f"JOIN p{k - 1} ON substr(s.s, 2) = p{k - 1}.s"
        levels.append(f"""
s{k} AS (SELECT substr(string, {order - k + 1}) AS s, substr(string, {order - k + 1}, {k}) AS c, sum(a) AS a, sum(r) AS r FROM strings GROUP BY ALL),
c{k} AS (SELECT c, sum(a) AS all_a, count(*) FILTER (a > 0) AS kinds_a, sum(r) AS all_r, count(*) FILTER (r > 0) AS kinds_r FROM s{k} GROUP BY c),
p{k} AS MATERIALIZED (SELECT s, CASE WHEN all_a > 0 THEN (a + kinds_a * b_a) / (all_a + kinds_a) ELSE b_a END AS p_a,
    CASE WHEN all_r > 0 THEN (r + kinds_r * b_r) / (all_r + kinds_r) ELSE b_r END AS p_r
  FROM (SELECT s.s, CAST(s.a AS DOUBLE) AS a, CAST(s.r AS DOUBLE) AS r, CAST(all_a AS DOUBLE) AS all_a, CAST(all_r AS DOUBLE) AS all_r,
    CAST(kinds_a AS DOUBLE) AS kinds_a, CAST(kinds_r AS DOUBLE) AS kinds_r, {below} FROM s{k} s JOIN c{k} c ON s.c = c.c {join}))""")
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS row, page_id, url, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), parts AS (
  SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || substr(url, strpos(url, '://') + 3 + length(raw)) ELSE url END, '') AS text FROM rows
), rules AS (SELECT * FROM (VALUES {URL_RULES}) AS t(name, start, verdict)),
matched AS (
  SELECT row, name || start AS rule, verdict FROM parts JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(name || start) DESC, verdict DESC) = 1
), texts AS (
  SELECT text, max(verdict) AS verdict, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held,
    repeat(chr(2), {order}) || text || chr(3) AS padded FROM parts LEFT JOIN matched USING (row) GROUP BY text
), places AS (
  SELECT text, verdict, held, unnest([padded[i : i + {order}] FOR i IN range(1, length(text) + 2)]) AS string FROM texts
), strings AS (
  SELECT string, count(*) FILTER (verdict = 'allow' AND NOT held) AS a, count(*) FILTER (verdict = 'block' AND NOT held) AS r
  FROM places GROUP BY string
),{",".join(levels)},
ratios AS (SELECT s AS string, CAST(round((ln(p_a) - ln(p_r)) * 1000000) AS BIGINT) AS ratio FROM p{order}),
scored AS (
  SELECT text, any_value(verdict) AS verdict, any_value(held) AS held, CAST(sum(ratio) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000 AS score
  FROM places JOIN ratios USING (string) GROUP BY text
), stepped AS (SELECT *, CAST(greatest(-5000, least(5000, floor(score * 1000))) AS INT) AS step FROM scored),
steps AS (
  SELECT step, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r
  FROM stepped WHERE held AND verdict IS NOT NULL GROUP BY step
), errors AS (
  SELECT step, CAST(sum(a) OVER u - a AS DOUBLE) / CAST(sum(a) OVER () AS DOUBLE)
    + CAST(sum(r) OVER () - sum(r) OVER u + r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) AS errors,
    sum(a) OVER () > 0 AND sum(r) OVER () > 0 AS complete FROM steps WINDOW u AS (ORDER BY step)
), learnt AS (
  SELECT count(*) FILTER (verdict = 'allow') > 0 AND count(*) FILTER (verdict = 'block') > 0 AS known FROM stepped WHERE NOT held
), cutoff AS (
  SELECT CASE WHEN (SELECT known FROM learnt) THEN
    coalesce((SELECT step FROM errors WHERE complete ORDER BY errors, abs(step), step DESC LIMIT 1), 0) ELSE -5000 END AS cutoff
)
SELECT page_id, host, path, rule, coalesce(m.verdict, CASE WHEN step >= cutoff THEN 'allow' ELSE 'block' END) AS verdict, score
FROM parts LEFT JOIN matched m USING (row) JOIN stepped USING (text), cutoff
"""


# floor(256 * x) fits a double exactly, and so do these sums of products.
NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM p WHERE anchor_label = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN p USING (anchor_id)
WHERE anchor_label <> label AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) QUALIFY rank <= 10
"""

SQL = {
    "op1_license_scan": LICENSES,
    "op3_mixing": MIXING,
    "op10_chat_format": CHAT,
    "op11_url_filter": _urls(),
    "op12_collocations": _phrases(),
    "op13_hard_negatives": NEGATIVES,
}
