"""One SQL text per registered query."""

from __future__ import annotations

from parity.base import geodesic, short_km, with_ctes
from waymark.operators.prompts import INSTRUCTION
from waymark.operators.scope import PROFILE_COLUMNS, WEEKDAYS
from waymark.plans.curation import NUMERIC, REVIEW_CUTOFF
from waymark.sources.sample_views import BUSINESS

L2 = "pow(list_distance(q.vector, i.vector), 2)"
IP = "list_inner_product(q.vector, i.vector)"
COS_FULL = (
    "list_inner_product(q.vector, i.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * "
    "sqrt(list_inner_product(i.vector, i.vector)))"
)
COS = f"round({COS_FULL}, 12)"
KM = short_km("q.latitude", "q.longitude", "i.latitude", "i.longitude")
BOX = "abs(q.latitude - i.latitude) < 0.0453 AND abs(q.longitude - i.longitude) < 0.06"


def _digits(value: str) -> str:
    """Twelve significant digits: what a score is ranked by."""
    return f"CASE WHEN abs({value}) <= 1e-280 THEN 0 ELSE round({value}, CAST(11 - floor(log10(abs({value}))) AS INT)) END"


def _knn(score: str, name: str, order: str) -> str:
    return with_ctes(
        f"SELECT query_id, CAST(rank AS INT) AS rank, business_id, round({name}, 6) AS {name} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY {_digits(name)} {order}, business_id) AS rank FROM (SELECT CAST(q.vec_id AS VARCHAR) "
        f"AS query_id, i.business_id, {score} AS {name} FROM vectors q, items i)) WHERE rank <= 10"
    )


def _near(queries: str, items: str) -> str:
    return (
        f"SELECT q.query_id, i.business_id, {L2} AS l2, {COS} AS similarity, round({KM}, 9) AS distance_km "
        f"FROM {queries} q, {items} i WHERE {BOX} AND {KM} <= 5"
    )


def _two_stage(queries, items, candidates, results, keep="TRUE", order="similarity DESC, business_id") -> str:
    return (
        "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(similarity, 6) AS similarity, "
        f"round(distance_km, 6) AS distance_km FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_digits('l2')}, business_id) AS first_rank "
        f"FROM ({_near(queries, items)})) WHERE first_rank <= {candidates} AND {keep}) WHERE rank <= {results}"
    )


CLI = _two_stage("located", "items", 25, 5, "similarity >= 0")

KB = (
    "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(round(l2, 6), 4) AS similarity_score FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_digits('l2')}, business_id) AS rank FROM ("
    f"SELECT q.query_id, i.business_id, {L2} AS l2 FROM message_queries q, items i)) WHERE rank <= 5"
)

PRESENTED = (
    "SELECT k.query_id, k.rank, k.similarity_score, k.business_id, b.name, coalesce(b.categories, '') AS categories, "
    "b.city, b.state, round(b.stars, 1) AS stars, round(k.km, 2) AS distance_km FROM ("
    + geodesic(
        f"SELECT h.*, l.latitude AS lat1, l.longitude AS lon1, b.latitude AS lat2, b.longitude AS lon2 FROM ({KB}) h "
        "LEFT JOIN located l USING (query_id) JOIN business b USING (business_id)"
    )
    + ") k JOIN business b USING (business_id)"
)

WORDS = (
    "SELECT key, unnest(string_split_regex(regexp_replace(lower(body), '[^\\p{L}\\p{N}_\\s]', '', 'g'), "
    "'\\s+')) AS word FROM "
)


def _weights(source: str, key: str, body: str) -> str:
    """Signed md5 bucket counts, scaled to length one."""
    return (
        f"SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM (SELECT key, "
        "CAST(h % 384 AS INT) AS bucket, CAST(sum(CASE WHEN (h // 384) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS w "
        "FROM (SELECT key, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM ("
        f"{WORDS} (SELECT {key} AS key, {body} AS body FROM {source})) WHERE word <> '') GROUP BY 1, 2)"
    )


def _weights_text(source: str, key: str, body: str) -> str:
    """The weights in thousandths as text, place:weight, zeros left out."""
    return (
        "SELECT key, string_agg(bucket || ':' || CAST(round(weight * 1000) AS INT), ' ' ORDER BY bucket) AS weights "
        f"FROM ({_weights(source, key, body)}) WHERE round(weight * 1000) <> 0 GROUP BY 1"
    )


def _embedding(source: str, key: str, body: str) -> str:
    return with_ctes(
        f"SELECT key AS {key}, bucket, round(weight, 6) AS weight FROM ({_weights(source, key, body)}) WHERE weight <> 0"
    )


def _profile() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c}) AS value_count, round(avg({c}), 6) AS mean_value, "
        f"round(stddev_samp({c}), 6) AS std_value, round(CAST(min({c}) AS DOUBLE), 6) AS min_value, "
        + ", ".join(
            f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS p{int(q * 100)}_value" for q in (0.25, 0.5, 0.75)
        )
        + f", round(CAST(max({c}) AS DOUBLE), 6) AS max_value FROM business"
        for c in NUMERIC
    ]
    return with_ctes(" UNION ALL ".join(parts))


def _per_column(expression: str, name: str) -> str:
    return with_ctes(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({expression.format(c=c)} AS BIGINT) AS {name} FROM business"
            for c in BUSINESS
        )
    )


def _wide() -> str:
    columns = [
        f"json_extract_string(attributes, '$.{c}') AS \"{c}_Attr\""
        for c in ("WiFi", "BikeParking", "RestaurantsPriceRange2", "Ambience")
    ]
    columns += [f"json_extract_string(hours, '$.{d}') AS \"{d}_Hour\"" for d in ("Monday", "Sunday")]
    body = "json_extract_string(attributes, '$.Ambience')"
    repaired = (
        f"replace(replace(replace(replace(replace({body}, 'u' || chr(39), chr(39)), chr(39), '\"'), 'None', 'null'), "
        "'True', 'true'), 'False', 'false')"
    )
    columns += [
        f"json_extract_string({repaired}, '$.{k}') AS \"{k}_Ambience\"" for k in ("romantic", "casual", "hipster")
    ]
    return with_ctes(f"SELECT business_id, {', '.join(columns)} FROM business")


TWICE = (
    "SELECT * FROM business UNION ALL SELECT * REPLACE (review_count + 1 AS review_count) FROM business "
    "UNION ALL SELECT * FROM business"
)

CLEAN = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


def _intent_rows() -> str:
    vocabulary = (
        f"SELECT DISTINCT kind, trim(regexp_replace({CLEAN.format(c='term')}, '\\s+', ' ', 'g')) AS phrase FROM ("
        "SELECT 'city' AS kind, lower(city) AS term FROM business UNION SELECT 'category', "
        "trim(unnest(string_split(lower(categories), ','))) FROM business)"
    )
    best = (
        "SELECT m.conv_id, m.turn, (list(v.phrase ORDER BY length(v.phrase) DESC, v.phrase) FILTER "
        "(v.kind = 'city'))[1] AS location, (list(v.phrase ORDER BY length(v.phrase) DESC, v.phrase) FILTER "
        "(v.kind = 'category'))[1] AS category FROM (SELECT conv_id, turn, ' ' || regexp_replace("
        f"{CLEAN.format(c='wish')}, '\\s+', ' ', 'g') || ' ' AS body FROM asked) m LEFT JOIN ({vocabulary}) v "
        "ON v.phrase <> '' AND contains(m.body, ' ' || v.phrase || ' ') GROUP BY 1, 2"
    )
    return best


def _intent() -> str:
    return with_ctes(f"SELECT *, location IS NOT NULL AND category IS NOT NULL AS is_complete FROM ({_intent_rows()})")


def _search_text() -> str:
    docs = _weights("prose", "business_id", "combined_text")
    asked = _weights("asked", "query_id", "wish")
    return with_ctes(
        "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(similarity, 6) AS similarity FROM (SELECT *, "
        "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, business_id) AS rank FROM ("
        "SELECT q.query_id, p.business_id, round(coalesce(s.ip, 0), 12) AS similarity "
        "FROM (SELECT DISTINCT key AS query_id FROM asked_weights) q, prose p LEFT JOIN (SELECT a.key AS query_id, "
        "d.key AS business_id, sum(a.weight * d.weight) AS ip FROM asked_weights a JOIN doc_weights d USING (bucket) "
        "GROUP BY 1, 2) s ON s.query_id = q.query_id AND s.business_id = p.business_id)) WHERE rank <= 5",
        ("asked_weights", asked),
        ("doc_weights", docs),
    )


def _search_kb_text() -> str:
    """Both sides have length one, so the squared distance is 2 - 2 ip."""
    return with_ctes(
        "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(round(l2, 6), 4) AS similarity_score FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY {_digits('l2')}, business_id) AS rank FROM (SELECT q.query_id, "
        "p.business_id, 2 - 2 * coalesce(s.ip, 0) AS l2 FROM (SELECT DISTINCT key AS query_id FROM "
        "asked_weights) q, kb_doc p LEFT JOIN (SELECT a.key AS query_id, d.key AS business_id, sum(a.weight * d.weight) "
        "AS ip FROM asked_weights a JOIN doc_weights d USING (bucket) GROUP BY 1, 2) s ON s.query_id = q.query_id "
        "AND s.business_id = p.business_id)) WHERE rank <= 5",
        ("asked_weights", _weights("asked", "query_id", "wish")),
        ("doc_weights", _weights("kb_doc", "business_id", "document")),
    )


def _follow_up(results: int) -> str:
    return (
        "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(distance_km, 2) AS distance_km, "
        "round(similarity, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY similarity DESC, business_id) AS rank FROM (SELECT p.query_id, p.business_id, p.distance_km, {COS} "
        f"AS similarity FROM ({CLI}) p JOIN follow_up_queries q ON q.query_id = p.query_id JOIN items i "
        f"ON i.business_id = p.business_id)) WHERE rank <= {results} AND similarity >= 0.1"
    )


def _text_near() -> tuple[str, tuple[tuple[str, str], ...]]:
    """Place and vector from the message text; the tables it needs."""
    spots = (
        "SELECT a.query_id, a.conv_id, a.turn, p.latitude, p.longitude FROM asked a JOIN "
        f"({_intent_rows()}) t USING (conv_id, turn) JOIN places p ON t.location IS NOT DISTINCT FROM p.city AND "
        "nullif(regexp_extract(a.wish, '\\b(PA|FL|TN|IN|MO)\\b', 1), '') IS NOT DISTINCT FROM p.state"
    )
    mean = "round(sum({c} * n_business) / sum(n_business), 6) AS {c}"
    both = f"{mean.format(c='latitude')}, {mean.format(c='longitude')}"
    return (
        "SELECT conv_id, turn, CAST(rank AS INT) AS rank, business_id, round(similarity, 6) AS similarity, "
        "round(distance_km, 6) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "
        "similarity DESC, distance_km, business_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY {_digits('(2 - 2 * ip)')}, business_id) AS first_rank FROM (SELECT q.query_id, q.conv_id, q.turn, "
        "i.business_id, coalesce(s.ip, 0) AS ip, round(coalesce(s.ip, 0), 12) AS similarity, "
        f"round({KM}, 9) AS distance_km FROM spots q JOIN prose i ON {BOX} AND {KM} <= 5 LEFT JOIN (SELECT a.key AS "
        "query_id, d.key AS business_id, sum(a.weight * d.weight) AS ip FROM asked_weights a JOIN doc_weights d "
        "USING (bucket) GROUP BY 1, 2) s ON s.query_id = q.query_id AND s.business_id = i.business_id)) "
        "WHERE first_rank <= 5) WHERE rank <= 2",
        (
            (
                "places",
                "SELECT city, state, latitude, longitude FROM gazetteer UNION ALL "
                f"SELECT city, NULL, {both} FROM gazetteer GROUP BY city UNION ALL "
                f"SELECT NULL, state, {both} FROM gazetteer GROUP BY state",
            ),
            ("spots", spots),
            ("asked_weights", _weights("asked", "query_id", "wish")),
            ("doc_weights", _weights("prose", "business_id", "combined_text")),
        ),
    )


def _prefs_text() -> str:
    docs = _weights("prose", "business_id", "combined_text")
    asked = _weights("usr", "user_id", "categories")
    spots = (
        "SELECT u.user_id, g.latitude, g.longitude FROM usr u JOIN gazetteer g "
        "ON lower(u.city) = g.city AND u.state = g.state"
    )
    return with_ctes(
        "SELECT user_id, CAST(rank AS INT) AS rank, business_id, round(similarity, 6) AS similarity, "
        "round(distance_km, 6) AS distance_km FROM (SELECT *, row_number() "
        "OVER (PARTITION BY user_id ORDER BY similarity DESC, distance_km, business_id) AS rank FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY {_digits('(2 - 2 * ip)')}, business_id) AS first_rank FROM ("
        f"SELECT q.user_id, i.business_id, coalesce(s.ip, 0) AS ip, round(coalesce(s.ip, 0), 12) AS similarity, "
        f"round({KM}, 9) AS distance_km FROM ({spots}) q JOIN prose i ON {BOX} AND {KM} <= 5 "
        "LEFT JOIN (SELECT a.key AS user_id, d.key AS business_id, sum(a.weight * d.weight) AS ip FROM asked_weights a "
        "JOIN doc_weights d USING (bucket) GROUP BY 1, 2) s ON s.user_id = q.user_id "
        "AND s.business_id = i.business_id)) WHERE first_rank <= 5) WHERE rank <= 1",
        ("asked_weights", asked),
        ("doc_weights", docs),
    )


def _lsh(tables: int = 8, bits: int = 4, k: int = 10, recall: float = 0.95, audit: int = 64) -> list[tuple[str, str]]:
    """The pairs an audited multi-probe search scores, step by step."""
    exact = (
        "SELECT id, business_id FROM (SELECT q.vec_id AS id, i.business_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
        + _digits(COS_FULL)
        + f" DESC, i.business_id) AS n FROM vectors q, items i WHERE q.vec_id IN (SELECT id FROM audited)) WHERE n <= {k}"
    )
    return [
        (
            "planes",
            "SELECT t, b, list(CASE WHEN substr(md5(t || ':' || b || ':' || d), 1, 1) IN ('1', '3', '5', '7', '9', "
            "'b', 'd', 'f') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane "
            f"FROM (SELECT unnest(range({tables})) AS t), (SELECT unnest(range({bits})) AS b), (SELECT unnest(range(64)) AS d) GROUP BY 1, 2",
        ),
        ("sides", "SELECT vec_id AS id, t, b, list_inner_product(vector, plane) AS side FROM vectors, planes"),
        (
            "query_buckets",
            "SELECT id, t, CAST(sum(CASE WHEN side > 0 THEN pow(2, b) ELSE 0 END) AS INT) AS bucket FROM sides GROUP BY 1, 2",
        ),
        (
            "item_buckets",
            "SELECT business_id AS id, t, CAST(sum(CASE WHEN list_inner_product(vector, plane) > 0 THEN pow(2, b) ELSE 0 END) AS INT) "
            "AS bucket FROM items, planes GROUP BY 1, 2",
        ),
        (
            "turns",
            "SELECT id, t, mask, sum(CASE WHEN (mask >> b) & 1 = 1 THEN side * side ELSE 0 END) AS cost "
            f"FROM sides, (SELECT unnest(range({1 << bits})) AS mask) GROUP BY 1, 2, 3",
        ),
        (
            "query_probes",
            "SELECT id, t, xor(CAST(bucket AS BIGINT), mask) AS bucket, row_number() OVER (PARTITION BY id, t ORDER BY cost, mask) AS probe "
            "FROM turns JOIN query_buckets USING (id, t)",
        ),
        ("audited", f"SELECT vec_id AS id FROM vectors ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT {audit}"),
        ("exact", exact),
        (
            "needed",
            "SELECT e.id, e.business_id, min(p.probe) AS probe FROM exact e JOIN item_buckets i ON i.id = e.business_id "
            "JOIN query_probes p ON p.id = e.id AND p.t = i.t AND p.bucket = i.bucket GROUP BY 1, 2",
        ),
        (
            "visited",
            f"SELECT list_sort(list(probe))[CAST(ceil((SELECT count(*) FROM exact) * {recall}) AS BIGINT)] AS probes FROM needed",
        ),
        (
            "close",
            "SELECT DISTINCT p.id, i.id AS business_id FROM query_probes p JOIN item_buckets i USING (t, bucket), visited v WHERE probe <= v.probes",
        ),
        ("served", f"SELECT id FROM close GROUP BY id HAVING count(*) >= {k}"),
        (
            "scored",
            "SELECT id, business_id FROM close WHERE id IN (SELECT id FROM served) UNION ALL "
            "SELECT q.vec_id, i.business_id FROM vectors q, items i WHERE q.vec_id NOT IN (SELECT id FROM served)",
        ),
    ]


def oracle_sql() -> dict[str, str]:
    days = ", ".join(f"json_extract_string(hours, '$.{d}') AS {d.lower()}" for d in WEEKDAYS)
    w = with_ctes
    return {
        "business_scope": w("SELECT * EXCLUDE (is_open) FROM scoped"),
        "business_model": w(f"SELECT {', '.join(PROFILE_COLUMNS)}, {days} FROM filtered"),
        "category_model": w("SELECT * FROM category_rows"),
        "category_vocab": w(
            "SELECT 'city' AS kind, lower(city) AS term FROM business UNION "
            "SELECT 'category', trim(unnest(string_split(lower(categories), ','))) FROM business"
        ),
        "attribute_model": w("SELECT * FROM attr_model"),
        "attribute_nested": w("SELECT * FROM attr_nested"),
        "attribute_final": w("SELECT * FROM attr_final"),
        "attribute_truthful": w("SELECT * FROM attr_true"),
        "attribute_map": w("SELECT * FROM attr_map"),
        "attribute_wide": _wide(),
        "filtered_attributes": w("SELECT * FROM attr_map WHERE business_id IN (SELECT business_id FROM filtered)"),
        "filtered_categories": w(
            "SELECT DISTINCT business_id, categories FROM filtered WHERE categories IS NOT NULL"
        ),
        "engineered_businesses": w("SELECT * FROM engineered"),
        "kb_join": w("SELECT * FROM cat_attr"),
        "table_counts": w(
            "SELECT 'filtered_businesses' AS table_name, count(*) AS row_count FROM filtered "
            "UNION ALL SELECT 'engineered_businesses', count(*) FROM engineered"
        ),
        "relevant_reviews": w(
            "SELECT business_id, user_id, stars, CAST(date AS DATE) AS date FROM review WHERE business_id IN "
            f"(SELECT business_id FROM filtered) AND CAST(date AS DATE) > DATE '{REVIEW_CUTOFF}'"
        ),
        "relevant_users": w(
            "SELECT user_id, name, categories FROM usr WHERE user_id IN (SELECT user_id FROM review WHERE "
            "business_id IN (SELECT business_id FROM filtered) AND "
            f"CAST(date AS DATE) > DATE '{REVIEW_CUTOFF}')"
        ),
        "kb_dedupe": w(
            "SELECT business_id, name, review_count FROM (SELECT *, row_number() OVER (PARTITION BY business_id "
            f"ORDER BY id, review_count DESC, name) AS nth FROM ({TWICE})) WHERE nth = 1"
        ),
        "row_dedupe": w(f"SELECT DISTINCT * FROM ({TWICE})"),
        "profile_numeric": _profile(),
        "profile_nulls": _per_column("count(*) FILTER ({c} IS NULL)", "null_count"),
        "profile_counts": _per_column("count({c})", "value_count"),
        "dq_unique": w("SELECT business_id, count(*) AS row_count FROM category_rows GROUP BY 1 HAVING count(*) > 1"),
        "dq_not_null": w("SELECT business_id FROM business WHERE categories IS NULL"),
        "dq_foreign_key": w(
            "SELECT * FROM category_rows WHERE business_id NOT IN (SELECT business_id FROM filtered)"
        ),
        "region_supported": w(
            "SELECT user_id, place, nullif(regexp_extract(upper(place), '\\b(PA|FL|TN|IN|MO)\\b', 1), '') AS region, "
            "regexp_matches(upper(place), '\\b(PA|FL|TN|IN|MO)\\b') AS supported FROM usr"
        ),
        "weekday_hours": w("SELECT business_id, day, open_hours FROM hours_rows"),
        "typed_attributes": w(
            "SELECT business_id, attribute_name, CASE WHEN lower(bare) IN ('true', 'false') THEN 'bool' "
            "WHEN regexp_full_match(bare, '[0-9]+') THEN 'int' WHEN try_cast(bare AS DOUBLE) IS NOT NULL THEN 'float' "
            "ELSE 'text' END AS kind, CASE lower(bare) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE bare "
            "END AS value FROM (SELECT business_id, attribute_name, trim(trim(max(attribute_value), '\"'), chr(39)) "
            "AS bare FROM attr_model GROUP BY 1, 2)"
        ),
        "attr_prose": w("SELECT business_id, attribute_text FROM prose"),
        "hours_prose": w("SELECT business_id, hours_text FROM prose"),
        "combined_text": w("SELECT business_id, name, city, state, combined_text FROM prose"),
        "kb_doc_v1": w(
            "SELECT c.business_id, 'Business ID: ' || c.business_id || chr(10) || 'Categories: ' || c.categories || "
            "chr(10) || 'Attributes: ' || t.typed_text || chr(10) AS document FROM cat_attr c "
            "JOIN attr_typed_text t USING (business_id)"
        ),
        "kb_doc_v2": w("SELECT * FROM kb_doc"),
        "kb_metadata": w("SELECT * FROM kb_meta"),
        "kb_metadata_v1": w(
            "SELECT business_id, '{' || string_agg(CAST(to_json(name) AS VARCHAR) || ':' || body, ',' ORDER BY name) "
            "|| '}' AS metadata FROM (SELECT t.* FROM typed_json t JOIN cat_attr USING (business_id) UNION ALL "
            "SELECT business_id, 'categories', CAST(to_json(categories) AS VARCHAR) FROM cat_attr UNION ALL "
            "SELECT business_id, 'attribute_text', CAST(to_json(typed_text) AS VARCHAR) FROM cat_attr "
            "JOIN attr_typed_text USING (business_id)) GROUP BY 1"
        ),
        "hash_embed": _embedding("documents", "doc_id", "text"),
        "business_embed": _embedding("prose", "business_id", "combined_text"),
        "vector_text": (
            "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS position, "
            "round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings"
        ),
        "gazetteer": w("SELECT * FROM gazetteer"),
        "geo_radius": w(
            f"SELECT q.city || '/' || q.state AS place, i.business_id, round({KM}, 6) AS distance_km "
            f"FROM gazetteer q, business i WHERE {BOX} AND {KM} <= 5"
        ),
        "geo_nearest": w(
            "SELECT place, business_id, round(distance_km, 6) AS distance_km, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER "
            "(PARTITION BY place ORDER BY round(distance_km, 9), business_id) AS rank FROM (SELECT q.city || '/' || q.state "
            f"AS place, i.business_id, {KM} AS distance_km FROM gazetteer q, business i WHERE {BOX} AND "
            f"{KM} <= 5)) WHERE rank <= 10"
        ),
        "knn_l2": _knn(L2, "l2", "ASC"),
        "knn_ip": _knn(IP, "ip", "DESC"),
        "knn_cosine": _knn(COS_FULL, "cosine", "DESC"),
        "knn_pivots": _knn(L2, "l2", "ASC"),
        "knn_lsh": w(
            "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(cosine, 6) AS cosine FROM (SELECT *, "
            "row_number() OVER (PARTITION BY query_id ORDER BY "
            + _digits("cosine")
            + " DESC, business_id) AS rank FROM (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, i.business_id, "
            f"{COS_FULL} AS cosine FROM scored c JOIN vectors q ON q.vec_id = c.id "
            "JOIN items i ON i.business_id = c.business_id)) WHERE rank <= 10",
            *_lsh(),
        ),
        "search_cli": w(CLI),
        "search_form": w(_two_stage("located", "items", 20, 3)),
        "search_near": w(
            _two_stage("located", "unit_items", 5, 2, order="similarity DESC, distance_km, business_id")
        ),
        "search_global": w(
            "SELECT query_id, CAST(rank AS INT) AS rank, business_id, round(similarity, 6) AS similarity FROM (SELECT *, "
            "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, business_id) AS rank FROM (SELECT q.query_id, "
            f"i.business_id, {COS} AS similarity FROM message_queries q, items i)) WHERE rank <= 10"
        ),
        "search_kb": w(KB),
        "search_followup": w(
            f"SELECT s.*, b.name, b.categories FROM ({_follow_up(5)}) s JOIN business b USING (business_id)"
        ),
        "followup_best": w(_follow_up(1)),
        "search_text": _search_text(),
        "search_text_near": with_ctes(_text_near()[0], *_text_near()[1]),
        "liked_from_search": with_ctes(
            "SELECT * FROM liked",
            ("results", f"SELECT conv_id, turn, rank, business_id FROM ({_text_near()[0]})"),
            *_text_near()[1],
        ),
        "search_kb_text": _search_kb_text(),
        "search_presented": w(PRESENTED),
        "prompt_table": w(
            f"SELECT p.query_id, count(*) AS n_hits, '{INSTRUCTION}' || chr(10) || chr(10) || 'Question: ' || "
            "any_value(q.text) || chr(10) || chr(10) || 'Places:' || chr(10) || string_agg('- ' || p.name || ' (' || "
            "p.categories || '), ' || p.city || ', ' || p.state || ', ' || CAST(p.stars AS VARCHAR) || ' stars, ' || "
            "coalesce(CAST(p.distance_km AS VARCHAR), '?') || ' km', chr(10) ORDER BY p.rank) || chr(10) AS prompt "
            f"FROM ({PRESENTED}) p JOIN asked q USING (query_id) GROUP BY 1"
        ),
        "prefs_recommend": w(
            "SELECT s.query_id AS user_id, s.rank, s.business_id, s.similarity, s.distance_km, b.name, b.city, b.state, "
            "b.categories FROM ("
            + _two_stage("located_users", "unit_items", 5, 1, order="similarity DESC, distance_km, business_id")
            + ") s JOIN business b USING (business_id)"
        ),
        "prefs_text_recommend": _prefs_text(),
        "user_preferences": w(
            "SELECT user_id, name, string_agg(DISTINCT token, ', ' ORDER BY token) AS preferences FROM (SELECT "
            "user_id, name, lower(trim(unnest(string_split(categories, ',')))) AS token FROM usr) "
            "WHERE token <> '' GROUP BY 1, 2"
        ),
        "preference_lookup": w(
            "SELECT user_id, name, categories FROM usr WHERE user_id IN (SELECT user_id FROM chat)"
        ),
        "feedback_class": w(
            "SELECT conv_id, turn, feedback, CASE WHEN regexp_matches(lower(text), 'not a fan|don''t like|dislike|"
            "another|next') THEN 'negative' ELSE 'search' END AS feedback_short FROM told"
        ),
        "feedback_status": w("SELECT conv_id, turn, feedback, action, shown_turn, shown_rank FROM moves"),
        "last_item": w("SELECT conv_id, turn, feedback, business_id FROM reacted"),
        "next_suggestion": w(
            "SELECT m.conv_id, m.turn, m.action, m.shown_turn, m.shown_rank, r.business_id FROM moves m "
            "JOIN results r ON r.conv_id = m.conv_id AND r.turn = m.shown_turn AND r.rank = m.shown_rank "
            "WHERE m.action IN ('shown', 'next')"
        ),
        "liked_categories": w("SELECT * FROM liked"),
        "prefs_upsert": w(
            "SELECT u.user_id, u.name, coalesce(nullif(l.liked, ''), u.categories) AS categories "
            "FROM usr u LEFT JOIN (SELECT * FROM liked WHERE liked <> '') l ON l.user_id = u.user_id"
        ),
        "prefs_register": w(
            "SELECT coalesce(u.user_id, l.user_id) AS user_id, u.name, coalesce(nullif(l.liked, ''), u.categories) "
            "AS categories FROM usr u FULL JOIN (SELECT * FROM liked WHERE liked <> '') l ON l.user_id = u.user_id"
        ),
        "intent": _intent(),
        "place_mentions": w("SELECT conv_id, turn, list_turn, rank, business_id, name FROM selections"),
        "itinerary_legs": w(
            "SELECT conv_id, visit, turn, business_id, name, from_business_id, round(km, 6) AS leg_km FROM legs"
        ),
        "itinerary_totals": w(
            "SELECT conv_id, count(*) AS n_visits, round(sum(km), 6) AS total_km FROM legs GROUP BY 1"
        ),
        "planning_search": w(
            "SELECT k.conv_id, k.turn, k.rank, CASE WHEN k.origin_id IS NULL THEN 'search' ELSE 'planning' END AS mode, "
            "k.origin_id, k.business_id, k.name, round(k.stars, 1) AS stars, round(k.km, 2) AS distance_km FROM ("
            + geodesic(
                "SELECT r.conv_id, r.turn, r.rank, r.business_id, o.origin_id, b.name, b.stars, o.lat1, o.lon1, "
                "b.latitude AS lat2, b.longitude AS lon2 FROM results r JOIN origins o ON o.conv_id = r.conv_id "
                "AND o.turn = r.turn JOIN business b ON b.business_id = r.business_id "
                "WHERE NOT EXISTS (SELECT 1 FROM selections s WHERE s.conv_id = r.conv_id AND s.turn = r.turn)"
            )
            + ") k"
        ),
        "chat_history": (
            "SELECT conv_id, turn, role, text || CASE WHEN role <> 'user' THEN '' ELSE CASE (conv_id + turn) % 6 "
            "WHEN 1 THEN ' I like it' WHEN 2 THEN ' show me another one' WHEN 3 THEN ' Not a fan' "
            "WHEN 4 THEN ' Great, perfect!' ELSE '' END END AS text, "
            "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, "
            "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_last FROM conversations"
        ),
        "csv_roundtrip": w(
            "SELECT * REPLACE (CASE id % 6 WHEN 0 THEN '  lead and trail  ' WHEN 1 THEN '' WHEN 2 THEN NULL "
            "WHEN 3 THEN 'a \"quoted\", cell' WHEN 4 THEN 'two' || chr(10) || 'lines' ELSE address END AS address) FROM business"
        ),
        "file_manifest": (
            "SELECT 'events' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM events "
            "UNION ALL SELECT 'orders', count(*), 1 FROM orders"
        ),
        "declared_tests": w(
            "SELECT 'curated_business' AS model, 'business_id' AS column_name, 'unique' AS test, "
            "(SELECT count(*) FROM (SELECT business_id FROM filtered GROUP BY 1 HAVING count(*) > 1)) AS failing_rows "
            "UNION ALL SELECT 'curated_business', 'business_id', 'not_null', (SELECT count(*) FROM filtered WHERE business_id IS NULL) "
            "UNION ALL SELECT 'categories', 'business_id', 'not_null', (SELECT count(*) FROM category_rows WHERE business_id IS NULL) "
            "UNION ALL SELECT 'attributes', 'business_id', 'not_null', (SELECT count(*) FROM attr_model WHERE business_id IS NULL)"
        ),
        "raw_variant_load": w(
            "SELECT * FROM business"
        ),
        "json_normalize": (
            "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k "
            "FROM events"
        ),
        "kb_write": w(
            "SELECT d.business_id AS id, d.document, m.metadata, coalesce(v.weights, '') AS weights FROM kb_doc d "
            f"JOIN kb_meta m USING (business_id) LEFT JOIN ({_weights_text('kb_doc', 'business_id', 'document')}) v "
            "ON v.key = d.business_id"
        ),
        "embedding_table": w(
            "SELECT business_id, name, city, state, latitude, longitude, categories, combined_text, "
            "coalesce(v.weights, '') AS weights FROM prose LEFT JOIN "
            f"({_weights_text('prose', 'business_id', 'combined_text')}) v ON v.key = business_id"
        ),
        "append_write": w(
            "SELECT business_id, attributes FROM engineered UNION ALL SELECT business_id, attributes FROM engineered"
        ),
        "report_csv": w(CLI),
        "stream_ingest": "SELECT * FROM events",
        "stream_liked": w("SELECT * FROM liked"),
    }
