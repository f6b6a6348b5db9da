"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, THRESHOLD

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Rows of ``links`` (a, b, both directions) and ``nodes`` (node) become components.
_COMPONENTS = """
reach AS (
    SELECT node, node AS seen FROM nodes
    UNION
    SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""

# The rules of the scan as (kind, pattern, group that counts, least length).
_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)


def _secrets() -> str:
    # Matches are wrapped in a character that texts are rid of before; after cutting
    # there, every second piece is a match.
    matches = " UNION ALL ".join(
        f"""
        SELECT r, '{kind}' AS kind, {rank} AS place, nth, piece,
            length(regexp_extract(piece, '{pattern}', {group})) >= {least} AS kept
        FROM (
            SELECT r, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nth FROM (
                SELECT r, string_split(
                    regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS pieces
                FROM texts WHERE regexp_matches(text, '{pattern}')
            )
        )
        """
        for rank, (kind, pattern, group, least) in enumerate(_RULES)
    )
    return f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), chr(3)) AS text
        FROM documents
    ),
    pieces AS ({matches}),
    placed AS (
        SELECT *, (sum(length(piece)) OVER (PARTITION BY r, kind ORDER BY nth))::BIGINT AS stop FROM pieces
    ),
    found AS (
        SELECT r, kind, place, stop - length(piece) AS start,
            kind || ':' || (stop - length(piece)) || ':' || stop AS span
        FROM placed WHERE nth % 2 = 0 AND kept
    ),
    listed AS (
        SELECT r,
            count(*) FILTER (kind = 'assign') AS n_assign,
            count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
            string_agg(span, ',' ORDER BY start, place) AS spans
        FROM found GROUP BY r
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
        coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans
    FROM texts LEFT JOIN listed USING (r)
    """


_WARC = """
WITH digests AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
    FROM pages
),
groups AS (
    SELECT *, [('0x' || substr(hex, 5 * g + 1, 5))::INTEGER for g in range(8)] AS twenties FROM digests
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    list_aggregate(flatten([
        [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1) for s in [15, 10, 5, 0]]
        for x in twenties
    ]), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM groups
"""

_NEAR = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
    FROM (
        SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i
        FROM texts WHERE len(words) > 0
    )
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id
),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)
),
nodes AS (SELECT doc_id AS node FROM documents),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM documents d JOIN components ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

_VECTORS = f"""
WITH RECURSIVE usable AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT x.vec_id AS a, y.vec_id AS b
    FROM usable x JOIN usable y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
    WHERE list_dot_product(x.v, y.v)
        / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.93
),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_COMPONENTS},
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN components ON node = vec_id LEFT JOIN degrees ON a = vec_id
"""


def _licenses() -> str:
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
    templates = ", ".join(
        f"({i}, '{label}', {len(text.split())}, {sorted(set(text.split()))!r})"
        for i, (label, text) in enumerate(TEMPLATES)
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH phrases(label, p) AS (VALUES {phrases}),
    templates(template, label, n, tokens) AS (VALUES {templates}),
    texts AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce({_LOWER}, '') AS low FROM documents
    ),
    worded AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM texts),
    places AS (
        SELECT r, label, i - 1 AS place FROM (
            SELECT r, label, p, words, unnest(range(1, len(words) + 1)) AS i
            FROM worded, phrases WHERE len(list_intersect(words, p)) = len(p)
        )
        WHERE words[i] = p[1] AND words[i : i + len(p) - 1] = p
    ),
    base AS (
        SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
            list(DISTINCT label) AS labels
        FROM places GROUP BY r
    ),
    likely AS (
        SELECT r, template, label, n, tokens, len(tokens) AS size, words FROM worded, templates
        WHERE len(list_intersect(list_distinct(words), tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)
    ),
    found AS (
        SELECT r, template, label, n, size, i, words[i] AS word FROM (
            SELECT *, unnest(range(1, len(words) + 1)) AS i FROM likely
        ) WHERE list_contains(tokens, words[i])
    ),
    runs AS (
        SELECT a.r, a.template, a.label, a.size, a.i, count(DISTINCT b.word) AS shared
        FROM found a JOIN found b ON a.r = b.r AND a.template = b.template AND b.i BETWEEN a.i AND a.i + a.n - 1
        GROUP BY ALL
    ),
    shares AS (SELECT r, label, size, max(shared) AS shared FROM runs GROUP BY r, template, label, size),
    hits AS (
        SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS share
        FROM shares WHERE shared >= ceil({THRESHOLD} * size - 1e-9) GROUP BY r
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
        coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(
            coalesce(base.labels, []) || coalesce(hits.labels, []))), ','), '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
    FROM worded LEFT JOIN base USING (r) LEFT JOIN hits USING (r)
    """


SQL: dict[str, str] = {
    "op3_secret_ledger": _secrets(),
    "op6_warc": _WARC,
    "op7_minhash_dedup": _NEAR,
    "op8_license_scan": _licenses(),
    "op10_metric_join": _VECTORS,
}
