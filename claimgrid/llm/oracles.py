"""DuckDB texts of the training-data queries that SQL can express."""

from __future__ import annotations

from . import ball_codes, licenses, ranking, secrets


def _matches(kind: str) -> str:
    """Matches of one kind in every document, with their places in code points."""
    pattern = secrets.PATTERNS[kind].replace("'", "''")
    group = secrets.VALUE_GROUP[kind]
    return f"""
      SELECT doc_id, owner, '{kind}' AS kind, {secrets.ORDER[kind]} AS o, start, start + length(m) AS stop, value FROM (
        SELECT doc_id, owner, ms[i] AS m, vs[i] AS value,
          CAST(list_sum([length(g) FOR g IN gs[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, owner, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
            string_split_regex(t, '{pattern}') AS gs FROM texts)))
      WHERE {f"length(value) >= {secrets.MIN_LENGTH[kind]}" if kind != "owned" else
             f"regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') "
             f"AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT}"}"""


OP1 = f"""
  WITH texts AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
  found AS ({' UNION ALL '.join(_matches(k) for k in secrets.ORDER)}),
  owned AS (SELECT *, owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} AS live FROM (
    SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repositories FROM found GROUP BY value)),
  spans AS (
    SELECT f.*, live, owners, repositories FROM found f JOIN owned USING (value)
    WHERE kind <> 'owned' OR (live AND NOT EXISTS (SELECT 1 FROM found b
      WHERE b.doc_id = f.doc_id AND b.kind <> 'owned' AND b.start < f.stop AND b.stop > f.start))),
  per_doc AS (
    SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.ORDER)},
      count(*) FILTER (kind <> 'owned' AND live) AS n_live, count(*) FILTER (kind <> 'owned' AND NOT live) AS n_copied,
      max(owners) FILTER (kind <> 'owned') AS most_owners, max(repositories) FILTER (kind <> 'owned') AS most_repositories,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> 'owned') AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
    FROM spans GROUP BY doc_id)
  SELECT doc_id, {', '.join(f"coalesce({n}, 0) AS {n}" for n in (*(f"n_{k}" for k in secrets.ORDER), "n_live", "n_copied", "most_owners", "most_repositories"))},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM texts LEFT JOIN per_doc USING (doc_id)"""

# Base32 of the SHA-1: five bits a letter.
OP9 = """
  WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS h, CAST(CAST(from_hex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
  digests AS (
    SELECT page_id, url, strlen(h) AS payload_bytes, list_aggregate([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([CAST(substr(bits, 5 * i + k, 1) AS INTEGER) * (1 << (5 - k)) FOR k IN range(1, 6)]) AS INTEGER), 1)
        FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest FROM payloads),
  firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM digests)
  SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""

# Terms of the column ``text``, with A-Z in lower case.
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP11 = f"""
  WITH items AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
  words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
  sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
  corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
  held AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
              FROM held, corpus GROUP BY term, docs),
  gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS gain
            FROM held JOIN weights USING (term) JOIN sizes USING (doc_id), corpus),
  scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM items JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= {ranking.TOP}"""


def _nearest(number: int, books: str) -> str:
    """Nearest entry of every part: least distance, then least index."""
    return f"""
  near{number} AS (
    SELECT vec_id, label, p, x, min_by(e, d * {ball_codes.ENTRIES} + e) AS e, min(d) AS d FROM (
      SELECT parts.*, e, list_sum([(x[i] - y[i]) * (x[i] - y[i]) FOR i IN range(1, len(x) + 1)]) AS d FROM parts JOIN {books} USING (p)) GROUP BY vec_id, label, p, x)"""


def _moved(number: int, books: str) -> str:
    """Entries at the floored mean of their parts, or where they were."""
    return f"""
  books{number} AS (
    SELECT p, e, coalesce(new, y) AS y FROM {books} LEFT JOIN (
      SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY k) AS new FROM (
        SELECT p, e, k, CAST(sum(x[k]) AS BIGINT) AS total, count(*) AS n
        FROM near{number}, (SELECT unnest(range(1, width + 1)) AS k FROM size) GROUP BY p, e, k) GROUP BY p, e) USING (p, e))"""


OP12 = f"""
  WITH kept AS (
    SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  size AS (SELECT len(v) // {ball_codes.PARTS} AS width FROM kept ORDER BY vec_id LIMIT 1),
  parts AS (SELECT vec_id, label, p, v[p * width + 1 : (p + 1) * width] AS x
            FROM kept, size, (SELECT unnest(range({ball_codes.PARTS})) AS p)),
  seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ball_codes.ENTRIES}),
  books0 AS (SELECT p, e, x AS y FROM parts JOIN seeds USING (vec_id)),
  {_nearest(1, "books0")},{_moved(1, "books0")},
  {_nearest(2, "books1")},{_moved(2, "books1")},
  {_nearest(3, "books2")},
  codes AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM near3 GROUP BY vec_id, label)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256 FROM codes"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({k}, {_text(label)}, {_text(wording)}, {str(phrase).upper()})" for k, (label, wording, phrase) in enumerate(licenses.templates())
)
OP13 = f"""
  WITH templates AS (
    SELECT k, label, phrase, {_TERMS} AS own, len(own) AS size, CASE WHEN phrase THEN size ELSE {licenses.GRAM} END AS gram
    FROM (VALUES {_TEMPLATES}) AS x (k, label, text, phrase)),
  texts AS (SELECT doc_id, {_TERMS} AS words FROM documents),
  runs AS (SELECT doc_id, gram, i - 1 AS i, array_to_string(words[i : i + gram - 1], ' ') AS run FROM (
    SELECT *, unnest(range(1, len(words) - gram + 2)) AS i FROM texts, (SELECT DISTINCT gram FROM templates))),
  places AS (SELECT k, gram, t - 1 AS t, array_to_string(own[t : t + gram - 1], ' ') AS run FROM (
    SELECT *, unnest(range(1, size - gram + 2)) AS t FROM templates)),
  hits AS (SELECT doc_id, k, i, t, i - t AS diagonal FROM runs JOIN places USING (gram, run)),
  base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
           FROM hits JOIN templates USING (k) WHERE phrase GROUP BY doc_id),
  opened AS (SELECT h.*, (coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, k ORDER BY diagonal, t), {licenses.DRIFT + 1})
               > {licenses.DRIFT})::INT AS opens FROM hits h JOIN templates USING (k) WHERE NOT phrase),
  merged AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, k ORDER BY diagonal, t) AS part FROM opened),
  covered AS (SELECT doc_id, k, part, count(DISTINCT w) AS n FROM (
    SELECT *, unnest(range(t, t + {licenses.GRAM})) AS w FROM merged) GROUP BY doc_id, k, part),
  notices AS (SELECT doc_id, label, n / size AS share FROM covered JOIN templates USING (k) WHERE n / size >= {licenses.SHARE}),
  listed AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (
    SELECT * FROM notices UNION ALL SELECT doc_id, label, 1.0 FROM hits JOIN templates USING (k) WHERE phrase) GROUP BY doc_id)
  SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
  FROM texts LEFT JOIN base USING (doc_id) LEFT JOIN listed USING (doc_id)"""

ORACLES = {
    "op1_secret_ownership": OP1, "op9_warc_zip": OP9, "op11_mask_ranking": OP11, "op12_ball_codes": OP12, "op13_license_diagonals": OP13,
}
