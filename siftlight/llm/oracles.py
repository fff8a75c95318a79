"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siftlight.llm import rule_ledger, secret_scan

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(place: int, rule: secret_scan.Rule) -> str:
    p = _quoted(rule.pattern)
    start = "(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))"
    return f"""SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1),
      lambda i: {{'start': {start}, 'end': {start} + m[i], 'size': q[i], 'place': {place}, 'kind': '{rule.kind}'}}), lambda x: x.size >= {rule.least})) AS x
    FROM (SELECT doc_id, list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS g,
      list_transform(regexp_extract_all(t, {p}), lambda x: length(x)) AS m,
      list_transform(regexp_extract_all(t, {p}, {rule.group}), lambda x: length(x)) AS q FROM d WHERE regexp_matches(t, {p}))"""


def secret_scans() -> str:
    rules = " UNION ALL ".join(_rule_sql(i, rule) for i, rule in enumerate(secret_scan.RULES))
    n = len(secret_scan.BASE_RULES)
    shown = "x.kind || ':' || x.start || ':' || x.end, ',' ORDER BY x.start, x.place, x.end"
    counts = ", ".join(f"count(*) FILTER (WHERE x.kind = '{rule.kind}') AS n_{rule.kind}" for rule in secret_scan.BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({rules}),
    f AS (SELECT doc_id, {counts}, string_agg({shown}) FILTER (WHERE x.place < {n}) AS base, string_agg({shown}) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secret_scan.BASE_RULES)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


def quality_rules() -> str:
    policy = rule_ledger.POLICIES["v2"]
    fails = {
        "few_words": "n_words < 20", "repeated_windows": "100 * n_repeat_words > 30 * n_words", "many_words": "n_words > 1000000",
        "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words", "symbols": "10 * n_symbols > n_words",
        "duplicate_lines": "2 * n_dup_lines > n_lines", "echoed_words": "4 * n_echo > n_words", "few_letters": "2 * n_letters < n_bytes",
        "ellipsis_lines": "10 * n_ellipsis > 3 * n_lines", "bullet_lines": "10 * n_bullets > 9 * n_lines",
    }
    rejected = " OR ".join(f"({fails[name]})" for name in policy.rules)
    base = " OR ".join(f"({fails[name]})" for name in rule_ledger.POLICIES["base"].rules)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(1)) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo,
      strlen(regexp_replace(t, '{_SPACE}', '', 'g')) AS n_bytes, strlen(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters,
      len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_SPACE}*$'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^{_SPACE}*[-*•]'))) AS n_bullets
      FROM w LEFT JOIN covered USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({rejected}) AS kept FROM m"""


def hard_negatives() -> str:
    return """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
    n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
