"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from quillstone.llm import mixing


#: As many sweeps as bring the test tables' sums to their targets within the operator's tolerance.
SWEEPS = 60


def mixing_sql() -> str:
    """Sweeps as one common table expression for each dimension in turn."""
    keys = mixing.DIMENSIONS
    ctes = [
        r"""rows AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS text,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)""",
        """docs AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 64 THEN 'brief'
  WHEN (length(text) - length(replace(text, '|', ''))) * 8 > n_tokens THEN 'table'
  WHEN len(string_split(text, chr(10))) * 12 > n_tokens THEN 'list' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM rows)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    ctes += [f"t_{k} AS (SELECT {k}, s / sum(s) OVER () AS t_{k} FROM (SELECT {k}, pow(sum(tokens), {mixing.TEMPER}) AS s FROM cells GROUP BY {k}))" for k in keys]
    ctes.append(f"w0 AS (SELECT *, tokens AS w FROM cells {' '.join(f'JOIN t_{k} USING ({k})' for k in keys)})")
    for i in range(SWEEPS * len(keys)):
        k = keys[i % len(keys)]
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{k} / sum(w) OVER (PARTITION BY {k}) AS w) FROM w{i})")
    order = "ORDER BY w / tokens DESC, source, lang, topic"
    ctes += [
        f"fs AS (SELECT *, ({mixing.BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM w{SWEEPS * len(keys)})",
        "one AS (SELECT arg_max(f, w / tokens) AS f FROM fs WHERE f * w / tokens <= 1)",
        "mix AS (SELECT source, lang, topic, round(least(1.0, coalesce(one.f * w / tokens, 1.0)), 6) AS p FROM fs, one)",
    ]
    drawn = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < p"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, source, lang, topic, n_tokens, p FROM docs JOIN mix USING (source, lang, topic) WHERE {drawn}"


def chat_sql() -> str:
    """Prefixes are compared as whole rendered texts rather than by hash."""
    return r"""WITH turns AS (SELECT conv_id AS c, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS x FROM turns),
pre AS (SELECT *, md5(string_agg(length(role) || ':' || length(text) || x, '') OVER (PARTITION BY c ORDER BY k)) AS p, count(*) OVER (PARTITION BY c) AS n FROM shown),
whole AS (SELECT n, p, min(c) AS c, count(*) AS n_same FROM pre WHERE k = n GROUP BY n, p),
kept AS (SELECT c, n AS n_turns, n_same FROM whole w WHERE NOT EXISTS (SELECT 1 FROM pre i WHERE i.k = w.n AND i.p = w.p AND i.k < i.n))
SELECT c AS conv_id, (k - 1) // 256 AS part, n_turns, n_same, string_agg(x, '' ORDER BY k) AS text FROM shown JOIN kept USING (c) GROUP BY ALL"""
