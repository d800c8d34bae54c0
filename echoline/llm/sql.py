"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from echoline.llm.url_filter import SOFT_HITS, SOFT_TERMS, STRICT_TERMS

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(f.first < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""



def _term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"


OP4 = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, low, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), hosted AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    ({" + ".join(map(_term, STRICT_TERMS))})::INT AS strict_hits,
    ({" + ".join(map(_term, SOFT_TERMS))})::INT AS soft_hits
  FROM hosted
)
SELECT page_id, host, path, rule, strict_hits, soft_hits,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_hits * {SOFT_HITS} + soft_hits >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

#: Escapes add a character to each control string in a text; a turn has two controls, a turn of another role three and the role's name.
OP11 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*/s>)', '<\\\1', 'g'), '\[(\\*(/?(SYS|INST|ROLE)|ANS|TEXT)\])', '[\\\1', 'g')) AS chars,
         CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END AS around
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + around)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, unnest(flatten([[ws[i : i + k - 1] for i in range(1, greatest(len(ws) - k + 2, 1))] for k in [1, 2, 3, 4]])) AS p FROM split
), counted AS (
  SELECT lang, p, count(*)::BIGINT AS f FROM grams GROUP BY lang, p HAVING count(*) >= 30
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counted WHERE len(p) > 1
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p[1 : c.k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : ]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, f, unnest(flatten([[p[i : i + m - 1] for i in range(1, len(p) - m + 2)] for m in range(2, len(p))])) AS p FROM counted WHERE len(p) > 2
), longer AS (
  SELECT lang, p, max(f) AS longest FROM inner_phrases GROUP BY lang, p
), kept AS (
  SELECT s.*, list_aggregate(s.p, 'string_agg', ' ') AS phrase FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p
  WHERE g.longest IS NULL OR 100::HUGEINT * g.longest < 80::HUGEINT * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

ORACLE_SQL = {"op4_url_filter": OP4, "op10_line_dedup": OP10, "op11_chat_format": OP11, "op13_collocations": OP13}
