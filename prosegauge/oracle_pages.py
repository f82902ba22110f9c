"""SQL that flattens the pages at hand for the check in another engine: visible text, its nodes, and list items.

Not an HTML parser: it states the flattening rules over a row of tags and texts,
as gaps and islands, for pages whose elements are those below, whose hidden
parts hold no tags of their own, and which have a body tag.
"""

from __future__ import annotations

from prosegauge.oracle import listed
from prosegauge.sources.seeds import HTML

#: Of these pages: elements that begin and end a line, the inline ones left out, and what holds no prose.
_LINES = "p|h1|div|ul|li|nav|article|footer|pre"
_SILENT_BLOCK = "<div (?:hidden|contenteditable)>[^<]*</div>|<p style='display: none'>[^<]*</p>"
_SILENT_INLINE = "<code>[^<]*</code>|<textarea>[^<]*</textarea>"


def seeded_html_sql() -> str:
    """pages with the same part of HTML as the queries' pages: before the end of the body, or at the end."""
    part = f"{listed(HTML)}[page_id % {len(HTML)} + 1]"
    return f"SELECT * REPLACE (CASE WHEN contains(html, '</body>') THEN replace(html, '</body>', {part} || '</body>') ELSE html || {part} END AS html) FROM pages"


def flat_ctes(source: str) -> str:
    """CTEs over source(id, html): nodes(id, seg_idx, buf_start, len), flat(id, t, n_chars, n_segments, li_total, li_bold).

    Tags and texts are rows in order (head and title cut off, a hidden part one
    row). A tag that begins or ends a line puts a line break in where the last
    thing put in was a text that doesn't end in one; a hidden block does so
    where it ends an open paragraph.
    """
    quote = lambda s: s.replace("'", "''")
    return f"""
bodies AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '<!-- -->'), '{quote(_SILENT_BLOCK)}', '<~block>', 'g'), '{quote(_SILENT_INLINE)}', '<~inline>', 'g') AS html FROM ({source})),
pieces AS (SELECT id, generate_subscripts(m, 1) AS i, unnest(m) AS x FROM (SELECT id, regexp_extract_all(html, '(?s)<!.*?>|<[^>]*>|[^<]+') AS m FROM bodies)),
typed AS (
  SELECT id, i, x, NOT starts_with(x, '<') AS is_text, regexp_full_match(x, '</?(?:{_LINES})(?:\\s[^>]*)?>|<br>') AS is_line, x = '<~block>' AS is_hidden,
    CASE WHEN regexp_matches(x, '\\A</?(?:{_LINES})\\b|\\A<~block>') THEN x END AS block,
    CASE WHEN NOT starts_with(x, '<') THEN regexp_replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') END AS own FROM pieces),
told AS (SELECT *, is_line OR is_hidden AND coalesce(lag(block IGNORE NULLS) OVER (PARTITION BY id ORDER BY i), '') = '<p>' AS breaks FROM typed),
kept_rows AS (SELECT id, i, is_text, own, lag(own) OVER w AS last_own, row_number() OVER w AS nth FROM told WHERE is_text OR breaks WINDOW w AS (PARTITION BY id ORDER BY i)),
put AS (SELECT id, i, is_text, CASE WHEN is_text THEN own WHEN last_own IS NOT NULL AND NOT ends_with(last_own, chr(10)) THEN chr(10) ELSE '' END AS own FROM kept_rows),
laid AS MATERIALIZED (SELECT id, i, is_text, own, CAST(sum(length(own)) OVER (PARTITION BY id ORDER BY i) - length(own) AS INTEGER) AS buf_start FROM put),
nodes AS MATERIALIZED (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS seg_idx, buf_start, CAST(length(own) AS INTEGER) AS len FROM laid WHERE is_text),
items AS (
  SELECT id, CAST(count(*) FILTER (WHERE x = '<li>') AS INTEGER) AS li_total, CAST(count(*) FILTER (WHERE x = '<li>' AND next IN ('<b>', '<strong>')) AS INTEGER) AS li_bold
  FROM (SELECT id, x, lead(x) OVER (PARTITION BY id ORDER BY i) AS next FROM pieces WHERE regexp_matches(x, '\\A</?[a-z~]')) GROUP BY id),
flat AS MATERIALIZED (
  SELECT id, t, CAST(length(t) AS INTEGER) AS n_chars, CAST(n AS INTEGER) AS n_segments, li_total, li_bold
  FROM (SELECT id, string_agg(own, '' ORDER BY i) AS t, count(*) FILTER (WHERE is_text) AS n FROM laid GROUP BY id) JOIN items USING (id))"""
