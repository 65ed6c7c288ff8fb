"""Check SQL of the masks over whole texts, without look-around: runs of digits, blanks and hyphens are
cut out, every admissible start and end in them is listed, and matches are taken from the left."""
from cityweave import vocabulary as v
from cityweave.functions import text as tx

from .base import lit

RUN = r"[0-9\s\-]{9,}"  # no number is shorter
NAME = v.NAME_PATTERN


def _cut(p: str, src: str, mapped: str, pattern: str) -> str:
    """{p}h: the hits of a pattern in the mapped text with their places, numbered within their text."""
    return f"""{p}m AS (SELECT k, text, {mapped} AS m FROM {src}),
{p}c AS (SELECT k, text, m, regexp_extract_all(m, '{pattern}') AS hits, list_transform(regexp_split_to_array(m, '{pattern}'), lambda x: length(x)) AS gaps FROM {p}m),
{p}u AS (SELECT k, text, m, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM {p}c),
{p}h AS (SELECT *, cast(1 + sum(gap + length(hit)) OVER (PARTITION BY k ORDER BY n) - length(hit) AS bigint) AS pos FROM {p}u)"""


def _rebuilt(p: str, src: str, tag: str) -> str:
    """{p}out: texts of ``src`` with the spans {p}sp (k, s, e) replaced by the tag."""
    return f"""{p}pc AS (SELECT {p}sp.k, s, e, substr(text, coalesce(lag(e) OVER (PARTITION BY {p}sp.k ORDER BY s), 0) + 1, s - coalesce(lag(e) OVER (PARTITION BY {p}sp.k ORDER BY s), 0) - 1) || '{tag}' AS piece FROM {p}sp JOIN {src} ON {src}.k = {p}sp.k),
{p}ag AS (SELECT k, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last, count(*) AS items FROM {p}pc GROUP BY k),
{p}out AS (SELECT {src}.k, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS text, coalesce({p}ag.items, 0) AS items FROM {src} LEFT JOIN {p}ag ON {p}ag.k = {src}.k)"""


def phones(p: str, src: str) -> str:
    word = r"regexp_replace(text, '[\p{L}\p{M}\p{Nl}_]', 'w', 'g')"
    blank = r"'[\s\-]'"
    bare = "CASE WHEN starts_with(d, '0091') AND length(d) = 14 THEN substr(d, 5) WHEN starts_with(d, '91') AND length(d) = 12 THEN substr(d, 3) WHEN starts_with(d, '0') AND length(d) = 11 THEN substr(d, 2) ELSE d END"
    return _cut(p, src, word, RUN) + f""",
{p}r AS (SELECT *, substr(m, pos - 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END) AS before, substr(m, pos - 2, CASE WHEN pos > 2 THEN 1 ELSE 0 END) AS before2, substr(m, pos + length(hit), 1) AS after FROM {p}h WHERE regexp_matches(hit, '[0-9]')),
{p}i AS (SELECT *, unnest(range(1, length(hit) + 1)) AS i FROM {p}r),
{p}ie AS (SELECT *, unnest(range(i + 8, least(i + 19, length(hit)) + 1)) AS e FROM {p}i WHERE regexp_matches(substr(hit, i, 1), '[0-9]') AND (CASE WHEN i > 1 THEN regexp_matches(substr(hit, i - 1, 1), {blank}) ELSE before <> 'w' END)),
{p}mt AS (SELECT k, n, any_value(pos) AS pos, any_value(hit) AS hit, any_value(before) AS before, any_value(before2) AS before2, i, max(e) AS e FROM {p}ie WHERE regexp_matches(substr(hit, e, 1), '[0-9]') AND (CASE WHEN e < length(hit) THEN regexp_matches(substr(hit, e + 1, 1), {blank}) ELSE after <> 'w' END) GROUP BY k, n, i),
{p}pk(k, n, i, e) AS (SELECT k, n, min(i), arg_min(e, i) FROM {p}mt GROUP BY k, n UNION ALL SELECT q.k, q.n, x.i, x.e FROM {p}pk q, LATERAL (SELECT i, e FROM {p}mt t WHERE t.k = q.k AND t.n = q.n AND t.i > q.e ORDER BY i LIMIT 1) x),
{p}dg AS (SELECT t.*, regexp_replace(substr(hit, t.i, t.e - t.i + 1), '[^0-9]', '', 'g') AS d FROM {p}pk JOIN {p}mt t USING (k, n, i)),
{p}sp AS (SELECT k, pos + i - 1 - CASE WHEN i = 1 AND before = '+' AND NOT regexp_matches(before2, '[w0-9]') THEN 1 ELSE 0 END AS s, pos + e - 1 AS e FROM (SELECT *, {bare} AS b FROM {p}dg) z WHERE length(b) = 10 AND substr(b, 1, 1) IN ('6', '7', '8', '9')),
""" + _rebuilt(p, src, v.PHONE_TAG)


def names(p: str, src: str) -> str:
    ascii_ = r"regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}\x00-\x7F]', '.', 'g'), '[^\x00-\x7F]', '0', 'g')"
    return _cut(p, src, ascii_, NAME) + f""",
{p}sp AS (SELECT k, pos AS s, pos + length(hit) - 1 AS e FROM {p}h WHERE len(list_intersect(regexp_split_to_array(hit, '\\s+'), {lit(tx.blocked_words())})) = 0),
""" + _rebuilt(p, src, v.NAME_TAG)


def check(table: str, keys: str, *masks) -> str:
    """The masks one after the other over a table's texts; items are added up."""
    ctes, src, items = [f"t0 AS (SELECT row_number() OVER () AS k, {keys}, text FROM {table})", "p0 AS (SELECT k, coalesce(text, '') AS text FROM t0)"], "p0", []
    for j, mask in enumerate(masks):
        ctes.append(mask(f"x{j}", src))
        src = f"x{j}out"
        items.append(f"{src}.items")
    joins = " ".join(f"JOIN x{j}out ON x{j}out.k = t0.k" for j in range(len(masks)))
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {keys}, {src}.text AS masked, {' + '.join(items)} AS items FROM t0 {joins}"
