"""SQL for DuckDB of the queries that SQL can express.

The others stand on functions that SQL lacks (merges by rank, XXH64, fitted models, chains); tests
hold them to the public libraries or to brute force.
"""

from __future__ import annotations

from turnloom.llm import license_scan, warc
from turnloom.llm.decontaminate import WINDOW


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    lines = f"regexp_replace(regexp_replace(regexp_replace({t}, {_quoted(license_scan._PROSE)}, 'cpr \\1', 'g'), {_quoted(license_scan._BLOCK)}, chr(10) || chr(10), 'g'), {_quoted(license_scan._COPYRIGHT)}, '', 'g')"
    t = f"CASE WHEN contains({t}, 'opyright') OR contains({t}, '©') OR contains({t}, '(c)') OR contains({t}, 'all rights reserved') THEN {lines} ELSE {t} END"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for a, b in license_scan.SPELLINGS:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
    named = "spelled"
    for pattern, standard in license_scan.HOLDERS:
        named = f"regexp_replace({named}, {_quoted(pattern)}, {_quoted(standard)}, 'g')"
    return f"(SELECT CASE WHEN contains(spelled, 'contributors') THEN {named} ELSE spelled END FROM (SELECT {t} AS spelled) s)"


def licenses() -> str:
    rows = ", ".join(f"({_quoted(i)}, {_quoted(k)}, {_quoted(t)})" for i, k, t in license_scan.KNOWN)
    whole = "sha256(trim(regexp_replace(canon, '[ \\n]+', ' ', 'g'), ' '))"
    return f"""WITH known AS (SELECT replace(kind, 'digest', 'text') AS kind, CASE WHEN kind = 'digest' THEN text ELSE {whole} END AS digest, min(license_id) AS license_id
            FROM (SELECT license_id, kind, text, {_canonical("text")} AS canon FROM (VALUES {rows}) v(license_id, kind, text)) k GROUP BY 1, 2),
        d AS (SELECT doc_id, {_canonical("text")} AS canon FROM documents),
        seen AS (SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices FROM (SELECT doc_id, trim(unnest(string_split(canon, chr(10))), ' ') AS line FROM d) l JOIN known k ON k.kind = 'notice' AND sha256(l.line) = k.digest GROUP BY doc_id)
        SELECT d.doc_id, {whole} AS digest, k.license_id, coalesce(s.notices, '') AS notices FROM d LEFT JOIN known k ON k.kind = 'text' AND k.digest = {whole} LEFT JOIN seen s ON s.doc_id = d.doc_id"""


def decontamination() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
        items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
        found AS (SELECT DISTINCT x.doc_id, x.i, x.n, win.item FROM (SELECT doc_id, z.n, i, array_to_string(w[i:i + z.n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(w) - z.n + 2)) AS t(i)) x JOIN win ON win.n = x.n AND win.s = x.s),
        places AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) q),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
        chunks AS (SELECT doc_id, i, sum(length(c[i])) OVER (PARTITION BY doc_id ORDER BY i) AS until, length(w[i]) AS n
            FROM (SELECT doc_id, {words.replace("'[^", "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*[^")} AS c, {words} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)) q, unnest(range(1, len(w) + 1)) AS t(i)),
        runs AS (SELECT c.doc_id, min(until - n) AS a, max(until) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM places) s JOIN chunks c ON c.doc_id = s.doc_id AND c.i = s.p GROUP BY c.doc_id, run),
        spans AS (SELECT doc_id, string_agg(concat(a, '-', b), ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) q GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
        FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id LEFT JOIN spans ON spans.doc_id = d.doc_id"""


def archives() -> str:
    return f"""SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM (SELECT page_id, html, CASE WHEN strlen(html) >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) p) q"""


def filter_audit() -> str:
    """Every document is led through all 120 orders, without inclusion and exclusion."""
    return """WITH l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
        d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
        f AS (SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic,
            concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > low THEN 'E' ELSE '' END) AS fails FROM d),
        r AS (SELECT part, good, toxic, fails, o, coalesce(list_min([i FOR i IN range(1, 6) IF contains(fails, o[i])]), 9) AS gone FROM f, orders),
        steps AS (SELECT part, o AS filter_order, s AS step, o[s] AS letter, count(*) FILTER (gone > s) AS kept, count(*) FILTER (gone = s) AS removed, count(*) FILTER (gone < s AND contains(fails, o[s])) AS redundant,
            count(*) FILTER (fails = o[s]) AS unique_fails, count(*) FILTER (gone = s AND good) AS good_lost, count(*) FILTER (gone = s AND toxic) AS toxic_lost FROM r, range(1, 6) q(s) GROUP BY part, o, s)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM steps"""


ORACLE = {"op2_license_scans": licenses(), "op7_decontamination": decontamination(), "op9_warc": archives(), "op12_filter_audit": filter_audit()}
