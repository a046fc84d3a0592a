"""The contracts of the operators that SQL can express, for DuckDB, written from the definitions."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licenses import BAND, ENOUGH, templates

WORDS = r"[^\x20\x09-\x0D]+"
_NUMBERED = f"SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents"
_FOLDED = f"SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '%s') AS ws FROM documents"

OP2 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, md5(concat_ws(' ', doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
w AS (SELECT *, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, CASE k WHEN 0 THEN 1.5 WHEN 1 THEN 1 ELSE 0.5 END::DOUBLE AS a, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 1.5 END::DOUBLE AS b FROM r),
o AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(n) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
      FROM w WINDOW up AS (ORDER BY n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight >= 2 * n AS capped FROM o),
t AS (SELECT source AS src, n, a, b, CASE WHEN capped THEN 2 * n ELSE (SELECT level FROM f WHERE NOT capped ORDER BY n / weight, level LIMIT 1) * weight END AS target FROM f),
c AS (SELECT d.*, t.*, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS passes,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.src),
p AS (SELECT *, greatest(least(round(target - passes * n) - c0, size), 0) AS part FROM c),
m AS (SELECT *, passes + (part > 0)::INT AS reads FROM p),
x AS (SELECT *, coalesce(least((c0 + size / 2) / nullif(target, 0), 1), 1) AS first, coalesce(least(((reads - 1) * n + c0 + size / 2) / nullif(target, 0), 1), 1) AS last, 2 * a / (a + b) AS ra, 2 * b / (a + b) - 2 * a / (a + b) AS slope FROM m)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, (passes * size + part)::BIGINT AS taken, reads::INT AS reads,
       CASE WHEN reads > 0 THEN CASE WHEN slope = 0 THEN first ELSE (sqrt(greatest(ra * ra + 2 * slope * first, 0)) - ra) / slope END END AS position,
       CASE WHEN reads > 0 THEN CASE WHEN slope = 0 THEN last ELSE (sqrt(greatest(ra * ra + 2 * slope * last, 0)) - ra) / slope END END AS last_position
FROM x"""

OP5 = rf"""
WITH d AS ({_NUMBERED}),
w AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM win JOIN dup USING (s), range(35) AS o(k)),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

OP8 = rf"""
WITH RECURSIVE d AS ({_FOLDED % WORDS}),
sh AS (SELECT DISTINCT rid, s FROM (SELECT rid, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
shared AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN n a ON a.rid = u JOIN n b ON b.rid = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, edge.v FROM reach JOIN edge ON reach.other = edge.u),
least_id AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least_id USING (rid) LEFT JOIN n USING (rid)"""

OP9 = rf"""
WITH d AS ({_NUMBERED}),
win AS (SELECT rid, i, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) AS o(k) GROUP BY rid),
line AS (SELECT rid, count(*) AS n, count(DISTINCT x) AS one FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORDS}') GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_lines, (coalesce(line.n, 0) - coalesce(line.one, 0))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN line USING (rid)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 4 * n_words AND n_symbols > 3)::BIGINT + 8 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b"""


def _template_rows() -> str:
    return ", ".join(f"({n}, '{label}', {base}, {whole}, {len(w) - 1}, {q}, '{w[q]}', '{w[q + 1]}')" for n, label, base, whole, w in templates() for q in range(len(w) - 1))


OP10 = rf"""
WITH d AS ({_FOLDED % "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"}),
t(template, label, base, whole, length, q, w0, w1) AS (VALUES {_template_rows()}),
g AS (SELECT rid, unnest(range(0, len(ws) - 1)) AS p, unnest(ws[1 : len(ws) - 1]) AS w0, unnest(ws[2 : len(ws)]) AS w1 FROM d WHERE len(ws) > 1),
v AS (SELECT rid, template, label, base, whole, length, p - q AS d, q FROM g JOIN t USING (w0, w1)),
l AS (SELECT rid, template, d, CASE WHEN d - lag(d) OVER o <= CASE WHEN whole THEN 0 ELSE {BAND} END THEN 0 ELSE 1 END AS step FROM (SELECT DISTINCT rid, template, whole, d FROM v) WINDOW o AS (PARTITION BY rid, template ORDER BY d)),
s AS (SELECT rid, template, d, sum(step) OVER (PARTITION BY rid, template ORDER BY d) AS s FROM l),
spans AS (SELECT rid, label, base, whole, min(d) AS low, count(DISTINCT q) / length AS part FROM v JOIN s USING (rid, template, d) GROUP BY rid, template, label, base, whole, length, s),
ok AS (SELECT * FROM spans WHERE part >= CASE WHEN whole THEN 1 ELSE {ENOUGH} END),
a AS (SELECT rid, count(*) FILTER (base) AS n, min(low) FILTER (base) AS f, max(low) FILTER (base) AS l, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS bl, array_to_string(list_sort(list(DISTINCT label)), ',') AS al, max(part) AS score FROM ok GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (rid)"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

ORACLES = {"op2_mixing": OP2, "op5_substring_dedup": OP5, "op8_minhash": OP8, "op9_quality": OP9, "op10_licenses": OP10, "op11_middle": OP11}
