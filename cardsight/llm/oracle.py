"""DuckDB SQL for the operator queries whose results SQL can express, over the same whole tables."""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_CLOSURE = """
each_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.y FROM reach r JOIN each_way e ON r.b = e.x),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w
                     FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * both_have >= 90 * (nx.n + ny.n - both_have)),
ids AS (SELECT doc_id AS id FROM documents), {_CLOSURE}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d JOIN least ON d.doc_id = id LEFT JOIN n ON n.doc_id = d.doc_id"""

# Windows are compared by their MD5; what is removed is told from the gaps between the windows' starts.
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS f FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS before,
               lead(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS after
        FROM s JOIN f ON s.s = f.s WHERE f.f < s.doc_id),
edge AS (SELECT hit.doc_id, i, before, after, coalesce(before + 50, 0) AS free FROM hit
         WHERE before IS NULL OR after IS NULL OR i - before > 50),
gone AS (SELECT doc_id, CAST(sum(least(50, coalesce(after - i, 50))) AS BIGINT) AS n_removed,
                count(*) FILTER (WHERE before IS NULL OR i - before > 50) AS n_spans FROM hit GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN i > free THEN substr(h, 2 * free + 1, 2 * (i - free)) ELSE '' END
                || CASE WHEN after IS NULL THEN substr(h, 2 * (i + 50) + 1) ELSE '' END, '' ORDER BY i) AS kept
         FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP7 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
  AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
  AND list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
          AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_CLOSURE},
deg AS (SELECT x, count(*) AS n FROM each_way GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = id LEFT JOIN deg ON x = vec_id"""

OP10 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM win),
often AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM often) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(list_sum(list_transform(range(0, len(w), 100), lambda i: len(list_distinct(w[i + 1:i + 100])))), 0) AS n_distinct_words,
        length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_alpha,
        length(t) - length(replace(t, '!', '')) AS n_marks
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
k AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
f AS (SELECT *, {{bits}} AS fail_bits FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {{base}}) <> 0 AS base_failed, (fail_bits & {{web}}) = 0 AS kept, fail_bits
FROM f"""


def op10(rules: dict[str, str], base: int, web: int) -> str:
    """OP10 with the rules' conditions, and the masks of the base and the full policy."""
    bits = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(rules.values()))
    return (OP10.replace("{bits}", f"CAST({bits} AS BIGINT)").replace("{base}", str(base)).replace("{web}", str(web)))


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """doc_id, source, start, kind, end, value of one pattern's matches."""
    return f"""
SELECT doc_id, source, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{{{
    'a': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
    'n': length(m[i]), 'v': v[i]}}}})) AS s, {least} AS least
FROM (SELECT doc_id, source, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}) AS m,
             regexp_extract_all(t, {pattern}, {group}) AS v FROM d)"""


_ASSIGN = ("'((?i:password|passwd|secret|token|api_?key))[\"''']?\\x20*[:=]\\x20*[\"''']?([A-Za-z0-9+/_.=-]+)'"
           .replace("'''", "''"))

OP1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_found(0, _ASSIGN, 2, 12)} UNION ALL {_found(1, "'AKIA[A-Z0-9]+'", 0, 18)}
  UNION ALL {_found(2, "'[0-9a-f]+'", 0, 16)} UNION ALL {_found(3, "'[A-Za-z0-9+/_=-]{{{{20,}}}}'", 0, 20)}),
spans AS (SELECT doc_id, source, kind, s.a AS a, s.a + s.n AS b, s.v AS v FROM found WHERE length(s.v) >= least
  AND (kind < 3 OR (regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[a-z]') AND regexp_matches(s.v, '[A-Z]')))),
used AS (SELECT * FROM spans WHERE kind < 3 UNION ALL SELECT * FROM spans w WHERE kind = 3 AND NOT EXISTS (
  SELECT 1 FROM spans b WHERE b.kind < 3 AND b.doc_id = w.doc_id AND b.a < w.b AND b.b > w.a)),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM used GROUP BY v),
judged AS (SELECT used.*, owners, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS span
  FROM used JOIN own ON own.v = used.v),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1,
    count(*) FILTER (WHERE kind = 2) AS n2, string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base,
    string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR owners < 3) AS every,
    count(*) FILTER (WHERE owners >= 3) AS ex, count(*) FILTER (WHERE owners < 3) AS live FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(ex, 0) AS n_example,
       coalesce(live, 0) AS n_live
FROM d LEFT JOIN per ON per.doc_id = d.doc_id""".replace("{{", "{").replace("}}", "}")


OP13 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, payload_bytes >= 100 AND row_number() OVER w > 1 AS again
      FROM k WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM f"""


# CRC-32 by bytes: its table follows from the polynomial. Letters from U+00C0 to U+00FF are two bytes of UTF-8, the
# other characters of a key (digits, colon, minus, a-z) are one. Edit distances are taken over one-byte stand-ins.
_WIDE_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

OP11 = f"""
WITH RECURSIVE tbl AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}',
    '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS k FROM d WHERE length(run) >= 5 GROUP BY id, run),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM u),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, tbl),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
      FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_WIDE_LETTERS}', '{_STAND_INS}') AS c FROM s
      WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cutw AS (SELECT word, n, c, c AS sig FROM w
         UNION ALL SELECT word, n, c, substr(c, 1, i) || substr(c, i + 2) FROM (SELECT *, unnest(range(0, length(c))) AS i FROM w)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cutw a JOIN cutw b ON a.sig = b.sig AND a.word <> b.word
         WHERE levenshtein(a.c, b.c) = 1),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
top AS (SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND other_n = m GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form,
        CASE WHEN m >= 2 * w.n THEN m END AS form_n
      FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN top ON top.word = w.word),
way(word, at_word) AS (SELECT word, form FROM f WHERE form IS NOT NULL
  UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = at_word WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, at_word AS root FROM way JOIN f ON f.word = at_word WHERE f.form IS NULL)
SELECT f.word, n, form, coalesce(root, f.word) AS root, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word"""
