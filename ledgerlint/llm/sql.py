"""SQL for the expected results of the queries that SQL can state."""

from __future__ import annotations

from ledgerlint.llm import quality_rules

WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[p:p + 9] AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(gram) AS n FROM g),
places AS (SELECT doc_id, n, p, w[p:p + n - 1] AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths)),
hits AS (SELECT DISTINCT doc_id, n, p, gram FROM places SEMI JOIN g USING (gram)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits JOIN g USING (gram))
          GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: All measurements with explicit character classes; the bits and the verdict come from the rules' own numbers.
QUALITY = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
of_lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                    count(*) FILTER (WHERE regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS n_ellipsis_lines
             FROM lines GROUP BY r),
windows AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
again AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
of_windows AS (SELECT r, count(DISTINCT k) AS n_repeat_words
               FROM (SELECT r, unnest(range(p, p + 3)) AS k FROM again) GROUP BY r),
of_words AS (SELECT r, max(n) AS n_top_word, sum(n) FILTER (WHERE regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]')) AS n_letter_words
             FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CASE WHEN len(w) = 0 THEN 0 ELSE CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) END AS n_upper,
             CASE WHEN len(w) = 0 THEN 0 ELSE CAST(len(regexp_extract_all(t, '[A-Za-z]')) AS BIGINT) END AS n_cased,
             CAST(coalesce(n_top_word, 0) AS BIGINT) AS n_top_word,
             CAST(coalesce(n_letter_words, 0) AS BIGINT) AS n_letter_words,
             CAST(coalesce(n_ellipsis_lines, 0) AS BIGINT) AS n_ellipsis_lines
      FROM d LEFT JOIN of_lines USING (r) LEFT JOIN of_windows USING (r) LEFT JOIN of_words USING (r)),
f AS (SELECT *, CAST({" | ".join(f"(CASE WHEN {r.sql()} THEN {1 << r.bit} ELSE 0 END)" for r in quality_rules.RULES)}
              AS BIGINT) AS failed FROM m)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT {quality_rules.CURRENT.sql()} AS kept
FROM f
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
             coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

#: CRC-32 is spelled out with its table of 256 numbers; near words share a word without one character.
SPELLING = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
         WHERE length(run) >= 7),
bytes AS (SELECT run, list_transform(range(strlen(name || ':' || run)), lambda i:
                 CAST('0x' || substr(hex(encode(name || ':' || run)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM runs),
hashed AS (SELECT run, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295)) AS h
           FROM bytes, crc),
occurrences AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
                FROM hashed),
words AS (SELECT word, count(*) AS n FROM occurrences WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
without AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM without a JOIN without b USING (i, rest) WHERE a.word <> b.word
          UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
near AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY n_other DESC, other) AS best, max(n_other) AS best_n
         FROM pairs GROUP BY word, n),
forms AS (SELECT word, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n, n_near
          FROM near),
chain(word, reached, step) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
                          UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM words w LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""
