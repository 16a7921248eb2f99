"""DuckDB SQL for the queries that SQL can express."""

from classlens.llm.licenses import COPYRIGHT_LINE, KNOWN, OTHER, SPELLINGS

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH docs AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM docs),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS t FROM starts),
repeats AS (
    SELECT doc_id, p FROM (
        SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS nth FROM windows)
    WHERE nth > 1),
gone AS (
    SELECT DISTINCT doc_id, p + j AS i FROM (SELECT doc_id, p, unnest(range(0, 20)) AS j FROM repeats)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

EXACT_DEDUP = """
WITH docs AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
named AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS n FROM docs)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM named
"""

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce({WORDS}, []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM docs),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS x FROM starts),
twice AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, p + unnest(range(0, 8)) AS i FROM twice) GROUP BY doc_id),
base AS (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM docs LEFT JOIN covered USING (doc_id)),
counted AS (
    SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM base),
shares AS (
    SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS lines,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats
    FROM counted),
levels AS (
    SELECT grouping(lang, source) AS g, lang, source, count(*) AS n,
        quantile_disc(symbols, 0.25) AS a1, quantile_disc(symbols, 0.75) AS a3,
        quantile_disc(lines, 0.25) AS b1, quantile_disc(lines, 0.75) AS b3,
        quantile_disc(repeats, 0.25) AS c1, quantile_disc(repeats, 0.75) AS c3
    FROM shares GROUP BY GROUPING SETS ((lang, source), (lang), ())),
used AS (
    SELECT o.lang, o.source,
        CASE WHEN o.n >= 50 THEN [o.a1, o.a3, o.b1, o.b3, o.c1, o.c3]
             WHEN l.n >= 50 THEN [l.a1, l.a3, l.b1, l.b3, l.c1, l.c3]
             ELSE [e.a1, e.a3, e.b1, e.b3, e.c1, e.c3] END AS q
    FROM levels o JOIN levels l ON l.g = 1 AND l.lang IS NOT DISTINCT FROM o.lang JOIN levels e ON e.g = 3
    WHERE o.g = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND symbols <= q[2] + 3.0 * greatest(q[2] - q[1], 0.01)
        AND lines <= q[4] + 3.0 * greatest(q[4] - q[3], 0.15)
        AND repeats <= q[6] + 3.0 * greatest(q[6] - q[5], 0.09) AS kept
FROM shares s JOIN used u ON u.lang IS NOT DISTINCT FROM s.lang AND u.source IS NOT DISTINCT FROM s.source
"""

MIXING = rf"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len({WORDS}), 0) AS BIGINT) AS size,
        (CAST('0x' || substr(md5('20240601|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE)
            / 4503599627370496::DOUBLE AS u
    FROM documents),
sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
    FROM docs GROUP BY source),
weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (n - 1) % 3] AS w, 3 * source_size AS most FROM sizes),
levelled AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, n
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY most / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted),
aimed AS (
    SELECT source, source_size, least(most::DOUBLE,
        w * (SELECT arg_min(level, n) FROM (SELECT row_number() OVER (ORDER BY most / w, n) AS n, level
             FROM levelled WHERE most / w >= level))) AS target
    FROM levelled),
plan AS (
    SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
        least(target - floor(target / greatest(source_size, 1)) * source_size, source_size) AS rest FROM aimed),
counted AS (SELECT source, size, count(*) AS m FROM docs WHERE size > 0 GROUP BY source, size),
summed AS (
    SELECT source, size, coalesce(sum(m * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
        sum(m * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares
    FROM counted),
scaled AS (
    SELECT p.source, arg_max((rest - certain::DOUBLE) / squares, s.size) AS scale
    FROM plan p JOIN summed s ON p.source IS NOT DISTINCT FROM s.source
    WHERE rest > 0 AND (rest - certain::DOUBLE) / squares * s.size <= 1 GROUP BY p.source),
included AS (
    SELECT d.doc_id, d.size, d.u, p.*, least(greatest(least(coalesce(scale, 1.0::DOUBLE) * d.size, 1.0::DOUBLE), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS inside
    FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
    LEFT JOIN scaled s ON s.source IS NOT DISTINCT FROM d.source),
placed AS (SELECT *, (u / (1 - u)) / (inside / (1 - inside)) AS odds FROM included),
ranked AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id) - size / 2 AS half FROM placed)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN rest > 0 AND half <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

WARC = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce({WORDS}, []) AS w FROM (
        SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents)),
lists AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
    FROM docs),
shingles AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT x.a, x.b FROM (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) x
    JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b
    WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON doc_id = a GROUP BY a
"""


def _canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT_LINE}', ' ', 'g')), '{OTHER}', ' ', 'g')) || ' '"
    for variant, word in SPELLINGS:
        out = f"replace({out}, ' {variant} ', ' {word} ')"
    return f"trim({out})"


def license_scan() -> str:
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
WITH known AS (
    SELECT sha256({_canonical("t")}) AS digest, min(n) AS license FROM (VALUES {known}) k(n, t)
    WHERE {_canonical("t")} <> '' GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
matched AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
    FROM lines JOIN known ON digest = sha256({_canonical("line")}) GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM texts LEFT JOIN known USING (digest) LEFT JOIN matched USING (doc_id)
"""


#: CRC-32 of a text's UTF-8 bytes, by a table of 256 entries made from the polynomial.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS table_of)"""

SPELLING_VARIANTS = rf"""
WITH texts AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS run FROM texts),
distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM distinct_runs),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)],
            list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
        lambda c, b: xor(table_of[(xor(c, b) & 255) + 1], c >> 8))) AS h
    FROM hexed, {_CRC_TABLE}),
changed AS (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM summed),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
    SELECT word, i, word[1:i - 1] || word[i + 1:] AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b USING (i, s) WHERE a.word <> b.word
    UNION SELECT word, s FROM shorter WHERE s IN (SELECT word FROM words)
    UNION SELECT s, word FROM shorter WHERE s IN (SELECT word FROM words)),
ranked AS (
    SELECT a AS word, b AS near, w.n, o.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near,
        row_number() OVER (PARTITION BY a ORDER BY o.n DESC, encode(b)) AS place
    FROM pairs JOIN words w ON w.word = a JOIN words o ON o.word = b),
formed AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form,
        CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n
    FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
ways AS (
    WITH RECURSIVE step AS (
        SELECT word, form AS root, 1 AS k FROM formed WHERE form IS NOT NULL
        UNION ALL SELECT s.word, f.form, k + 1 FROM step s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
    SELECT word, arg_max(root, k) AS root FROM step GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed LEFT JOIN ways USING (word)
"""
