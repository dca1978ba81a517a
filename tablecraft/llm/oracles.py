"""SQL (DuckDB) for the numbered operators that SQL can express.

Written over the whole tables, with plain global windows.
"""

from __future__ import annotations

from tablecraft.llm import quality_rules

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIXING = f"""
WITH sized AS (
    SELECT doc_id, source, {WORDS}::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix-1'), 1, 16) AS place
    FROM documents),
per AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           list_extract([3.0::DOUBLE, 1.0, 2.0],
               (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1) AS weight
    FROM sized GROUP BY source),
lev AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap,
           (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
            - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0))
           / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM per
    WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
    SELECT source, source_size,
           CASE WHEN cap / weight <= level THEN cap
                ELSE weight * (SELECT max(level) FROM lev WHERE cap / weight > level) END AS target
    FROM lev),
done AS (
    SELECT s.*, t.source_size, t.target,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
    FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
    SELECT doc_id, size, place, copy,
           (done + copy * source_size)::BIGINT::DOUBLE / target AS time
    FROM done, (VALUES (0), (1)) c(copy) WHERE size > 0 AND target > 0),
taken AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT doc_id, sum(size) OVER (ORDER BY time, place, doc_id, copy
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
        FROM copies)
    WHERE used <= (SELECT sum(target) FROM tgt) GROUP BY doc_id)
SELECT d.doc_id, d.size, d.source_size, d.target,
       (coalesce(t.n, 0) * d.size)::BIGINT AS taken
FROM done d LEFT JOIN taken t ON t.doc_id = d.doc_id"""


def _class(name: str, pattern: str, rest: str) -> str:
    """Cut one class of characters out of ``rest``; its count is a difference."""
    return f"regexp_replace({rest}, '{pattern}', '', 'g') AS {name}"


POINTS = "[.,;:!?''\"()-]+"

# shares of eight classes of characters and of the common words, as rows
QUALITY = rf"""
WITH plain AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
cut AS (
    SELECT *, {_class("t1", r"\p{Ll}+", "text")}, {_class("t2", r"\p{Lu}+", "t1")},
           {_class("t3", r"\p{L}+", "t2")}, {_class("t4", r"\p{N}+", "t3")},
           {_class("t5", POINTS, "t4")}, {_class("t6", "[#*$%&|<>]+", "t5")},
           {_class("t7", r"[\x20\x09-\x0D]+", "t6")}
    FROM plain),
counted AS (
    SELECT *, [length(text) - length(t1), length(t1) - length(t2), length(t2) - length(t3),
               length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6),
               length(t6) - length(t7), length(t7)] AS cls
    FROM cut),
total AS (SELECT count(*) AS docs FROM counted),
cls AS (SELECT rid, lang, unnest(range(8)) AS k, unnest(cls) AS n FROM counted),
own AS (SELECT lang FROM counted WHERE lang IS NOT NULL GROUP BY lang
        HAVING count(*) >= 0.0001 * (SELECT docs FROM total)),
cref AS (
    SELECT lang, k, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1)::DOUBLE AS q
    FROM (SELECT lang, k, n FROM cls WHERE lang IN (SELECT lang FROM own)
          UNION ALL SELECT '(all)', k, n FROM cls) GROUP BY lang, k),
words AS (SELECT rid, lang, unnest(w) AS word FROM counted),
wcount AS (
    SELECT lang, word, count(*) AS n
    FROM (SELECT lang, word FROM words WHERE lang IN (SELECT lang FROM own)
          UNION ALL SELECT '(all)', word FROM words) GROUP BY lang, word),
wref AS (
    SELECT lang, word, n / total AS q FROM (
        SELECT *, sum(n) OVER (PARTITION BY lang)::DOUBLE AS total,
               row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rk FROM wcount)
    WHERE rk <= 16),
named AS (SELECT rid, coalesce(o.lang, '(all)') AS ref, length(text) AS chars, len(w) AS nw
          FROM counted c LEFT JOIN own o ON o.lang = c.lang),
cpair AS (
    SELECT n.rid, c.n / greatest(n.chars, 1)::DOUBLE AS p, r.q
    FROM named n JOIN cls c USING (rid) JOIN cref r ON r.lang = n.ref AND r.k = c.k),
seen AS (
    SELECT n.rid, r.word, count(*) AS n
    FROM named n JOIN words w USING (rid) JOIN wref r ON r.lang = n.ref AND r.word = w.word
    GROUP BY n.rid, r.word),
wpair AS (
    SELECT n.rid, coalesce(s.n, 0) / greatest(n.nw, 1)::DOUBLE AS p, r.q
    FROM named n JOIN wref r ON r.lang = n.ref LEFT JOIN seen s ON s.rid = n.rid AND s.word = r.word),
wall AS (
    SELECT * FROM wpair
    UNION ALL SELECT rid, 1 - sum(p), greatest(1 - sum(q), 0) FROM wpair GROUP BY rid),
cdist AS (SELECT rid, sqrt(greatest(sum({{gain}}), 0)) AS d FROM cpair GROUP BY rid),
wdist AS (SELECT rid, sqrt(greatest(sum({{gain}}), 0)) AS d FROM wall GROUP BY rid),
runs AS (
    SELECT rid, i, w[i:i+2] AS run FROM (
        SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM counted WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS n FROM runs)
          WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice)
        GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM counted),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM line
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
    SELECT c.rid, doc_id, len(w)::BIGINT AS n_words,
           (length(text) - cls[7])::BIGINT AS word_chars, cls[6]::BIGINT AS n_symbols,
           coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM counted c LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n.chars >= 200 AND c.d > {{most_class}}, false)
       AND NOT coalesce(f.n_words >= 100 AND w.d > {{most_word}}, false) AS kept
FROM failed f JOIN named n USING (rid) LEFT JOIN cdist c USING (rid) LEFT JOIN wdist w USING (rid)"""

GAIN = """CASE WHEN p > 0 THEN p / 2 * log2(2 * p / (p + q)) ELSE 0 END
          + CASE WHEN q > 0 THEN q / 2 * log2(2 * q / (p + q)) ELSE 0 END"""
QUALITY = (
    QUALITY.replace("{gain}", GAIN)
    .replace("{most_class}", str(quality_rules.MAX_CLASS_DISTANCE))
    .replace("{most_word}", str(quality_rules.MAX_WORD_DISTANCE))
)


BLANK_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# one edit leaves the first or the second half of the shorter length as it is
LINES = rf"""
WITH ln AS (
    SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
word AS (SELECT doc_id, no, trim(raw, {BLANK_ENDS}) AS line FROM ln
         WHERE trim(raw, {BLANK_ENDS}) <> ''),
firsts AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS pos FROM word GROUP BY line),
half AS (
    SELECT line, pos, len, len - len // 2 AS rest, len // 2 AS half
    FROM (SELECT line, pos, unnest([length(line), length(line) - 1]) AS len
          FROM firsts WHERE length(line) >= 16)),
pair AS (
    SELECT a.line, b.line AS earlier FROM half a JOIN half b
      ON a.len = b.len AND left(a.line, a.half) = left(b.line, b.half) AND b.pos < a.pos
    UNION
    SELECT a.line, b.line FROM half a JOIN half b
      ON a.len = b.len AND right(a.line, a.rest) = right(b.line, b.rest) AND b.pos < a.pos),
near AS (SELECT DISTINCT line FROM pair WHERE levenshtein(line, earlier) <= 1),
kept AS (SELECT pos.d AS doc_id, pos.n AS no FROM firsts WHERE line NOT IN (SELECT line FROM near)),
part AS (
    SELECT l.doc_id, l.no, l.raw, trim(raw, {BLANK_ENDS}) = '' AS blank, k.no IS NOT NULL AS kept
    FROM ln l LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.no = l.no)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_dropped, 0)::BIGINT AS n_dropped, md5(coalesce(new, '')) AS text_md5
FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) FILTER (NOT blank) AS n_lines,
           count(*) FILTER (NOT blank AND NOT kept) AS n_dropped,
           string_agg(raw, chr(10) ORDER BY no) FILTER (blank OR kept) AS new
    FROM part GROUP BY doc_id) p ON p.doc_id = d.doc_id"""


NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           list_dot_product(a.y, b.y)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positive AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                          ORDER BY n.score DESC, n.other)::INT AS rank,
       n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n
  ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""

# DuckDB has no CRC-32; 3988292384 is its polynomial, bits reversed.
TRIE = """
WITH crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
convs AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                         ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (
    SELECT conv_id, turns, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, len(conv_id::VARCHAR) + 1),
                     lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h
    FROM convs, crc),
built AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []),
                                  c.turns[c.h + 1:len(c.turns)]) AS turns
    FROM taken c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
walk AS (
    SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS ends
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
    FROM walk GROUP BY node, d),
child AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children,
           CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[d].t) END AS saved
    FROM nodes n LEFT JOIN child c USING (node, d)),
below AS (
    SELECT node[1:a] AS node, a AS d, sum(saved)::BIGINT AS saved_tokens,
           sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM known) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       b.n_leaves, b.saved_tokens, sha256(k.ids) AS ends_sha256
FROM known k JOIN below b USING (node, d)
LEFT JOIN nodes p ON k.d > 0 AND p.d = k.d - 1 AND p.node = k.node[1:k.d - 1]"""

REPEATS = """
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h
    FROM documents),
win AS (
    SELECT r, p, substr(h, 2 * p + 1, 400) AS w
    FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM doc)),
hit AS (SELECT r, p FROM win WHERE md5(w) IN (SELECT md5(w) FROM win GROUP BY 1 HAVING count(*) > 1)),
run AS (
    SELECT r, p, count(*) FILTER (far) OVER (PARTITION BY r ORDER BY p) AS run
    FROM (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200 AS far FROM hit)),
span AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY r, run),
gap AS (
    SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_ FROM span),
cut AS (
    SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept
    FROM gap JOIN doc USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES,
        "op7_quality_rules": QUALITY,
        "op9_mixing_sources": MIXING,
        "op11_hard_negatives": NEGATIVES,
        "op12_prefix_trie": TRIE,
        "op13_suffix_array_dedup": REPEATS,
    }
