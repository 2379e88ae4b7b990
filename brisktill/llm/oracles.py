"""SQL (DuckDB) that gives the rows of the registered queries, where SQL can.

The others need hashes, tokenizers or searches that SQL lacks; tests compare
those with brute force.
"""

from .quality import LEAST_DOCUMENTS, OCCURRENCES, RULES, SKETCH_BITS, SPREAD, WINDOW
from .sharding import ROUNDS

_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = "[#*$%&|<>]"


def _quality():
    ratios = ", ".join(f"CASE WHEN {of} > 0 THEN {n} * {scale} // {of} END AS {name}" for name, n, scale, of, _ in RULES)
    long = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{name}' AS rule, {name} AS v, {n} * {scale} AS total, {of} AS size, {OCCURRENCES * scale} AS spare "
        "FROM base WHERE NOT base_failed"
        for name, n, scale, of, _ in RULES
    )
    low = ", ".join(f"'{r[0]}'" for r in RULES if r[4])
    shift = lambda v: f"greatest(length(bin({v})) - {SKETCH_BITS}, 0)"
    end = lambda q: f"{q} + (1::BIGINT << {shift(q)}) - 1 AS {q}_end"
    quarters = ", ".join(f"list_sort(list(bucket))[(count(*) * {q} + 3) // 4] AS q{q}" for q in (1, 2, 3))

    def level(depth, keys):
        return f"level{depth} AS (SELECT {', '.join(['rule', *keys])}, count(*) AS n, {quarters} FROM sketch GROUP BY {', '.join(['rule', *keys])})"

    def chosen(q):
        return f"CASE WHEN a.n >= {LEAST_DOCUMENTS} THEN a.{q} WHEN b.n >= {LEAST_DOCUMENTS} THEN b.{q} ELSE c.{q} END AS {q}"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, t,
         regexp_extract_all(t, '{_WORD}') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
win AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS w
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, sum(least({WINDOW}, i - before)) AS n
            FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {WINDOW}) AS before FROM twice) GROUP BY rid),
word AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
stutter AS (SELECT rid, count(*) AS n FROM (SELECT rid, w = lag(w) OVER (PARTITION BY rid ORDER BY p) AS same FROM word) WHERE same GROUP BY rid),
counted AS (
  SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(stutter.n, 0) AS BIGINT) AS n_stutters
  FROM d LEFT JOIN covered ON d.rid = covered.rid LEFT JOIN stutter ON d.rid = stutter.rid),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM counted),
long AS ({long}),
sketch AS (SELECT rule, lang, source, (v >> s) << s AS bucket
           FROM (SELECT *, {shift("v")} AS s FROM long WHERE v IS NOT NULL)),
{level(2, ["lang", "source"])},
{level(1, ["lang"])},
{level(0, [])},
best AS (SELECT a.rule, a.lang, a.source, {chosen("q1")}, {chosen("q2")}, {chosen("q3")}
         FROM level2 a JOIN level1 b ON a.rule = b.rule AND a.lang IS NOT DISTINCT FROM b.lang JOIN level0 c ON a.rule = c.rule),
fence AS (SELECT rule, lang, source, CASE WHEN rule IN ({low}) THEN q2_end - {SPREAD} * (q2_end - q1) END AS low,
                 q2 + {SPREAD} * (q3_end - q2) AS high FROM (SELECT *, {end("q2")}, {end("q3")} FROM best)),
out AS (SELECT DISTINCT rid FROM long l JOIN fence f
        ON l.rule = f.rule AND l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source
        WHERE total > high * size + spare OR total < low * size - spare)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutters, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept
FROM base"""


_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text):
    """CRC-32 of a text, beside the table `crc`."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'),
                                                                lambda h: CAST('0x' || h AS BIGINT))),
                         lambda c, v: xor(c >> 8, tab[CAST(xor(c, v) & 255 AS INTEGER) + 1])), 4294967295)"""


def _sharding(shards=24, seed=0):
    def mixed(turn, half):
        return f"CAST('0x' || substr(md5('{seed}:{turn}:' || CAST({half} AS VARCHAR)), 1, 15) AS BIGINT)"

    body = "SELECT x, cur // b AS l, cur % b AS r, k, a, b, n FROM walk WHERE k = 0 OR cur >= n"
    for turn in range(ROUNDS):
        left = f"(l + {mixed(turn, 'r')} % a) % a AS l, r" if turn % 2 == 0 else f"l, (r + {mixed(turn, 'l')} % b) % b AS r"
        body = f"SELECT x, {left}, k, a, b, n FROM ({body})"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, {_crc("t")} AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM d),
side AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, (n + CAST(ceil(sqrt(n)) AS BIGINT) - 1) // CAST(ceil(sqrt(n)) AS BIGINT) AS b
         FROM (SELECT count(*) AS n FROM documents)),
walk AS (
  SELECT x, x AS cur, 0 AS k, a, b, n FROM numbered, side
  UNION ALL
  SELECT x, l * b + r AS cur, k + 1 AS k, a, b, n FROM ({body}))
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(cur % {shards} AS INTEGER) AS shard,
       CAST(cur // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk ON numbered.x = walk.x AND k > 0 AND cur < n"""


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _contamination():
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, {_TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT name, k, array_to_string(w[s:s + k - 1], ' ') AS gram
            FROM (SELECT name, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
grams AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
          FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT rid, p, k, name FROM grams JOIN windows USING (k, gram)),
words AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS place FROM hits) GROUP BY rid),
names AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, name FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(names.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN names USING (rid)"""


def _ranked():
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM benchmark),
asked AS (SELECT DISTINCT iid, term FROM (SELECT iid, unnest(w) AS term FROM i)),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
           FROM tf, total GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
scores AS (SELECT iid, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY iid, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (iid) WHERE rank <= 50"""


def _trie():
    return rf"""
WITH {_CRC_TABLE},
r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, n, c - c % 20 AS base, {_crc("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT c, count(*) AS n FROM r GROUP BY c), crc),
turns AS (
  SELECT a.c, r.i AS d, role, text FROM convs a JOIN r ON r.c = a.base AND r.i <= a.h
  UNION ALL
  SELECT a.c, r.i - a.h + least(a.h, coalesce(b.n, 0)) AS d, role, text
  FROM convs a JOIN r ON r.c = a.c AND r.i > a.h LEFT JOIN convs b ON b.c = a.base),
paths AS (
  SELECT c, d, CAST(list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS VARCHAR) AS prefix,
         len(regexp_extract_all(text, '{_WORD}')) AS words FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs),
found AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY d, prefix),
members AS (SELECT c, d, conv_id FROM paths JOIN found USING (d, prefix)),
tree AS (SELECT f.conv_id, f.d, f.n_convs, f.words, a.conv_id AS parent FROM found f LEFT JOIN members a ON a.c = f.conv_id AND a.d = f.d - 1),
children AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM tree WHERE d > 0 GROUP BY parent, d),
sums AS (
  SELECT a.conv_id, a.d, sum((t.n_convs - 1) * t.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM tree t JOIN members a ON a.c = t.conv_id AND a.d <= t.d LEFT JOIN children k ON k.conv_id = t.conv_id AND k.d = t.d
  GROUP BY a.conv_id, a.d),
ends AS (SELECT a.conv_id, a.d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
         FROM members a JOIN (SELECT c, max(d) AS d FROM paths GROUP BY c) USING (c, d) GROUP BY a.conv_id, a.d)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, t.parent AS parent_conv_id, t.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t JOIN sums s ON s.conv_id = t.conv_id AND s.d = t.d
LEFT JOIN children k ON k.conv_id = t.conv_id AND k.d = t.d LEFT JOIN ends e ON e.conv_id = t.conv_id AND e.d = t.d"""


ORACLES = {
    "op1_quality_rules": _quality(),
    "op6_sharding": _sharding(),
    "op11_prefix_trie": _trie(),
    "op12_benchmark_decontamination": _contamination(),
    "op13_ranked_search": _ranked(),
}
