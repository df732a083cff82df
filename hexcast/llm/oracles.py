"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

SHARDS = 24

#: crc-32 by half bytes: the list literal holds the remainders of the 16 half bytes
_NIBBLES = list(range(16))
for _ in range(4):
    _NIBBLES = [(n >> 1) ^ (0xEDB88320 * (n & 1)) for n in _NIBBLES]


def crc32(text: str) -> str:
    """SQL of the unsigned crc-32 of a text's UTF-8 bytes."""
    halves = rf"regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '.')"
    numbers = f"list_transform({halves}, lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {numbers}), lambda c, n: xor(c >> 4, {_NIBBLES}[(xor(c, n) & 15) + 1])))"


CRC32 = crc32("coalesce(text, '')")

#: shard by the middle of the byte range; slots count from the shard's first row
SHARDING = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, CAST({CRC32} AS BIGINT) AS text_crc32 FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT *, CAST(least({SHARDS - 1}, ((before * 2 + size) * {SHARDS}) // (total * 2)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""

#: span(i, j): lines i to j hold upto(j) - upto(i) + length(i) characters with the line feeds between them
LINE_DEDUP = r"""
WITH doc AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT doc_id, unnest(generate_series(0, len(lines) - 1)) AS k, unnest(lines) AS line FROM doc
), sized AS (
  SELECT doc_id, k, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto,
    length(line) >= 160 OR (length(line) > 100 AND len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) > 50) AS alone FROM line
), span AS (
  SELECT a.doc_id, a.k AS low, b.k AS high, a.alone AS from_alone, b.alone AS to_alone
  FROM sized a JOIN sized b ON a.doc_id = b.doc_id AND b.k > a.k AND b.k <= a.k + 80 AND b.upto - a.upto + a.n >= 80
), run AS (
  SELECT doc_id, k AS low, k AS high FROM sized WHERE alone
  UNION SELECT doc_id, low, min(high) FROM span WHERE NOT from_alone GROUP BY doc_id, low
  UNION SELECT doc_id, max(low), high FROM span WHERE NOT to_alone GROUP BY doc_id, high
), part AS (
  SELECT doc_id, low, high, array_to_string(lines[low + 1 : high + 1], chr(10)) AS part FROM run JOIN doc USING (doc_id)
), placed AS (
  SELECT doc_id, low, high, first_value(doc_id) OVER w AS doc_0, first_value(low) OVER w AS low_0 FROM part
  WINDOW w AS (PARTITION BY part ORDER BY doc_id, low)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(low, high)) AS k FROM placed WHERE doc_id <> doc_0 OR low > low_0 + high - low
), short AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT lost), '') AS short, count_if(lost) AS n
  FROM (SELECT l.doc_id, l.k, l.line, g.k IS NOT NULL AS lost FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN n > 0 THEN short ELSE text END AS text, CAST(coalesce(n, 0) AS BIGINT) AS lines_removed FROM documents LEFT JOIN short USING (doc_id)
"""



def framed(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(map(framed, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def climbing(name: str, levels: int) -> str:
    """CTEs of the levels above {name}_0 (tree, idx, h): nodes by run of 16, where a tree's only node passes unhashed."""
    return ", ".join(
        f"""{name}_{k}_runs AS (SELECT tree, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM {name}_{k} GROUP BY ALL),
        {name}_{k + 1} AS (SELECT tree, run AS idx, CASE WHEN run = 0 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_{k}_runs)"""
        for k in range(levels)
    )


def folding(name: str, levels: int) -> str:
    """CTEs that carry {name}_at_0 (..., tree, idx, cur, proof) up the levels, adding siblings to proof and folding cur."""
    return ", ".join(
        f"""{name}_at_{k + 1} AS (SELECT a.* REPLACE (a.idx // 16 AS idx, proof || array_to_string(hs[:a.idx % 16], '') || array_to_string(hs[a.idx % 16 + 2:], '') AS proof,
          CASE WHEN run = 0 AND len(hs) = 1 THEN cur ELSE sha256(array_to_string(hs[:a.idx % 16], '') || cur || array_to_string(hs[a.idx % 16 + 2:], '')) END AS cur)
        FROM {name}_at_{k} a JOIN {name}_{k}_runs r ON a.tree = r.tree AND a.idx // 16 = r.run)"""
        for k in range(levels)
    )


LEVELS = 7  # 16 ** 7 rows of a source, and as many sources
MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), doc_0 AS (SELECT tree, idx, leaf AS h FROM placed), {climbing("doc", LEVELS)},
src_0 AS (SELECT 0 AS tree, tree AS idx, h FROM doc_{LEVELS}), {climbing("src", LEVELS)},
doc_at_0 AS (SELECT doc_id, leaf, tree, tree AS source_no, idx, coalesce(changed, leaf) AS cur, '' AS proof FROM placed), {folding("doc", LEVELS)},
src_at_0 AS (SELECT d.* REPLACE (0 AS tree, source_no AS idx), h AS subroot FROM doc_at_{LEVELS} d JOIN doc_{LEVELS} t ON d.source_no = t.tree), {folding("src", LEVELS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM src_at_{LEVELS}, src_{LEVELS}
"""

SCALES = [1 << k for k in range(17)]
#: lags from repeated windows of 1, 2, 4, ... words, numbered by hashes of two windows of half the length
PERIODIC = f"""
WITH chosen AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents
), sized AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM chosen
), looped AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(generate_series(0, n - 1), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM sized
), word AS (
  SELECT doc_id, n, unnest(generate_series(0, n - 1)) AS i, unnest(w) AS word FROM looped WHERE n > 0
), g_1 AS (SELECT doc_id, n, i, hash(word) AS g FROM word),
{", ".join(f"g_{2 * s} AS (SELECT doc_id, n, i, hash(g, lead(g, {s}) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM g_{s} WHERE n >= {4 * s} QUALIFY lead(i, {s}) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL)" for s in SCALES[:-1])},
lag AS (
  {" UNION ALL ".join(f"SELECT doc_id, q FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id, g ORDER BY i) AS q FROM g_{s}) WHERE q > {s // 2} AND q <= {s} GROUP BY ALL HAVING count(*) >= greatest(6, 4 * q) - q - {s} + 1" for s in SCALES)}
), same AS (
  SELECT l.doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY l.doc_id, q ORDER BY x.i) AS island
  FROM lag l JOIN word x ON x.doc_id = l.doc_id JOIN word y ON y.doc_id = x.doc_id AND y.i = x.i + q AND y.word = x.word
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(start ORDER BY length * 1000000000000 // period DESC, start, period) AS start, first(length ORDER BY length * 1000000000000 // period DESC, start, period) AS length,
    first(period ORDER BY length * 1000000000000 // period DESC, start, period) AS period FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_sharding": SHARDING, "op8_line_dedup": LINE_DEDUP, "op11_merkle": MERKLE, "op12_periodic_runs": PERIODIC}
