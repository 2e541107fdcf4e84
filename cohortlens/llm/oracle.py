"""Equivalent DuckDB SQL of the queries that SQL can express."""

from cohortlens.llm.op02_quality_rules import BASE_FAILED, CAPITALS, NO_LETTERS, RULES, SYMBOLS
from cohortlens.llm.op06_mixing import MARKS, MOST, SEED

_WORD, _SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def _chars(text: str) -> str:
    """A SQL expression of a string, control characters by their number."""
    return " || ".join(f"chr({ord(c)})" if c < " " or c == "'" else f"'{c}'" for c in text)


def _quality_rules(rounds: int = 25) -> str:
    votes = [f"v{i}" for i in range(len(RULES))]
    less = lambda chars: f"length(translate(t, {_chars(chars)}, ''))"
    ctes = [f"""d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents)""",
            "win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))",
            "rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1)",
            """cov AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM rep) GROUP BY doc_id)""",
            f"""f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - {less(SYMBOLS)})::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - {less(CAPITALS)} AS n_capitals, {less(NO_LETTERS)} AS n_letters,
  length(t) - {less('!')} AS n_exclaims, length(t) - {less('|')} AS n_pipes FROM d LEFT JOIN cov USING (doc_id))""",
            "v AS (SELECT *, " + ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END AS {n}" for r, n in zip(RULES, votes)) + " FROM f)",
            f"p AS MATERIALIZED (SELECT {', '.join(votes)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL)",
            "m0 AS (SELECT 0.5::DOUBLE AS g, " + ", ".join(f"0.4::DOUBLE AS b{n}, 0.02::DOUBLE AS g{n}" for n in votes) + ")"]
    odds = "ln(g / (1 - g)) + " + " + ".join(
        f"CASE {n} WHEN 0 THEN ln(g{n} / b{n}) WHEN 1 THEN ln((1 - g{n}) / (1 - b{n})) ELSE 0 END" for n in votes)
    for k in range(rounds):
        share = lambda n, q: f"(coalesce(sum(CASE WHEN {n} = 0 THEN n * {q} END), 0) + 1) / (coalesce(sum(CASE WHEN {n} IS NOT NULL THEN n * {q} END), 0) + 2)"
        ctes.append(f"m{k + 1} AS MATERIALIZED (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS g, "
                    + ", ".join(f"{share(n, '(1 - q)')} AS b{n}, {share(n, 'q')} AS g{n}" for n in votes)
                    + f" FROM (SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM p, m{k}))")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, "
            f"NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, m{rounds}")


_RATIO = "source_size / weight, source IS NULL, source"
_MIXING = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}+'))::BIGINT AS size,
  greatest(0.1::DOUBLE, coalesce(length(translate(text, {_chars(MARKS)}, ''))::DOUBLE / greatest(length(text), 1), 0.1::DOUBLE)) AS quality FROM documents),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)),
l AS (SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY {_RATIO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY {_RATIO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, min(CASE WHEN level * weight <= {MOST} * source_size THEN k END) OVER (ORDER BY {_RATIO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k0
  FROM (SELECT *, row_number() OVER (ORDER BY {_RATIO}) AS k FROM l)),
t AS (SELECT f.source, f.source_size, coalesce(least(a.level * f.weight, {MOST} * f.source_size::DOUBLE), {MOST} * f.source_size::DOUBLE) AS target
  FROM f LEFT JOIN f a ON a.k = f.k0),
k AS (SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key FROM s),
u AS (SELECT k.*, source_size, target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
  floor(target / greatest(source_size, 1)) AS whole FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND 2 * (upto - size) + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u"""

_EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
u AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(w) AS word FROM p) GROUP BY ALL),
b AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS a FROM
  (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS x FROM p) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS a FROM
  (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM p) GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM t UNION ALL SELECT lang, w2, w3, a FROM t) GROUP BY ALL),
two AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.a, x.c AS l, y.c AS r, (1000000::HUGEINT * b.a * b.a) // (x.c::HUGEINT * y.c) AS score FROM b
  JOIN u x ON x.lang = b.lang AND x.word = b.w1 JOIN u y ON y.lang = b.lang AND y.word = b.w2
  LEFT JOIN m ON m.lang = b.lang AND m.w1 = b.w1 AND m.w2 = b.w2 WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a),
cuts AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.c AS l1, tail.a AS r1, head.a AS l2, y.c AS r2,
  (1000000::HUGEINT * t.a * t.a) // (x.c::HUGEINT * tail.a) AS s1, (1000000::HUGEINT * t.a * t.a) // (head.a::HUGEINT * y.c) AS s2 FROM t
  JOIN u x ON x.lang = t.lang AND x.word = t.w1 JOIN u y ON y.lang = t.lang AND y.word = t.w3
  JOIN b head ON head.lang = t.lang AND head.w1 = t.w1 AND head.w2 = t.w2 JOIN b tail ON tail.lang = t.lang AND tail.w1 = t.w2 AND tail.w2 = t.w3),
c AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
  JOIN (SELECT lang, sum(c)::BIGINT AS n FROM u GROUP BY lang) USING (lang) WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _quality_rules(), "op6_mixing": _MIXING, "op7_exact_dedup": _EXACT_DEDUP,
                              "op12_warc": _WARC, "op13_phrases": _PHRASES}
