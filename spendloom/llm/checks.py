"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from spendloom.llm import lexical, mixing, negatives, substrings, topk
from spendloom.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql(documents: str = "documents") -> str:
    """The same measures, votes and estimation; the rounds are written out one after the other."""
    k = len(q.RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, bad, good) in enumerate(q.RULES))
    names = ", ".join(f"v{j}" for j in range(k))

    def theta(of: str, mass: str, guess: tuple[float, ...], prefix: str) -> list[str]:
        return [
            f"(sum(CASE WHEN v{j} = {at - 1} THEN {of} ELSE 0.0 END) + {q.ANCHOR}::DOUBLE * sum(n) * {g}::DOUBLE) / ({mass} + {q.ANCHOR}::DOUBLE * sum(n)) AS {prefix}{j}_{at}"
            for j in range(k)
            for at, g in enumerate(guess)
        ]

    def chance(source: str) -> str:
        pick = lambda prefix, j: f"CASE v{j} WHEN -1 THEN {prefix}{j}_0 WHEN 0 THEN {prefix}{j}_1 ELSE {prefix}{j}_2 END"
        odds = " + ".join(["ln(prior / (1 - prior))", *[f"ln({pick('g', j)}) - ln({pick('b', j)})" for j in range(k)]])
        return f"SELECT p.{names.replace(', ', ', p.')}, p.n, 1 / (1 + exp(-({odds}))) AS p FROM patterns p, {source}"

    first = [f"{g}::DOUBLE AS g{j}_{at}" for j in range(k) for at, g in enumerate(q.VOTES_IF_GOOD)]
    first += [f"{g}::DOUBLE AS b{j}_{at}" for j in range(k) for at, g in enumerate(q.VOTES_IF_BAD)]
    steps = [f"m0 AS (SELECT {q.PRIOR}::DOUBLE AS prior, {', '.join(first)})"]
    for r in range(1, q.ROUNDS + 1):
        prior = f"(sum(n * p) + {q.ANCHOR}::DOUBLE * sum(n) * {q.PRIOR}::DOUBLE) / (sum(n) + {q.ANCHOR}::DOUBLE * sum(n)) AS prior"
        found = ", ".join([prior, *theta("n * p", "sum(n * p)", q.VOTES_IF_GOOD, "g"), *theta("n * (1 - p)", "(sum(n) - sum(n * p))", q.VOTES_IF_BAD, "b")])
        steps.append(f"s{r} AS MATERIALIZED ({chance(f'm{r - 1}')})")
        steps.append(f"m{r} AS MATERIALIZED (SELECT {found} FROM s{r})")
    steps.append(f"final AS ({chance(f'm{q.ROUNDS}')})")
    same = " AND ".join(f"v.v{j} = f.v{j}" for j in range(k))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
  FROM {documents}),
spread AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
windows AS (
  SELECT r, pos, lead(pos, 4) OVER w IS NOT NULL AS whole,
    concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS five
  FROM spread WINDOW w AS (PARTITION BY r ORDER BY pos)),
counted AS (SELECT r, pos, whole AND count(*) FILTER (WHERE whole) OVER (PARTITION BY r, five) >= 2 AS twice FROM windows),
covered AS (
  SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM counted),
repeats AS (SELECT r, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY r),
lined AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
measured AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(list_distinct(words))::BIGINT AS n_distinct,
    (length(text) - length(translate(text, '{q.CAPITALS}', '')))::BIGINT AS n_capitals,
    (length(text) - length(translate(text, '!?', '')))::BIGINT AS n_shouts,
    (length(text) - length(translate(text, '.', '')))::BIGINT AS n_stops
  FROM docs d JOIN lined USING (r) LEFT JOIN repeats USING (r)),
voted AS (SELECT *, {votes} FROM measured),
patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY {names}),
{", ".join(steps)}
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({q.BASE_FAILED}) AS base_failed,
  NOT ({q.BASE_FAILED}) AND f.p >= {q.KEEP} AS kept
FROM voted v JOIN final f ON {same}"""


def poisson_mix_sql(documents: str = "documents") -> str:
    """Counts by a recursive walk up the distribution of each source."""
    u = f"""('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))), 1, 13))::BIGINT / {float(mixing.SCALE)}"""
    key = f"""('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''), copy::VARCHAR, 'order')), 1, 13))::BIGINT"""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, {mixing.POWER}) AS weight FROM {documents} GROUP BY source),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
walk AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rated
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), total + exp(log_p + ln(rate) - ln(k + 1)) FROM walk
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
drawn AS (SELECT *, {u} AS u FROM {documents}),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(w.k)::INT AS copies
  FROM (SELECT *, row_number() OVER () AS r FROM drawn) d LEFT JOIN walk w ON d.source IS NOT DISTINCT FROM w.source AND w.total <= d.u
  GROUP BY d.r, d.doc_id, d.text, d.lang, d.source, d.n_chars),
repeated AS (SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, copies))::INT AS copy FROM counted WHERE copies > 0)
SELECT *, {key} AS mix_key FROM repeated"""


def top_k_sql(embeddings: str = "embeddings") -> str:
    return f"""
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS v FROM {embeddings}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER () AS r FROM vectors),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= {topk.K}"""


def warc_sql(pages: str = "pages") -> str:
    """Base32 from the hexadecimal SHA-1: five digits are four characters."""
    char = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)"
    return f"""
WITH read AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM {pages}),
headed AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM read)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: {char}), 'string_agg', '') AS payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM headed"""


def substrings_sql(documents: str = "documents") -> str:
    """Every window as the list of its words."""
    n = substrings.WINDOW
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {substrings.LAST_ID}) AS d, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM {documents}),
windows AS (
  SELECT r, d, s, array_to_string(list_slice(words, s, s + {n - 1}), ' ') AS w
  FROM (SELECT r, d, words, unnest(range(1, len(words) - {n - 2})) AS s FROM docs WHERE len(words) >= {n})),
hit AS (SELECT r, s FROM (SELECT r, s, d, min(d) OVER (PARTITION BY w) AS first FROM windows) WHERE first < d),
spread AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
flagged AS (
  SELECT p.r, p.pos, p.word, max(h.s) OVER (PARTITION BY p.r ORDER BY p.pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM spread p LEFT JOIN hit h ON p.r = h.r AND p.pos = h.s),
kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM flagged GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


def hard_negatives_sql(embeddings: str = "embeddings") -> str:
    """All pairs of an anchor and a row."""
    n = negatives
    return f"""
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({n.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM {embeddings}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER () AS r FROM vectors),
pairs AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.r AS c, a.label = c.label AS same, list_dot_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT r, vec_id AS positive_id, c, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {n.LIMIT})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY p.r, p.c ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs q ON p.r = q.r AND NOT same AND {n.LOW} * positive_score <= 100 * score AND 100 * score <= {n.HIGH} * positive_score
QUALIFY rank <= {n.LIMIT}"""


def lexical_sql(documents: str = "documents", items: str = "benchmark") -> str:
    """Terms of documents and items side by side; weights and scores in whole numbers."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{term}') AS terms FROM {documents}),
items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({low}, '{term}') AS terms FROM (SELECT DISTINCT item_id, text FROM {items})),
total AS (SELECT count(*) AS n, sum(len(terms)) AS l FROM docs WHERE len(terms) > 0),
asked AS (SELECT i, unnest(terms) AS term FROM items),
times AS (SELECT i, term, count(*) AS times FROM asked GROUP BY ALL),
found AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM times) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found GROUP BY term),
sized AS (SELECT r, doc_id, (100 - {lexical.B100} + (({lexical.B100} * len(terms) * t.n) // t.l))::BIGINT AS m FROM docs, total t WHERE len(terms) > 0),
scores AS (
  SELECT i, r, doc_id, sum(times * w * (({lexical.ONE} * tf) // (1000 * tf + {lexical.K8} * m)))::BIGINT AS score
  FROM times JOIN found USING (term) JOIN weighted USING (term) JOIN sized USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scores JOIN items USING (i) WHERE score > 0 QUALIFY rank <= {lexical.TOP}"""
