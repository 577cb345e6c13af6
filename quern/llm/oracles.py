"""SQL for the training-data queries that SQL can express.

Not expressed: operators 4 (models), 6 (merges by rank), 7 (sums of logarithms differ in their last digits), 8 (XXH64 and
components) and 10 (the slots' hash). tests/llm compares those with brute force.
"""

from quern.llm.quality import MAX_REPEATED, MIN_WORDS, PRIOR, RATES, UNIT

_SAFE = "replace(coalesce({}, ''), '<|', '< |')"

OP1 = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(turn // 64, -1) AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
r AS (
  SELECT m.*, perspective,
    CASE WHEN role = perspective THEN 't' ELSE '-' END AS train,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || replace({_SAFE.format('role')}, chr(10), ' ') END || chr(10) AS head,
    {_SAFE.format('text')} || '<|im_end|>' AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
)
SELECT conv_id, perspective, part, '' AS piece, count(*) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS text,
  string_agg(length(head) || '- ' || length(body) || train || ' 1-', ' ' ORDER BY turn, role, text) AS mask
FROM r GROUP BY conv_id, perspective, part
"""

#: Documents numbered by row, with their words (runs of what is not ASCII white space) as a list and one by one.
_WORDS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split)
"""

_BUCKET = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
_PER = {"word_length": "word_chars * 1000 // n_words", "symbols": "n_symbols * 10000 // n_words", "dup_lines": "n_dup_lines * 10000 // n_lines", "repeats": "n_repeat_words * 10000 // n_words"}


def _merged(keys: str, counts: str) -> str:
    """Cumulative weights of a sketch merged by keys."""
    by = f"{keys}, rate" if keys else "rate"
    return f"""(SELECT *, sum(weight) OVER (PARTITION BY {by} ORDER BY value) AS up, sum(weight) OVER (PARTITION BY {by}) AS whole
  FROM (SELECT {by}, value, sum(weight) AS weight FROM ({counts}) GROUP BY {by}, value))"""


_OUT = " AND ".join(f"NOT coalesce(bool_or(e.rate = '{k}' AND NOT (v BETWEEN low AND high)), FALSE)" for k in RATES)
_GIVEN = f"weight * {PRIOR * UNIT}::HUGEINT // whole"
_PERCENT = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in RATES.items()) + " END"
_FACTOR = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in RATES.items()) + " END"

OP2 = f"""{_WORDS},
tri AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM tri WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) t(j) GROUP BY r),
line AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT s.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(line.n - line.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(line.n, 0) AS n_lines
  FROM split s LEFT JOIN line ON s.r = line.r LEFT JOIN rep ON s.r = rep.r
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m),
e AS (SELECT r, lang, source, base_failed, p.rate, CASE p.rate {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _PER.items())} END AS v FROM b, (VALUES {", ".join(f"('{k}')" for k in RATES)}) p(rate) WHERE n_words > 0),
k AS (SELECT lang, source, rate, {_BUCKET.format("v")} AS value, count(*) * {UNIT}::HUGEINT AS weight FROM e WHERE NOT base_failed GROUP BY ALL),
g AS {_merged("", "SELECT * FROM k")},
la AS {_merged("lang", f"SELECT lang, rate, value, weight FROM k UNION ALL SELECT t.lang, g.rate, g.value, g.{_GIVEN} FROM (SELECT DISTINCT lang, rate FROM k) t JOIN g ON t.rate = g.rate")},
ls AS {_merged("lang, source", f"SELECT lang, source, rate, value, weight FROM k UNION ALL SELECT t.lang, t.source, la.rate, la.value, la.{_GIVEN} FROM (SELECT DISTINCT lang, source, rate FROM k) t JOIN la ON t.rate = la.rate AND t.lang IS NOT DISTINCT FROM la.lang")},
q AS (SELECT lang, source, rate, min(value) FILTER (up * 100 >= whole * 25) AS q1, min(value) FILTER (up * 100 >= whole * ({_PERCENT})) AS upper FROM ls GROUP BY ALL),
f AS (SELECT lang, source, rate, q1 - {_FACTOR} * (upper - q1) AS low, upper + (1 << greatest(length(bin(upper)) - 6, 0)) - 1 + {_FACTOR} * (upper - q1) AS high FROM q),
ok AS (SELECT r, {_OUT} AS inside FROM e JOIN f ON e.rate = f.rate AND e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, TRUE) AS kept
FROM b LEFT JOIN ok ON b.r = ok.r
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
it AS (SELECT row_number() OVER () AS k, item_id, words, least(len(words), 10) AS size FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, text, {_TERMS} AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
iw AS (SELECT DISTINCT k, size, array_to_string(words[s : s + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM it)),
dw AS (SELECT r, s, size, array_to_string(words[s : s + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)),
occ AS (SELECT r, s, iw.size, k FROM dw JOIN iw ON dw.gram = iw.gram AND dw.size = iw.size),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(s, s + size)) AS place FROM occ) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM occ JOIN it ON occ.k = it.k GROUP BY r),
term AS (SELECT k, words, unnest(list_distinct(words)) AS word FROM it),
n AS (SELECT word, count(*) AS n FROM w WHERE word IN (SELECT word FROM term) GROUP BY word),
rk AS (SELECT k, word, 2 * len(words) AS span, row_number() OVER (PARTITION BY k ORDER BY n, word) - 1 AS number, count(*) OVER (PARTITION BY k) AS present, len(list_distinct(words)) AS size FROM term JOIN n USING (word)),
rare AS (SELECT k, word, span, number, least(present, 8) AS n_terms FROM rk WHERE number < 8 AND present >= ceil(size * 0.6::DOUBLE)),
close AS (SELECT k, r, 2 * pos // span - j AS place, count(DISTINCT number) AS n, max(n_terms) AS n_terms FROM w JOIN rare ON w.word = rare.word, (VALUES (0), (1)) t(j) GROUP BY ALL),
near AS (SELECT r, count(DISTINCT item_id) AS n FROM (SELECT DISTINCT k, r FROM close WHERE n >= ceil(n_terms * 0.6::DOUBLE)) c JOIN it ON c.k = it.k GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN ids ON d.r = ids.r LEFT JOIN near ON d.r = near.r
"""

OP5 = f"""{_WORDS},
win AS (SELECT r, doc_id, s, md5(array_to_string(words[s : s + 12], ' ')) AS gram FROM (SELECT *, unnest(range(1, len(words) - 11)) AS s FROM split WHERE len(words) >= 13)),
first AS (SELECT gram, min(doc_id) AS least FROM win GROUP BY gram HAVING count(*) > 1),
bad AS (SELECT DISTINCT r, s + j AS i FROM win JOIN first ON win.gram = first.gram AND (doc_id > least OR doc_id IS NULL AND least IS NOT NULL), range(13) t(j)),
kept AS (SELECT w.r, count(*) AS n, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN bad ON w.r = bad.r AND w.i = bad.i GROUP BY w.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.r = kept.r
"""

OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
piece AS (SELECT r, n, base, substr(h, 2 * base + 1, 2 * (500 + 399)) AS part FROM (SELECT *, unnest(range(0, n - 399, 500)) AS base FROM d WHERE n >= 400)),
win AS (SELECT r, base + j AS s, md5(substr(part, 2 * j + 1, 800)) AS key FROM (SELECT *, unnest(range(0, least(500, n - 399 - base))) AS j FROM piece)),
hit AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY key) AS c FROM win) WHERE c > 1),
step AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM step) GROUP BY r, k),
edge AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, b FROM span),
cut AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM span GROUP BY r),
kept AS (SELECT e.r, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS h FROM edge e JOIN d ON e.r = d.r GROUP BY e.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut.r IS NULL THEN d.h ELSE kept.h || substr(d.h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r LEFT JOIN kept ON d.r = kept.r
"""

ORACLES = {"op1_chat_rotation": OP1, "op2_quality_rules": OP2, "op3_decontamination": OP3, "op5_substring_dedup": OP5, "op9_suffix_dedup": OP9}
