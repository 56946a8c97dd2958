"""DuckDB SQL for the rows of those queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

# A turn is formatted as mark, role, line feed, text, mark, line feed; backslashes in a text are
# doubled and <| gets one between its characters.
CHAT_FORMATTING = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS formatted_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(formatted_chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

# Targets: sources in order of limit over weight; those before the first that keeps below its limit are
# full. Copies: the same inside a source, with 3 copies as the limit and log(1 + size) as the weight.
# Pareto sampling: in order of the rank, up to the words that whole copies leave.
MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s0 AS (
  SELECT source, sum(size) AS source_size, 3.0 * sum(size)::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
s1 AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level,
         row_number() OVER o AS k
  FROM s0 WINDOW o AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
s AS (
  SELECT source, source_size, CASE WHEN held * weight < cap THEN held * weight ELSE cap END AS target
  FROM s1, (SELECT coalesce(arg_min(level, k), 'infinity'::DOUBLE) AS held FROM s1 WHERE level * weight < cap)),
i0 AS (
  SELECT d.*, s.target, ln(1.0::DOUBLE + size) AS inclusion,
         (('0x' || substr(md5('0:' || doc_id || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE size > 0),
i1 AS (
  SELECT *, (target - 3 * (sum(size) OVER o - size)) / (sum(size * inclusion) OVER r) AS level, row_number() OVER o AS k
  FROM i0 WINDOW o AS (PARTITION BY source ORDER BY inclusion DESC, doc_id ROWS UNBOUNDED PRECEDING),
                 r AS (PARTITION BY source ORDER BY inclusion DESC, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i2 AS (
  SELECT i1.*, least(3.0::DOUBLE, coalesce(held, 'infinity'::DOUBLE) * inclusion) AS c
  FROM i1 LEFT JOIN (SELECT source, arg_min(level, k) AS held FROM i1 WHERE level * inclusion < 3 GROUP BY source) x
    ON i1.source IS NOT DISTINCT FROM x.source),
i3 AS (
  SELECT *, floor(c) AS whole, c - floor(c) AS part, target - sum(floor(c) * size) OVER (PARTITION BY source) AS rest FROM i2),
i4 AS (
  SELECT *, u * (1 - part) / (u * (1 - part) + part * (1 - u)) AS rank FROM i3),
i5 AS (
  SELECT doc_id, source, size, whole, part > 0 AND
         sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY part > 0 DESC, rank ROWS UNBOUNDED PRECEDING)
           - size / 2.0 <= rest AS drawn
  FROM i4)
SELECT d.doc_id, d.source, d.size, s.source_size::BIGINT AS source_size, s.target,
       CAST(coalesce(i5.whole + CASE WHEN i5.drawn THEN 1 ELSE 0 END, 0) * d.size AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN i5 ON d.doc_id = i5.doc_id
"""

# Classes of equal sets of five-word n-grams, all pairs of classes that share one, and what is reached from
# each class over pairs at 0.8 or more.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
gr AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
g AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS digest, count(*) AS n FROM gr GROUP BY doc_id),
c AS (SELECT digest, min(doc_id) AS copy_id, count(*) AS n_copies FROM g GROUP BY digest),
m AS (SELECT g.doc_id AS copy_id, g.n, gr.gram FROM g JOIN c ON g.doc_id = c.copy_id JOIN gr ON gr.doc_id = g.doc_id),
p AS (
  SELECT a.copy_id AS x, b.copy_id AS y, count(*) AS shared, any_value(a.n + b.n) AS both_n
  FROM m a JOIN m b ON a.gram = b.gram AND a.copy_id < b.copy_id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE shared * 100 >= 80 * (both_n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, root) AS (SELECT copy_id, copy_id FROM c UNION SELECT e.y, r.root FROM r JOIN e ON r.x = e.x),
top AS (SELECT x, min(root) AS class_id FROM r GROUP BY x),
links AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT w.doc_id, coalesce(top.class_id, w.doc_id) AS class_id, coalesce(c.copy_id, w.doc_id) AS copy_id,
       coalesce(c.n_copies, 1) AS n_copies, coalesce(links.n_links, 0) AS n_links
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN c ON g.digest = c.digest
LEFT JOIN top ON top.x = c.copy_id LEFT JOIN links ON links.x = c.copy_id
"""

# Cheapest edits by dynamic programming over a conversation's rows: for each state of the roles written so far
# (e nothing, s, u, a) the least (cost, audit), with the repaired rows that belong to it.
def _edit(state: str, cost: str, initial: str, written: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'p': {state}.p || '{initial}', 'r': {state}.r || {written}}}"


def _insert(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"chr(10) || '{role}:'")


def _rerole(state: str, role: str) -> str:
    return _edit(state, "CASE WHEN bad = 'x' THEN 1000000000 WHEN bad = 't' THEN 6 ELSE 3 END", "R", f"chr(10) || '{role}:' || text")


def _keep(state: str, initial: str) -> str:
    cost = f"CASE WHEN bad = 'x' OR left(role, 1) <> '{initial}' THEN 1000000000 WHEN bad = 't' THEN 3 ELSE 0 END"
    return _edit(state, cost, "K", "chr(10) || role || ':' || text")


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


_FAR = "{'c': 1000000000, 'p': '', 'r': ''}"
CHAT_REPAIR = rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM range(256) AS bytes(i))),
d0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
             lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
d1 AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d0 JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR fault = 3 WHERE fault <> 0),
d AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d1),
f AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM d),
l AS (SELECT conv_id, i, role, text, CASE fault WHEN 'truncated' THEN 't' WHEN 'none' THEN 'n' ELSE 'x' END AS bad FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
closed AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'p': '', 'r': ''}} AS e, {_FAR} AS s,
         {{'c': 3, 'p': 'I', 'r': chr(10) || 'user:'}} AS u, {{'c': 6, 'p': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
  FROM ids
  UNION ALL
  SELECT conv_id, i, e, s, u, {_least("a", _insert("u", "assistant"))} AS a FROM (
    SELECT conv_id, i, e, s, {_least("u", _insert("e", "user"), _insert("s", "user"), _insert("a", "user"))} AS u, a FROM (
      SELECT c.conv_id, l.i, {_edit("e", "4", "D")} AS e, {_least(_edit("s", "4", "D"), _keep("e", "s"))} AS s,
             {_least(_edit("u", "4", "D"), *(f(x, y) for x in "esa" for f, y in ((_rerole, "user"), (_keep, "u"))))} AS u,
             {_least(_edit("a", "4", "D"), _rerole("u", "assistant"), _keep("u", "a"))} AS a
      FROM closed c JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.i + 1))),
best AS (
  SELECT conv_id, {_least("e", "a")} AS b FROM closed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.p AS audit,
       sha256(substr(b.r, 2)) AS repaired_sha256
FROM best LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM best.conv_id
"""

# Phrases of one to four words inside pieces, counted by language; the least score over the cuts; candidates
# that a longer one covers go.
COLLOCATIONS = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, j, fl.f AS l, fr.f AS r,
         ((2000000::HUGEINT * cuts.a::HUGEINT) // (fl.f::HUGEINT + fr.f::HUGEINT))::BIGINT AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = cuts.x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = cuts.y),
least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
covering AS (SELECT lang, phrase, max(a) AS a FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT least.* FROM least LEFT JOIN covering v ON v.lang = least.lang AND v.phrase = least.phrase
  WHERE v.a IS NULL OR 100::HUGEINT * v.a < 80::HUGEINT * least.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""

# Every window of 35 words as text; the words of those that are there more than once go.
SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n_words FROM d),
s AS (
  SELECT *, CASE WHEN i + 34 <= n_words THEN sha256(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS passage
  FROM w),
r AS (SELECT passage FROM s WHERE passage IS NOT NULL GROUP BY passage HAVING count(*) > 1),
m AS (SELECT s.*, r.passage IS NOT NULL AS repeated FROM s LEFT JOIN r ON r.passage = s.passage),
c AS (
  SELECT *, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLES = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op3_mix_sources": MIX_SOURCES,
    "op4_chat_formatting": CHAT_FORMATTING,
    "op9_exact_dedup": EXACT_DEDUP,
    "op11_chat_repair": CHAT_REPAIR,
    "op12_collocations": COLLOCATIONS,
    "op13_substring_dedup": SUBSTRING_DEDUP,
}
