"""DuckDB SQL for the queries of queries.py that SQL can express in good time over whole tables."""

from __future__ import annotations

import unicodedata

from ..functions import script as S

# The character classes, from Python's own tables and the CV forms instead of the library's patterns.
_SPACES = "".join(f"\\x{{{c:X}}}" for c in range(0x110000) if chr(c).isspace())
_WS = _SPACES
_KEPT = r"\x{1200}-\x{137F}\x{1380}-\x{139F}\x{2D80}-\x{2DDF}0123456789" + _SPACES + r"\-.,:?!\x{FEFF}"
_WORD = rf"([\-.,:?!\x{{1361}}\x{{1362}}\x{{1363}}]|[^\-.,:?!\x{{1361}}\x{{1362}}\x{{1363}}{_SPACES}]+)"
_LABIAL = "".join(sorted(cv[0] for _, cv in S.fidel_pairs() if len(cv) == 3))
_PLAIN = "".join(sorted({cv[0] for _, cv in S.fidel_pairs() if len(cv) > 1}))
_UNIT = f"(?s)[{_LABIAL}]ኡኣ|[{_PLAIN}][አኡኢኣኤእኦ]|."
_FOREIGN = f"[^{_KEPT}]"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _normal(t: str) -> str:
    a = f"regexp_replace({t}, {_lit(f'{_FOREIGN}*[A-Za-z\\x{{4E00}}-\\x{{9FFF}}]{_FOREIGN}*')}, ' ', 'g')"
    b = f"regexp_replace({a}, {_lit(r'([^\P{Nd}0-9])')}, ' \\1 ', 'g')"
    return f"regexp_replace({b}, {_lit(f'[^{_KEPT}\\p{{Nd}}]+')}, ' ', 'g')"


def _one_space(t: str) -> str:
    return f"regexp_replace({t}, {_lit(f'[{_WS}]+')}, ' ', 'g')"


def _mapping(pairs: list[tuple[str, str]]) -> str:
    return f"MAP {{{', '.join(f'{_lit(a)}: {_lit(b)}' for a, b in pairs)}}}"


def _docs(table: str, key: str, name: str) -> str:
    return f"{name} AS (SELECT {key} AS doc_id, translate(lower(text), '{S.LATIN}', '{S.GLYPHS}') AS text FROM {table})"


_PAIRS = S.fidel_pairs()
_DECOMPOSE, _RECOMPOSE = _mapping(_PAIRS), _mapping([(b, a) for a, b in _PAIRS])


def _cv(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: coalesce(map_extract_value({_DECOMPOSE}, c), c)), '')"


def _back(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, {_lit(_UNIT)}), lambda c: coalesce(map_extract_value({_RECOMPOSE}, c), c)), '')"


_DOCS = _docs("documents", "doc_id", "docs")


def _words(docs: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all({_normal('text')}, {_lit(_WORD)}, 1)) AS word FROM {docs})"


def _segments(words: str, tokens: str, first_run: bool, name: str, most: str = "1000") -> str:
    """name(word, k, piece): the walk over each word."""
    lengths = (
        f"SELECT word, i, max(l) AS l FROM (SELECT *, l - row_number() OVER (PARTITION BY word, i ORDER BY l) AS g, min(l) OVER (PARTITION BY word, i) AS m FROM {name}_hit) WHERE g = m - 1 GROUP BY word, i"
        if first_run
        else f"SELECT word, i, max(l) AS l FROM {name}_hit GROUP BY word, i"
    )
    return f"""{name}_hit AS MATERIALIZED (
  SELECT s.word, s.i, s.l FROM (SELECT word, i, unnest(range(1, least(length(word) - i + 1, {most}) + 1)) AS l FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {words})) s
  WHERE substr(s.word, s.i, s.l) IN (SELECT token FROM {tokens})
), {name}_nx AS MATERIALIZED ({lengths}), {name}_walk AS (
  SELECT word, CAST(1 AS BIGINT) AS at_, CAST(0 AS BIGINT) AS k FROM {words} WHERE length(word) > 0
  UNION ALL
  SELECT w.word, w.at_ + coalesce(n.l, 1), w.k + 1 FROM {name}_walk w LEFT JOIN {name}_nx n ON n.word = w.word AND n.i = w.at_ WHERE w.at_ + coalesce(n.l, 1) <= length(w.word)
), {name} AS MATERIALIZED (
  SELECT w.word, w.k, w.at_, substr(w.word, w.at_, coalesce(n.l, 1)) AS piece FROM {name}_walk w LEFT JOIN {name}_nx n ON n.word = w.word AND n.i = w.at_
)"""


def _affixes(words: str, name: str) -> str:
    return f"""{name}_long AS (SELECT word FROM {words} WHERE length(word) > 1), {name}_tok AS (SELECT word AS token FROM {words}),
{_segments(f"{name}_long", f"{name}_tok", True, f"{name}_p")}, {name} AS MATERIALIZED (
  SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS token, 'prefix' AS role FROM {words}
  UNION
  SELECT piece, CASE WHEN n = 1 THEN 'stem' WHEN n = 2 AND l0 >= l1 THEN CASE k WHEN 0 THEN 'stem' ELSE 'suffix' END WHEN n = 2 THEN CASE k WHEN 0 THEN 'prefix' ELSE 'stem' END
    ELSE CASE k WHEN 0 THEN 'prefix' WHEN 1 THEN 'stem' ELSE 'suffix' END END
  FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n, max(length(piece)) FILTER (k = 0) OVER (PARTITION BY word) AS l0, max(length(piece)) FILTER (k = 1) OVER (PARTITION BY word) AS l1 FROM {name}_p)
)"""


def _values(tokens: list[str]) -> str:
    return ", ".join(f"({_lit(t)})" for t in sorted(set(tokens)))


def _ids(tokens: str, rank: str = "0") -> str:
    return f"SELECT token, CAST(row_number() OVER (ORDER BY {rank}, -length(token), token) + 1 AS BIGINT) AS base_id FROM ({tokens})"


_BASE = f"WITH RECURSIVE {_DOCS}, {_words('docs', 'words')}"
_CVW = f"{_BASE}, cvw AS MATERIALIZED (SELECT DISTINCT {_cv('word')} AS word FROM words)"
_GMS_FIXED = _values([*S.custom_tokens(), " "])
_CV_FIXED = [*(b for _, b in _PAIRS), " "]
_CONV = _docs("conversations", "conv_id", "conv")
_GMS = f"{_BASE}, {_affixes('words', 'roles')}, vocab AS MATERIALIZED ({_ids(f'SELECT token FROM roles UNION SELECT * FROM (VALUES {_GMS_FIXED}) t(token)')})"
_BOTH = f"{_BASE}, {_affixes('words', 'roles')}, {_CONV}, {_words('conv', 'words2')}, {_affixes('words2', 'roles2')}, vocab AS ({_ids(f'SELECT token FROM roles UNION SELECT token FROM roles2 UNION SELECT * FROM (VALUES {_GMS_FIXED}) t(token)')})"
_ENCODED = f"""{_GMS}, every AS MATERIALIZED (SELECT * FROM vocab UNION ALL VALUES ('<unk>', 0), ('<pad>', 1)), u AS MATERIALIZED (
  SELECT doc_id, upos, raw, regexp_replace(raw, {_lit(f'^[{_WS}]+')}, '') AS unit FROM (SELECT doc_id, unnest(r) AS raw, unnest(range(1, len(r) + 1)) AS upos FROM (SELECT doc_id, regexp_extract_all(text, {_lit(f'([{_WS}]*(?:, |,|[^{_WS},]+))')}, 1) AS r FROM docs))
), uw AS MATERIALIZED (SELECT DISTINCT unit AS word FROM u), {_segments('uw', 'every', False, 'seg', '(SELECT max(length(token)) FROM every)')}, t AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY upos, k) - 1 AS pos, piece, coalesce(base_id, 0) AS base_id, CASE WHEN base_id > 0 THEN piece ELSE '<unk>' END AS token, k = 0 AND length(raw) > length(unit) AS spaced,
    CASE WHEN k = 0 THEN raw_start ELSE raw_start + length(raw) - length(unit) + at_ - 1 END AS start_, raw_start + length(raw) - length(unit) + at_ - 1 + length(piece) AS end_
  FROM (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY upos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_start FROM u) x JOIN seg ON seg.word = x.unit LEFT JOIN every ON every.token = piece
)"""
# ---------------------------------------------------------------- the other models: rules as CASE chains and a recursive chain of prefixes


def _case(affixes: list[str], when: str, then: str = "{cv}") -> str:
    """The first listed affix for which `when` holds; {cv}, {x} and {n}: its CV form, the affix and the form's length."""
    each = ((x, S.decompose_py(x)) for x in affixes)
    return f"CASE {' '.join(f'WHEN {when} THEN {then}'.format(cv=_lit(c), x=_lit(x), n=len(c)) for x, c in each)} END"


def _rows(affixes: list[str]) -> str:
    return ", ".join(f"({k}, {_lit(x)}, {_lit(S.decompose_py(x))})" for k, x in enumerate(affixes))


_CV_VOCAB = f"{_CVW}, {_affixes('cvw', 'roles')}, vocab AS MATERIALIZED ({_ids(f'SELECT token FROM roles UNION SELECT * FROM (VALUES {_values(_CV_FIXED)}) t(token)')})"
_M_LISTED = ", ".join(f"({_lit(S.decompose_py(x))}, '{role}')" for role, xs in (("suffix", S.MORPH_SUFFIXES), ("prefix", S.MORPH_PREFIXES)) for x in xs)
_in = lambda xs: ", ".join(map(_lit, xs))
_M_VOCAB = f"""{_CVW}, {_affixes('cvw', 'roles')}, ranked AS MATERIALIZED (
  SELECT token, least(min(CASE role WHEN 'suffix' THEN 0 WHEN 'prefix' THEN 1 WHEN 'stem' THEN 2 ELSE 3 END), min(CASE WHEN {_back('token')} IN ({_in(S.MORPH_SUFFIXES)}) THEN 0 WHEN {_back('token')} IN ({_in(S.MORPH_PREFIXES)}) THEN 1 ELSE 3 END)) AS rk
  FROM (SELECT token, role FROM roles UNION SELECT * FROM (VALUES {_M_LISTED}) l(token, role) UNION SELECT token, 'other' FROM (VALUES {_values(_CV_FIXED + [S.decompose_py(x) for x in S.MORPH_SUFFIXES + S.MORPH_PREFIXES])}) f(token)) GROUP BY token
), vocab AS MATERIALIZED ({_ids('SELECT * FROM ranked', 'rk')}), sufs AS MATERIALIZED (SELECT token FROM roles WHERE role = 'suffix' UNION SELECT * FROM (VALUES {_values([S.decompose_py(x) for x in S.MORPH_SUFFIXES])}) x(token))"""
_H_FIXED = _CV_FIXED + [S.decompose_py(x) for x in S.HYBRID_SUFFIXES + S.HYBRID_PREFIXES]
_H_VOCAB = f"{_CVW}, {_affixes('cvw', 'roles')}, vocab AS MATERIALIZED ({_ids(f'SELECT token FROM roles UNION SELECT word FROM cvw UNION SELECT * FROM (VALUES {_values(_H_FIXED)}) t(token)')})"
_EVERY = "every AS MATERIALIZED (SELECT * FROM vocab UNION ALL VALUES ('<unk>', 0), ('<pad>', 1))"


def _morph_split(words: str) -> str:
    """sp(word, k, piece) of the CV words."""
    suffix = _case(S.MORPH_SUFFIXES, "ends_with(word, {cv}) AND length(word) - {n} >= 2")
    prefix = _case(S.MORPH_PREFIXES, "starts_with(stem, {cv}) AND length(stem) - {n} >= 2")
    return f"""m0 AS MATERIALIZED (SELECT word, CASE WHEN length(word) > 2 THEN {suffix} END AS suf FROM {words}),
m1 AS MATERIALIZED (SELECT word, max(n) AS n FROM (SELECT word, unnest(range(1, least(length(word) - 2, 10) + 1)) AS n FROM m0 WHERE suf IS NULL AND length(word) > 2)
  WHERE right(word, n) IN (SELECT token FROM sufs) AND left(word, length(word) - n) IN (SELECT token FROM every) GROUP BY word),
m2 AS MATERIALIZED (SELECT m0.word, coalesce(suf, right(m0.word, m1.n)) AS suf FROM m0 LEFT JOIN m1 ON m0.word = m1.word),
m4 AS MATERIALIZED (SELECT *, {prefix} AS pre FROM (SELECT word, suf, left(word, length(word) - length(suf)) AS stem FROM m2 WHERE suf IS NOT NULL)),
m5 AS MATERIALIZED (SELECT word, arg_min(p, k) AS p FROM m2, (VALUES {_rows(S.MORPH_PREFIXES)}) x(k, shown, p) WHERE suf IS NULL AND length(word) > 2 AND starts_with(word, p) AND length(word) - length(p) >= 2 AND substr(word, length(p) + 1) IN (SELECT token FROM every) GROUP BY word),
m6 AS MATERIALIZED (SELECT word FROM m2 WHERE suf IS NULL AND length(word) > 2 AND word NOT IN (SELECT word FROM m5)), {_segments('m6', 'every', False, 'mg')}, sp AS MATERIALIZED (
  SELECT word, 0 AS k, pre AS piece FROM m4 WHERE pre IS NOT NULL UNION ALL SELECT word, 1, substr(stem, 1 + coalesce(length(pre), 0)) FROM m4 UNION ALL SELECT word, 2, suf FROM m4
  UNION ALL SELECT word, 0, p FROM m5 UNION ALL SELECT word, 1, substr(word, length(p) + 1) FROM m5 UNION ALL SELECT word, 0, word FROM m2 WHERE length(word) <= 2 UNION ALL SELECT word, k, piece FROM mg)"""


def _hybrid_split(words: str) -> str:
    """sp(word, k, piece) of words as they are written; pieces as displayed."""
    when = "ends_with(cv, {cv}) AND length(cv) > {n}"
    rest = "substr(c.cv, length(p.cv) + 1)"
    return f"""h0 AS MATERIALIZED (SELECT *, {_case(S.HYBRID_SUFFIXES, when, "{x}")} AS suf, {_case(S.HYBRID_SUFFIXES, when, "{n}")} AS n FROM (SELECT word, {_cv('word')} AS cv FROM {words})), hc AS (
  SELECT word, 0 AS k, cv, word AS shown, '' AS pre FROM h0 WHERE suf IS NULL
  UNION ALL
  SELECT c.word, c.k + 1, {rest}, {_back(rest)}, p.shown FROM hc c JOIN (VALUES {_rows(S.HYBRID_PREFIXES)}) p(nr, shown, cv) ON starts_with(c.cv, p.cv) AND length(c.cv) > length(p.cv)
  WHERE c.shown NOT IN (SELECT word FROM words) AND (length({_back(rest)}) >= 2 OR {_back(rest)} IN (SELECT word FROM words))
), hl AS MATERIALIZED (SELECT word, max(k) AS k, arg_max(cv, k) AS cv, arg_max(shown, k) AS shown FROM hc GROUP BY word), hr AS MATERIALIZED (SELECT DISTINCT cv AS word FROM hl WHERE shown NOT IN (SELECT word FROM words)),
{_segments('hr', 'every', False, 'hg')}, sp AS MATERIALIZED (
  SELECT word, 0 AS k, {_back('left(cv, length(cv) - n)')} AS piece FROM h0 WHERE suf IS NOT NULL UNION ALL SELECT word, 1, suf FROM h0 WHERE suf IS NOT NULL
  UNION ALL SELECT word, k - 1, pre FROM hc WHERE k > 0
  UNION ALL SELECT word, k, shown FROM hl WHERE shown IN (SELECT word FROM words)
  UNION ALL SELECT hl.word, hl.k + hg.k, {_back('piece')} FROM hl JOIN hg ON hg.word = hl.cv WHERE shown NOT IN (SELECT word FROM words))"""


def _encoded(kind: str) -> str:
    """t(doc_id, pos, piece, base_id, token, spaced, start_, end_) of the cv, morph and hybrid models; piece in the model's script."""
    vocab = {"cv": _CV_VOCAB, "morph": _M_VOCAB, "hybrid": _H_VOCAB}[kind]
    pattern = {"cv": f"([{_WS}]*[^{_WS}]+)", "morph": f"([{_WS}]|[^{_WS}]+)", "hybrid": f"([{_WS}.,;:!?።፡፤፣]|[^{_WS}.,;:!?።፡፤፣]+)"}[kind]
    own = "word" if kind == "hybrid" else _cv("word")
    units = f"""u AS MATERIALIZED (SELECT doc_id, upos, raw, {f"regexp_replace(raw, {_lit(f'^[{_WS}]+')}, '')" if kind == 'cv' else 'raw'} AS unit FROM (SELECT doc_id, unnest(r) AS raw, unnest(range(1, len(r) + 1)) AS upos FROM (SELECT doc_id, regexp_extract_all(text, {_lit(pattern)}, 1) AS r FROM docs))),
uu AS MATERIALIZED (SELECT unit, {own} AS word FROM (SELECT DISTINCT unit, unit AS word FROM u))"""
    if kind == "cv":
        return f"""{vocab}, {_EVERY}, {units}, uw AS MATERIALIZED (SELECT DISTINCT word FROM uu), {_segments('uw', 'every', False, 'seg', '(SELECT max(length(token)) FROM every)')}, named AS MATERIALIZED (SELECT seg.*, coalesce(base_id, 0) AS base_id, {_back('piece')} AS shown FROM seg LEFT JOIN every ON every.token = piece), t AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY upos, k) - 1 AS pos, piece, base_id, CASE WHEN base_id > 0 THEN shown ELSE '<unk>' END AS token, k = 0 AND ws > 0 AS spaced, CASE WHEN k = 0 THEN b ELSE b + ws + at_ - 1 END AS start_, b + ws + at_ - 1 + length(piece) AS end_
  FROM (SELECT doc_id, upos, ws, word, coalesce(sum(ws + length(word)) OVER (PARTITION BY doc_id ORDER BY upos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, upos, length(raw) - length(u.unit) AS ws, word FROM u JOIN uu ON uu.unit = u.unit)) x JOIN named ON named.word = x.word)"""
    sep = f"[{_WS}]" if kind == "morph" else f"[{_WS}.,;:!?።፡፤፣]"
    split = (_morph_split if kind == "morph" else _hybrid_split)("uw")
    token, shown = ("piece", _back("piece")) if kind == "morph" else (f"CASE WHEN sep THEN piece ELSE {_cv('piece')} END", "piece")
    return f"""{vocab}, {_EVERY}, {units}, uw AS MATERIALIZED (SELECT DISTINCT word FROM uu WHERE NOT regexp_full_match(word, {_lit(sep)})), {split}, named AS MATERIALIZED (
  SELECT x.*, coalesce(base_id, 0) AS base_id FROM (SELECT word, k, {token} AS piece, {shown} AS shown FROM (SELECT word, k, piece, false AS sep FROM sp UNION ALL SELECT DISTINCT word, 0, word, true FROM uu WHERE regexp_full_match(word, {_lit(sep)}))) x LEFT JOIN every ON every.token = x.piece
), t AS MATERIALIZED (
  SELECT doc_id, row_number() OVER w - 1 AS pos, piece, base_id, shown AS token, false AS spaced, coalesce(sum(length(shown)) OVER (PARTITION BY doc_id ORDER BY upos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_, sum(length(shown)) OVER w AS end_
  FROM u JOIN uu ON uu.unit = u.unit JOIN named ON named.word = uu.word WINDOW w AS (PARTITION BY doc_id ORDER BY upos, k))"""


def _encode_sql(kind: str) -> str:
    ids = "base_id" if kind == "hybrid" else "(n + 2) * 2 + 1 + base_id * 2 + CAST(spaced AS BIGINT)"
    return f"""{_encoded(kind)} SELECT doc_id, count(*) AS n_tokens, md5(string_agg(CAST({ids} AS VARCHAR), ',' ORDER BY pos)) AS ids_md5,
      md5(string_agg(token, ',' ORDER BY pos)) AS tokens_md5, md5(string_agg(CAST(CAST(start_ AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS places_md5 FROM t, (SELECT count(*) AS n FROM vocab) GROUP BY doc_id"""


def _decode_sql(kind: str) -> str:
    part = "CASE WHEN base_id > 0 THEN piece ELSE '<unk>' END"
    if kind == "cv":
        parts = f"SELECT doc_id, pos, CASE WHEN spaced THEN ' ' ELSE '' END || {part} AS p FROM t"
    else:
        p = f"SELECT doc_id, pos, {part} AS p, lead({part}) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM t"
        if kind == "morph":
            fused = f"SELECT *, length(p) >= 2 AND ends_with(p, 'እ') AND starts_with(coalesce(q, ''), 'ኦ') AS f FROM ({p})"
        else:  # of neighbours in a row that could be fused, every other pair is: islands, numbered within
            could = f"SELECT *, ends_with(p, 'እ') AND coalesce(left(q, 1) IN ('አ', 'ኡ', 'ኢ', 'ኣ', 'እ', 'ኤ', 'ኦ'), false) AS c FROM ({p})"
            fused = f"SELECT *, c AND (row_number() OVER (PARTITION BY doc_id, c, island ORDER BY pos)) % 2 = 1 AS f FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) AS island FROM ({could}))"
        parts = f"SELECT doc_id, pos, CASE WHEN f THEN left(p, length(p) - 1) ELSE p END AS p FROM ({fused})"
    return f"{_encoded(kind)} SELECT doc_id, md5(x) AS text_md5, length(x) AS n_chars FROM (SELECT doc_id, {_back('y')} AS x FROM (SELECT doc_id, string_agg(p, '' ORDER BY pos) AS y FROM ({parts}) GROUP BY doc_id))"


def _split_sql(kind: str) -> str:
    vocab, words, split = (_M_VOCAB, "cvw", _morph_split) if kind == "morph" else (_H_VOCAB, "words", _hybrid_split)
    sep = f"[{_WS}]" if kind == "morph" else f"[{_WS}.,;:!?።፡፤፣]"
    return f"{vocab}, {_EVERY}, sw AS MATERIALIZED (SELECT word FROM {words} WHERE NOT regexp_full_match(word, {_lit(sep)})), {split('sw')} SELECT word, string_agg(piece, '|' ORDER BY k) AS pieces FROM sp GROUP BY word UNION ALL SELECT word, word FROM {words} WHERE regexp_full_match(word, {_lit(sep)})"


def _grams(most: int) -> str:
    """o(n, hyp, ref, met) of the reconstruction by the raw-script model."""
    grams = ", ".join(" || ".join(["c", *(f"lead(c, {k}) OVER w" for k in range(1, n))]) for n in range(1, most + 1))
    return f"""{_ENCODED}, pr AS MATERIALIZED (SELECT d.doc_id, regexp_replace(coalesce(text, ''), {_lit(f'[{_WS}]+')}, '', 'g') AS ref, regexp_replace(coalesce(hyp, ''), {_lit(f'[{_WS}]+')}, '', 'g') AS hyp FROM docs d LEFT JOIN (SELECT doc_id, string_agg(token, '' ORDER BY pos) AS hyp FROM t GROUP BY doc_id) h ON h.doc_id = d.doc_id),
ch AS MATERIALIZED (SELECT doc_id, side, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, 0 AS side, regexp_extract_all(ref, '(?s).') AS c FROM pr UNION ALL SELECT doc_id, 1, regexp_extract_all(hyp, '(?s).') FROM pr)),
g AS (SELECT doc_id, side, n, g FROM (SELECT doc_id, side, unnest([{grams}]) AS g, unnest(range(1, {most} + 1)) AS n FROM ch WINDOW w AS (PARTITION BY doc_id, side ORDER BY i)) WHERE g IS NOT NULL),
o AS MATERIALIZED (SELECT n, sum(h) AS hyp, sum(r) AS ref, sum(least(h, r)) AS met FROM (SELECT n, sum(side) AS h, sum(1 - side) AS r FROM g GROUP BY doc_id, n, g) GROUP BY n)"""


_NW = f"len(list_filter(string_split_regex(text, {_lit(f'[{_WS}]+')}), lambda x: x <> ''))"


def _curve_point(kind: str, step: int) -> str:
    """The perplexity of one model at one step; cum(doc_id, text, c): the train documents with the words up to each, and the test documents with a null c."""
    encoded = _ENCODED if kind == "gms" else _encoded(kind)
    docs = f"WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, text FROM cum WHERE c IS NULL OR c <= {step}), train AS (SELECT * FROM docs WHERE doc_id % 20 >= 3), {_words('train', 'words')}"
    return f"""SELECT '{kind}' AS algorithm, CAST({step} AS BIGINT) AS step, ppl FROM ({encoded.replace(_BASE, docs)}, c AS MATERIALIZED (SELECT token, count(*) AS c FROM t WHERE doc_id % 20 >= 3 GROUP BY token), s AS (SELECT coalesce(sum(c), 0) AS total, count(*) AS kinds FROM c)
      SELECT CASE WHEN min(total) > 0 THEN round(exp(-sum(n * ln((coalesce(c, 0) + 1e-10::DOUBLE) / (total + 1e-10::DOUBLE * kinds))) / sum(n)), 2) END AS ppl FROM (SELECT token, count(*) AS n FROM t WHERE doc_id % 20 < 3 GROUP BY token) LEFT JOIN c USING (token), s)"""


def curve_sql(kinds: tuple[str, ...], steps: list[int]) -> str:
    """Every point trained and tested by itself."""
    points = " UNION ALL ".join(_curve_point(kind, step) for kind in kinds for step in steps)
    return f"""WITH {_DOCS.replace('docs AS', 'every_doc AS', 1)}, cum AS MATERIALIZED (SELECT doc_id, text, CASE WHEN doc_id % 20 >= 3 THEN sum(CASE WHEN doc_id % 20 >= 3 THEN w ELSE 0 END) OVER (ORDER BY doc_id) END AS c FROM (SELECT doc_id, text, {_NW} AS w FROM every_doc))
      {points}"""


_KEYS = [(chr(c), n.split()[-1]) for a, b in S.BLOCKS[:3] for c in range(a, b) if "ETHIOPIC SYLLABLE" in (n := unicodedata.name(chr(c), ""))]

SQL: dict[str, str] = {
    "fidel_decompose": f"{_BASE} SELECT word, {_cv('word')} AS cv FROM words",
    "normalize_text": f"WITH {_DOCS} SELECT doc_id, {_one_space(_normal('text'))} AS text FROM docs",
    "normalize_raw": f"SELECT doc_id, {_one_space(_normal('text'))} AS text FROM documents",
    "word_split": f"WITH {_DOCS}, w AS (SELECT doc_id, regexp_extract_all({_normal('text')}, {_lit(_WORD)}, 1) AS w FROM docs) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM w",
    "word_freq": f"WITH {_DOCS} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_normal('text')}, {_lit(_WORD)}, 1)) AS word FROM docs) GROUP BY word",
    "corpus_vocab": f"{_BASE} SELECT word FROM words",
    "char_inventory": f"{_BASE} SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch FROM words) GROUP BY ch",
    "fidel_map": f"SELECT * FROM (VALUES {', '.join(f'({_lit(a)}, {_lit(b)})' for a, b in _PAIRS)}) t(glyph, cv)",
    "fidel_recompose": f"{_BASE} SELECT word, {_back(_cv('word'))} AS back FROM words",
    "fidel_roundtrip_loss": f"{_BASE} SELECT * FROM (SELECT word, {_back(_cv('word'))} AS back FROM words) WHERE word <> back",
    "custom_tokens": f"SELECT * FROM (VALUES {_values(S.custom_tokens())}) t(token)",
    "affix_sets_fidel": f"{_BASE}, {_affixes('words', 'roles')} SELECT token, role FROM roles",
    "affix_sets_cv": f"{_CVW}, {_affixes('cvw', 'roles')} SELECT token, role FROM roles",
    "greedy_segments_fidel": f"{_BASE}, {_affixes('words', 'roles')} SELECT word, string_agg(piece, '|' ORDER BY k) AS pieces FROM roles_p GROUP BY word",
    "greedy_segments_cv": f"{_CVW}, {_affixes('cvw', 'roles')} SELECT word, string_agg(piece, '|' ORDER BY k) AS pieces FROM roles_p GROUP BY word",
    "legacy_stems": f"""{_BASE}, lw AS MATERIALIZED (SELECT word FROM words WHERE length(word) > 1), sub AS MATERIALIZED (
      SELECT word, substr(word, i, l) AS s FROM (SELECT word, i, unnest(range(2, length(word) - i + 2)) AS l FROM (SELECT word, unnest(range(1, length(word))) AS i FROM lw)) WHERE l < length(word)),
      covered AS MATERIALIZED (SELECT DISTINCT sub.word FROM sub JOIN lw ON sub.s = lw.word) SELECT lw.word FROM lw LEFT JOIN covered ON covered.word = lw.word WHERE covered.word IS NULL""",
    "vocab_morph": f"{_M_VOCAB} SELECT token, base_id FROM vocab",
    **{f"encode_{kind}": _encode_sql(kind) for kind in ("cv", "morph", "hybrid")},
    **{f"decode_{kind}": _decode_sql(kind) for kind in ("cv", "morph", "hybrid")},
    **{f"split_{kind}": _split_sql(kind) for kind in ("morph", "hybrid")},
    "cv_key_maps": f"""WITH n AS (SELECT glyph, last_, CASE {" ".join(f"WHEN ends_with(last_, '{v}') THEN '{v}'" for v in S.NAME_VOWELS)} ELSE right(last_, 1) END AS v FROM (VALUES {", ".join(f"({_lit(g)}, '{w}')" for g, w in _KEYS)}) t(glyph, last_)),
      k AS (SELECT glyph, CASE WHEN last_ = v THEN last_ ELSE left(last_, length(last_) - length(v)) END AS c, CASE WHEN last_ = v THEN 'A' ELSE v END AS v FROM n)
      SELECT glyph, 'C_' || c || CASE WHEN count(*) OVER (PARTITION BY c, v) > 1 THEN '_' || lpad(printf('%X', unicode(glyph)), 4, '0') ELSE '' END AS consonant, 'V_' || v AS vowel FROM k""",
    "tokenize_texts": f"""{_encoded("cv")} SELECT d.doc_id, coalesce(x.c, 0) AS token_count, md5(coalesce(x.ids, '')) AS ids_md5, md5({_cv("text")}) AS cv_md5 FROM docs d LEFT JOIN (
      SELECT doc_id, count(*) AS c, string_agg(CAST((n + 2) * 2 + 1 + base_id * 2 + CAST(spaced AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS ids FROM t, (SELECT count(*) AS n FROM vocab) GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
    "model_catalog": " UNION ALL ".join(f"SELECT '{name}' AS name, n AS vocab_size, '{label}' AS type FROM ({vocab} SELECT count(*) AS n FROM vocab)" for name, label, vocab in (("gms", "Direct", _GMS), ("cv", "CV", _CV_VOCAB), ("morph", "CV", _M_VOCAB), ("hybrid", "Direct", _H_VOCAB))),
    "recon_bleu": f"""{_grams(4)} SELECT round(CASE WHEN count(*) < 4 THEN 0 ELSE (CASE WHEN min(CASE WHEN n = 1 THEN hyp END) >= min(CASE WHEN n = 1 THEN ref END) THEN 1.0 ELSE exp(1 - min(CASE WHEN n = 1 THEN ref END)::DOUBLE / min(CASE WHEN n = 1 THEN hyp END)) END) * exp(sum(ln(CASE WHEN met = 0 THEN 100 / (power(2, z) * hyp) ELSE 100.0 * met::DOUBLE / hyp END)) / 4) END, 2) AS bleu
      FROM (SELECT *, sum(CASE WHEN met = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM o WHERE hyp > 0)""",
    "recon_chrf": f"{_grams(6)} SELECT round(coalesce(100 * 5 * p * r / nullif(4 * p + r, 0), 0), 2) AS chrf FROM (SELECT avg(met::DOUBLE / hyp) AS p, avg(met::DOUBLE / ref) AS r FROM o WHERE hyp > 0 AND ref > 0)",
    "word_mapping": f"{_BASE} SELECT word, CAST(json_object(word, {_cv('word')}) AS VARCHAR) AS mapping FROM words",
    "find_all": f"""{_CVW} SELECT word, token, CAST(i - 1 AS BIGINT) AS start, CAST(i - 1 + length(token) AS BIGINT) AS "end" FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM cvw) w JOIN (VALUES {_values([S.decompose_py(x) for x in S.MORPH_SUFFIXES + S.MORPH_PREFIXES])}) p(token) ON starts_with(substr(w.word, w.i), p.token)""",
    "flatten_words": f"WITH {_DOCS}, w AS (SELECT doc_id, list_filter(string_split_regex(text, {_lit(f'[{_WS}]+')}), lambda x: x <> '') AS w FROM docs) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM w WHERE len(w) > 0",
    "vocab_gms": f"{_GMS} SELECT token, base_id FROM vocab",
    "vocab_cv": f"{_CVW}, {_affixes('cvw', 'roles')} {_ids(f'SELECT token FROM roles UNION SELECT * FROM (VALUES {_values(_CV_FIXED)}) t(token)')}",
    "vocab_hybrid": f"{_CVW}, {_affixes('cvw', 'roles')} {_ids(f'SELECT token FROM roles UNION SELECT word FROM cvw UNION SELECT * FROM (VALUES {_values(_CV_FIXED + [S.decompose_py(x) for x in S.HYBRID_SUFFIXES + S.HYBRID_PREFIXES])}) t(token)')}",
    "vocab_merge": f"{_BOTH} SELECT token, base_id FROM vocab",
    "vocab_multi": f"{_BOTH} SELECT token, base_id FROM vocab",
    "composite_ids": f"{_GMS} SELECT token, base_id, spaced, (n + 2) * 2 + 1 + base_id * 2 + CAST(spaced AS BIGINT) AS id, base_id AS base_back, CAST(spaced AS BIGINT) AS flag_back FROM vocab, (SELECT count(*) AS n FROM vocab), (VALUES (false), (true)) s(spaced)",
    "encode_gms": f"""{_ENCODED} SELECT doc_id, count(*) AS n_tokens, md5(string_agg(CAST((n + 2) * 2 + 1 + base_id * 2 + CAST(spaced AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS ids_md5,
      md5(string_agg(token, ',' ORDER BY pos)) AS tokens_md5, md5(string_agg(CAST(CAST(start_ AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS places_md5 FROM t, (SELECT count(*) AS n FROM vocab) GROUP BY doc_id""",
    "decode_gms": f"{_ENCODED} SELECT doc_id, md5(x) AS text_md5, length(x) AS n_chars FROM (SELECT doc_id, string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || token, '' ORDER BY pos) AS x FROM t GROUP BY doc_id)",
    "decode_spans": f"{_ENCODED} SELECT doc_id, md5(string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || piece, '' ORDER BY pos)) AS text_md5 FROM t GROUP BY doc_id",
    "unigram_ppl": f"""{_ENCODED}, c AS (SELECT token, count(*) AS c FROM t WHERE doc_id % 20 >= 3 GROUP BY token), s AS (SELECT sum(c) AS total, count(*) AS kinds FROM c)
      SELECT round(exp(-sum(n * ln((coalesce(c, 0) + 1e-10::DOUBLE) / (total + 1e-10::DOUBLE * kinds))) / sum(n)), 4) AS ppl FROM (SELECT token, count(*) AS n FROM t WHERE doc_id % 20 < 3 GROUP BY token) LEFT JOIN c USING (token), s""",
    "tok_per_word": f"{_ENCODED} SELECT round((SELECT count(*) FROM t WHERE regexp_matches(token, {_lit(f'[^{_WS}]')})) / (SELECT sum({_NW}) FROM docs), 3) AS tok_per_word",
    "unk_pct": f"{_ENCODED} SELECT round(avg(CASE WHEN base_id = 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 3) AS unk_pct FROM t",
    "fidel_pct": f"{_ENCODED} SELECT round(avg(CASE WHEN regexp_matches(token, '^[\\x{{1200}}-\\x{{137F}}]+$') THEN 1.0::DOUBLE ELSE 0 END) * 100, 2) AS fidel_pct FROM t WHERE regexp_matches(token, {_lit(f'[^{_WS}]')})",
    "train_test_split": "SELECT doc_id, CASE WHEN doc_id % 20 < 3 THEN 'test' ELSE 'train' END AS part FROM documents",
    "word_budget": f"""WITH {_DOCS}, w AS (SELECT doc_id, {_NW} AS w FROM docs), c AS (SELECT w, sum(w) OVER (ORDER BY doc_id) AS c FROM w)
      SELECT step, count(*) AS n_docs, CAST(sum(w) AS BIGINT) AS n_words FROM c, (SELECT unnest([1000, 5000, 10000, 25000, 50000, 75000, 100000, 125000, 150000, 175000, 200000, 225000, 250000])::BIGINT AS step) WHERE c <= step GROUP BY step""",
    "text_stats": f"""{_ENCODED} SELECT d.doc_id, length(text) AS char_count, length({_cv('text')}) AS decomposed_chars, coalesce(n, 0) AS token_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) USING (doc_id)""",
}
STEPS = [1_000, 5_000, 10_000, 25_000, 50_000, 75_000, 100_000, 125_000, 150_000, 175_000, 200_000, 225_000, 250_000]
SQL["ppl_curve"] = curve_sql(("gms", "cv", "hybrid"), STEPS)
