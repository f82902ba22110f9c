"""SQL that states the detectors, contexts and grades for the check in another engine.

Written from what the detectors are, for RE2, which knows no look-around and no
back-references: a guard is consumed and taken off again, a guard in the middle
is masked beforehand, a repeated word is found by a join, and runs of sentences
are gaps and islands. Detectors that are phrases of words alone take the phrase
compiler's RE2 form; those below, and a sample of the others, are stated anew.
"""

from __future__ import annotations

from collections.abc import Iterable

from prosegauge.functions.finders import ABBREVIATIONS, COMMON_OPENERS
from prosegauge.operators.catalog import CHAIN_PARTS, DETECTORS, ORDINAL, VOCABULARY, compiled
from prosegauge.operators.grade import TRANSITIONS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _begun_by(heads: tuple[str, ...]) -> str:
    """How many of a chain's pieces begin with a head, a blank or (where it ends on a hyphen) nothing after it; ’ is ', a run of blanks one blank."""
    plain = f"trim(regexp_replace(replace(lower(p), '’', ''''), '\\s+', ' ', 'g'))"
    begun = " OR ".join(f"starts_with({plain}, {quoted(h if h.endswith('-') else h + ' ')})" for h in heads)
    return f"len(list_filter(string_split_regex(hit, {quoted('(?i)' + CHAIN_PARTS)}), lambda p: {begun}))"


#: (regex, and how its matches become finds) of the detectors stated anew.
_OWN: dict[str, dict] = {
    "no-chain": {"tail": r"\s+", "count": _begun_by(("no-", "no"))},
    "did-not-chain": {"tail": r"\s+", "count": _begun_by(("did not", "didn't"))},
    "already-know": {"rx": r"(?i)\byou\s+already\s+knows?(?:\s+(?:the\s+answer|what|how|why|this|that|it|who|where)\b|\b[ \t]+\w|\b)", "drop": r"(?i)knows?[ \t]+\w\z"},
    "is-real": {"text": r"regexp_replace(t, '(?i)\b(re)al([\s-]+(?:estate|time|life|world|quick)\b)', '\1_l\2', 'g')", "rx": r"(?i)\bis\s+(?:the|a)\s+real\b[^.!?\n]*?\b(?:and|not)\s+it\b|\bis\s+real\b[^.!?\n]*?\b(?:and|not)\b"},
    "worth-naming": {"rx": r"(?i)(?:\b(?:is|are|was|were|feels?|felt|seems?|seemed)\s+(?:\w+\s+){0,2}?|['’]s\s+(?:\w+\s+){0,2}?)worth\s+naming\b(?:\s+names\b)?|\bworth\s+naming\s*:", "drop": r"(?i)\snames\z"},
    "stacked-questions": {"lead": r"\s+", "count": "length(hit) - length(replace(hit, '?', ''))"},
    "colon-triple": {"tail": r"[.!?\n]"},
    "not-just": {"lead": r"\w['’]", "lead_part": 1, "tail": r"[.!?]"},
    "ai-leftovers": {"lead": r"\s(?:\[|TBD|\\)", "lead_part": 1},
    "ai-vocab": {"rx": r"[\w-]+", "only": f"list_contains({listed(VOCABULARY)}, lower(hit))"},
    # A sample of the plain ones, in other words than the catalogue's.
    "whole": {"rx": r"(?i)\b(?:that|this)(?:['’]s|\s+(?:is|was))\s+the\s+whole\b(?:\s+\w+)?"},
    "verb-inflation": {"rx": "(?i)\\b(?:" + "|".join(f"{v}(?:{e})" for v, e in [(x, "e|es|ed|ing") for x in ("utiliz", "facilitat", "commenc", "initiat")] + [(x, "|s|ed|ing") for x in ("ascertain", "endeavou?r")]) + r"|in\s+order\s+to|prior\s+to|subsequent\s+to|in\s+the\s+event\s+that|with\s+regards?\s+to|a\s+number\s+of|the\s+vast\s+majority\s+of)\b"},
    "crucial-role": {"rx": r"(?i)\bplay(?:s|ed|ing)?\s+an?\s+(?:\w+\s+)?(?:crucial|pivotal|vital|key|significant|central|critical|important)\s+role\b"},
    "turns-out": {"rx": r"(?i)(?:\A|[.!?–—]\s+|\n)turns\s+out\b|\bit\s+turns\s+out\s+that\b"},
    "vague-association": {"rx": r"(?i)\bin\s+(?:connection|association)\s+with\b|\b(?:connected|associated)\s+with\b"},
    "transition-openers": {"rx": r"(?i)(?:\A|[.!?–—]\s+|\n)(?:moreover|furthermore|additionally|consequently|notably|importantly|in\s+addition)\s*,"},
}


def _rx(pattern_id: str) -> str:
    own = _OWN.get(pattern_id, {}).get("rx")
    # What must stand before or after is consumed here, and cut off by lead and tail.
    return own or compiled(pattern_id).re2.replace(r"(?<=\s)", r"\s").replace("(?<=[A-Za-z0-9_])", r"\w").replace("(?=", "(?:")


def _pieces(rx: str, text: str = "t") -> str:
    """(k, t, s, hit) of a regex's matches, s from 0."""
    q = quoted(rx)
    return f"""
  SELECT k, t, m[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT k, t, m, g, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT k, t, regexp_extract_all({text}, {q}) AS m, string_split_regex({text}, {q}) AS g FROM src WHERE regexp_matches({text}, {q})))"""


def _plain(pattern_id: str) -> str:
    d = _OWN.get(pattern_id, {})
    lead, part = d.get("lead"), d.get("lead_part")
    cut = f"CASE WHEN regexp_matches(hit, {quoted(chr(92) + 'A(?:' + lead + ')')}) THEN {part or f'length(regexp_extract(hit, {quoted(chr(92) + chr(65) + lead)}))'} ELSE 0 END" if lead else "0"
    where = [f"NOT regexp_matches(hit, {quoted(d['drop'])})"] if "drop" in d else []
    where += [d["only"]] if "only" in d else []
    core = f"substring(hit, {cut} + 1)"
    core = f"regexp_replace({core}, {quoted('(?:' + d['tail'] + ')' + chr(92) + 'z')}, '')" if "tail" in d else core
    return f"""SELECT k, {ORDINAL[pattern_id]} AS o, s + {cut} AS s, s + {cut} + length({core}) AS e, CAST({d.get('count', 'NULL')} AS INTEGER) AS n
  FROM ({_pieces(_rx(pattern_id), d.get('text', 't'))}) {'WHERE ' + ' AND '.join(where) if where else ''}"""


def _aligned() -> str:
    """align with, the vocabulary's one pair of words: neither a word character nor a hyphen beside it."""
    return f"""SELECT k, {ORDINAL['ai-vocab']}, s, s + length(hit), CAST(NULL AS INTEGER) FROM ({_pieces(r'(?i)align(?:s|ed|ing)?\s+with')})
  WHERE NOT regexp_matches(substring(t, s, 1), '[\\w-]') AND NOT regexp_matches(substring(t, s + length(hit) + 1, 1), '[\\w-]')"""


#: (k, i, w, s, e) of all words, the text that parts each from the next (gap) and from the one before (before), and the five after it.
WORDS = """parted AS (SELECT k, generate_subscripts(g, 1) AS i, unnest(m) AS w, unnest(g) AS before FROM (SELECT k, regexp_extract_all(t, '\\w+') AS m, string_split_regex(t, '\\w+') AS g FROM src)),
placed AS (SELECT *, lead(before) OVER own AS gap, length(before) + coalesce(length(lag(w) OVER own), 0) AS step FROM parted WINDOW own AS (PARTITION BY k ORDER BY i)),
words AS MATERIALIZED (SELECT k, i, lower(w) AS w, before, gap, s, s + length(w) AS e FROM (SELECT *, CAST(sum(step) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS s FROM placed) WHERE w IS NOT NULL),
near AS MATERIALIZED (
  SELECT *, list(w) OVER six AS ws, list(gap) OVER six AS gs, list(e) OVER six AS es FROM words WINDOW six AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
  QUALIFY w IN ('do', 'don', 'not', 'is', 'are', 'was', 'were', 'isn', 'aren', 'wasn', 'weren') OR regexp_matches(before, '[.!?;,:–—][''\"”’]*\\s*\\z'))"""
_BLANK_GAP = lambda n: f"regexp_full_match(gs[{n}], '\\s+')"
_APOSTROPHE_GAP = lambda n: f"gs[{n}] IN ('''', '’')"


def _in(expression: str, words: str) -> str:
    return f"{expression} IN ({', '.join(quoted(w) for w in words.split())})"


def _acted_on(first: int) -> list[tuple[str, str, str]]:
    """(condition, verb, end) of `[just] verb [of] it` from the word number first on: with both, with either and with none of what may be left out."""
    out = []
    for adverb in (1, 0):
        for onto in (1, 0):
            v, it = first + adverb, first + adverb + onto + 1
            need = [_BLANK_GAP(n) for n in range(first, it)] + [f"ws[{it}] = 'it'"]
            need += [_in(f"ws[{first}]", "just simply merely")] * adverb + [_in(f"ws[{it - 1}]", "of about at on for with to")] * onto
            out.append((" AND ".join(need), f"ws[{v}]", f"es[{it}]"))
    return out


def _cases(options: list[tuple[str, str, str]], at: int) -> str:
    return "CASE " + " ".join(f"WHEN {x[0]} THEN {x[at]}" for x in options) + " END"


def _verb_it() -> str:
    """A negated verb and the same verb again, told from words: the nearest second one that no sentence's end parts from the first."""
    after = _acted_on(3)
    start = f"w = 'do' AND ws[2] = 'not' AND {_BLANK_GAP(1)} AND {_BLANK_GAP(2)} OR w = 'don' AND ws[2] = 't' AND {_APOSTROPHE_GAP(1)} AND {_BLANK_GAP(2)}"
    sign = "regexp_extract(before, '[.!?;,:–—][''\"”’]*\\s*\\z')"
    return f"""SELECT h.k, {ORDINAL['dont-verb-it']}, h.s, arg_min(x.e, x.s), CAST(NULL AS INTEGER)
  FROM (SELECT k, t, s, {_cases(after, 1)} AS verb, {_cases(after, 2)} AS e FROM near JOIN src USING (k) WHERE {start}) h
  JOIN (SELECT k, s - length({sign}) AS s, {_cases(_acted_on(1), 1)} AS verb, {_cases(_acted_on(1), 2)} AS e FROM near WHERE {sign} <> '') x
    ON h.k = x.k AND h.verb = x.verb AND x.s >= h.e AND NOT regexp_matches(substring(h.t, h.e + 1, x.s - h.e), '[.!?\\n]')
  GROUP BY h.k, h.s"""


def _islands(name: str, sentences: str, broken: str, least: int, which: str, start: str, end: str) -> str:
    """Runs of neighbouring sentences(k, t, s, e, sign): a run ends where `broken` holds of a sentence and the one before (ps, pe, psign)."""
    return f"""SELECT k, {ORDINAL[name]}, {start}, {end}, CAST(c AS INTEGER) FROM (
    SELECT k, any_value(t) AS t, min(s) AS s, max(e) AS e, count(*) AS c, any_value(sign) AS sign FROM (
      SELECT *, sum(CASE WHEN {broken} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s) AS run FROM (
        SELECT *, lag(e) OVER w AS pe, lag(sign) OVER w AS psign FROM ({sentences}) WINDOW w AS (PARTITION BY k ORDER BY s)))
    GROUP BY k, run) WHERE c >= {least} AND {which}"""


def _echo() -> str:
    grams = "list_transform(range(1, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i:i + 3], ' '))"
    rows = f"""SELECT k, t, s, s + length(hit) AS e, {grams} AS sign FROM (
      SELECT *, regexp_extract_all(lower(hit), '[a-z0-9''’-]+') AS w FROM ({_pieces('[^.!?' + chr(92) + 'n]+[.!?]?')}) WHERE len(regexp_extract_all(hit, '\\S+')) >= 4)"""
    return _islands("echo-triad", rows, "pe IS NULL OR s - pe > 3 OR NOT list_has_any(sign, psign)", 2, "true", "s", "s + length(regexp_replace(substring(t, s + 1, e - s), '\\s+\\z', ''))")


def _anaphora() -> str:
    rows = f"""SELECT k, t, s + instr(hit, head) - 1 AS s, s + length(hit) AS e, lower(head) AS sign FROM (
      SELECT *, regexp_extract(hit, '[A-Za-z''’-]+') AS head FROM ({_pieces('[^.!?' + chr(92) + 'n]{1,400}[.!?]')})) WHERE head <> ''"""
    return _islands("sentence-anaphora", rows, "pe IS NULL OR s - pe >= 4 OR sign <> psign", 3, f"NOT list_contains({listed(sorted(COMMON_OPENERS))}, sign)", "s", "e")


def _staccato() -> str:
    short = "|".join(sorted(ABBREVIATIONS))
    rows = f"""SELECT k, t, s, s + length(hit) AS e, len(regexp_extract_all(hit, '\\S+')) <= 2 AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '(?i)(?:\\A|\\s)(?:{short}|[A-Za-z])\\.\\s*\\z') AS sign
      FROM ({_pieces('[^.!?' + chr(92) + 'n]{1,40}[.!?]+')})"""
    own = "substring(t, s + 1, e - s)"
    return _islands("staccato-fragments", rows, "pe IS NULL OR s - pe > 3 OR NOT sign OR NOT psign", 3, "sign", f"s + length(regexp_extract({own}, '\\A\\s*'))", f"s + length(regexp_replace({own}, '\\s+\\z', ''))")


_RUNS = {"dont-verb-it": [_verb_it], "echo-triad": [_echo], "sentence-anaphora": [_anaphora], "staccato-fragments": [_staccato]}


def found_ctes(source: str, pattern_ids: Iterable[str] | None = None) -> str:
    """CTEs over source(k, t): spans(k, o, s, e, n) of all detectors, and kept(k, match_id, o, s, e, n), overlaps resolved."""
    ids = [d.pattern_id for d in DETECTORS if d.default_on] if pattern_ids is None else list(pattern_ids)
    parts = [part for i in ids for part in ([f() for f in _RUNS[i]] if i in _RUNS else [_plain(i)])]
    if "ai-vocab" in ids:
        parts.append(_aligned())
    return f"""src AS MATERIALIZED ({source}),
{WORDS + ',' if 'dont-verb-it' in ids else ''}
spans(k, o, s, e, n) AS MATERIALIZED ({' UNION ALL '.join(parts)}),
lists AS (SELECT k, list(struct_pack(s := s, e := e, o := o, n := n) ORDER BY s, e DESC, o) AS f FROM spans GROUP BY k),
folded AS (
  SELECT k, list_reduce(f, lambda a, x: CASE WHEN x.s >= a.reach THEN struct_pack(reach := x.e, kept := list_append(a.kept, x)) ELSE a END, struct_pack(reach := CAST(-1 AS BIGINT), kept := f[1:0])).kept AS ms
  FROM lists),
numbered AS (SELECT k, unnest(range(0, len(ms))) AS match_id, unnest(ms) AS x FROM folded),
kept AS MATERIALIZED (SELECT k, CAST(match_id AS INTEGER) AS match_id, x.o AS o, CAST(x.s AS INTEGER) AS s, CAST(x.e AS INTEGER) AS e, x.n AS n FROM numbered),
cat(o, pattern_id, grp) AS (VALUES {', '.join(f"({i}, {quoted(d.pattern_id)}, {quoted(d.group)})" for i, d in enumerate(DETECTORS))})"""


def windows_ctes(words: int = 12) -> str:
    """CTEs after found_ctes(): context(k, window_id, s, e, n_regions, n_matches) of all kept matches."""
    return rf"""
bounds AS (
  SELECT m.k, m.match_id, src.t, m.s - length(regexp_extract(substring(t, 1, m.s), '[^\n.!?…]*\z')) AS a, m.s, m.e + length(regexp_extract(substring(t, m.e + 1), '\A[^\n.!?…]*(?:[.!?…]["''”’)\]]*)?')) AS b
  FROM kept m JOIN src ON m.k = src.k),
sents AS (SELECT k, match_id, t, a + length(regexp_extract(substring(t, a + 1, s - a), '\A\s*')) AS a, b FROM bounds),
breaks AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM sents),
regioned AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY match_id) AS region FROM breaks),
regions AS (SELECT k, region, any_value(t) AS t, min(a) AS a, max(b) AS b, count(*) AS n_matches FROM regioned GROUP BY k, region),
wide AS (
  SELECT k, region, t, n_matches,
    a - CASE WHEN regexp_matches(substring(t, a, 2), '\A\S\s') THEN length(regexp_extract(substring(t, 1, a), '(?:\S+\s+){{0,{words - 1}}}\S+\z')) WHEN regexp_matches(substring(t, 1, a), '\S\s+\S*\z') OR regexp_matches(substring(t, 1, a), '\A\S+\s+\z') THEN length(regexp_extract(substring(t, 1, a), '(?:\S+\s+){{0,{words}}}\S*\z')) ELSE 0 END AS s,
    b + length(regexp_extract(substring(t, b + 1), '\A(?:\s*\S+){{0,{words}}}')) AS e
  FROM regions),
reach AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM wide),
joined AS (SELECT *, sum(CASE WHEN last IS NULL OR (s > last AND regexp_matches(substring(t, last + 1, s - last), '\S')) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY region) AS win FROM reach),
context AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY min(s)) - 1 AS INTEGER) AS window_id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e, CAST(count(*) AS INTEGER) AS n_regions,
    CAST(sum(n_matches) AS INTEGER) AS n_matches, substring(any_value(t), min(s) + 1, max(e) - min(s)) AS text
  FROM joined GROUP BY k, win)"""


_WORD = "[A-Za-z0-9][A-Za-z0-9''’-]*"
#: Openings of a sentence, one blank or one straight apostrophe between their words.
_OPENINGS = [f"{a}{b}" for a, bs in (("it", "'s| is| was"), ("there", "'s| is| are| was| were"), ("this", " is"), ("these", " are"), ("that", " is")) for b in bs.split("|")]


def _contrasts() -> str:
    """(k, o, s, e) of the four shapes of contrast, from words: a head, no sentence's end and no other stop up to the sign or word that answers."""
    near_by = lambda most, upto: f"{upto} - h.e BETWEEN 1 AND {most} AND NOT regexp_matches(substring(h.t, h.e + 1, {upto} - h.e), '[.!?;\\n]')"
    be = "is are was were"
    answers = f"""SELECT k, s - length(regexp_extract(before, '[,;—–]\\s*\\z')) AS sign,
      CASE WHEN {_APOSTROPHE_GAP(1)} AND ws[2] = 's' OR {_BLANK_GAP(1)} AND {_in('ws[2]', be)} THEN es[2] END AS e
    FROM near WHERE {_in('w', 'it this that they these those')} AND regexp_matches(before, '[,;—–]\\s*\\z')"""
    negated = {1: f"{_in('w', 'isn aren wasn weren')} AND {_APOSTROPHE_GAP(1)} AND ws[2] = 't'", 2: f"{_in('w', be)} AND {_BLANK_GAP(1)} AND ws[2] = 'not'"}
    turns = [f"SELECT h.k, {o} AS o, h.s, min(a.e) AS e FROM (SELECT k, t, s, es[2] AS e FROM near JOIN src USING (k) WHERE {c}) h JOIN ({answers}) a ON a.k = h.k AND a.e IS NOT NULL AND {near_by(60, 'a.sign')} GROUP BY h.k, h.s" for o, c in negated.items()]
    just = f"w = 'not' AND {_BLANK_GAP(1)} AND {_in('ws[2]', 'just only merely simply')}"
    first = f"SELECT h.k, 0 AS o, h.s, min(b.e) AS e FROM (SELECT k, t, s, es[2] AS e FROM near JOIN src USING (k) WHERE {just}) h JOIN (SELECT k, s, e FROM words WHERE w = 'but') b ON b.k = h.k AND {near_by(80, 'b.s')} GROUP BY h.k, h.s"
    aside = f"SELECT k, 3 AS o, s - length(regexp_extract(before, ',\\s+\\z')) AS s, es[2] AS e FROM near WHERE w = 'not' AND {_BLANK_GAP(1)} AND {_in('ws[2]', 'a an the just only merely simply his her its their your my our')} AND regexp_matches(before, ',\\s+\\z')"
    return " UNION ALL ".join([first, *turns, aside])


#: Of spans(k, o, s, e) the leftmost ones of each (k, o) that don't overlap.
_LEFTMOST = """(SELECT k, o, unnest(list_reduce(list(struct_pack(e := e, s := s) ORDER BY s), lambda a, x: CASE WHEN x.s >= a.e THEN struct_pack(e := x.e, kept := list_append(a.kept, x)) ELSE a END,
    struct_pack(e := CAST(-1 AS BIGINT), kept := CAST([] AS STRUCT(e BIGINT, s BIGINT)[]))).kept, max_depth := 2) FROM (SELECT k, o, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({spans})) GROUP BY k, o)"""
#: Members parted by commas: stretches of words with blanks alone between; (k, j, n, sign after it, its first word).
_STRETCHES = """tokens AS (
  SELECT k, i, lower(w) AS w, lead(before) OVER (PARTITION BY k ORDER BY i) AS gap FROM (SELECT k, generate_subscripts(g, 1) AS i, unnest(m) AS w, unnest(g) AS before FROM (
    SELECT k, regexp_extract_all(t, '[\\w''’-]+') AS m, string_split_regex(t, '[\\w''’-]+') AS g FROM src WHERE contains(lower(t), 'and'))) QUALIFY w IS NOT NULL),
stretched AS (SELECT *, coalesce(sum(CASE WHEN regexp_full_match(gap, '\\s+') THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM tokens),
members AS (SELECT k, j, count(*) AS n, regexp_full_match(arg_max(gap, i), ',\\s+') AS comma, arg_min(w, i) AS w FROM stretched GROUP BY k, j),
triples AS (
  SELECT k, j, lead(n, 2) OVER w AS last FROM members WINDOW w AS (PARTITION BY k ORDER BY j)
  QUALIFY comma AND lead(comma) OVER w AND lead(n) OVER w <= 3 AND lead(w, 2) OVER w = 'and' AND lead(n, 2) OVER w >= 2),
triads AS (
  SELECT k, list_reduce(list(struct_pack(j := CAST(j AS BIGINT), last := last, n := 1) ORDER BY j), lambda a, x: CASE WHEN x.j > a.j + 2 OR x.j = a.j + 2 AND a.last > 4 THEN struct_pack(j := x.j, last := x.last, n := a.n + 1) ELSE a END).n AS triads
  FROM triples GROUP BY k)"""


def graded_ctes(source: str, li_total: str = "NULL", li_bold: str = "NULL") -> str:
    """CTEs over source(k, t), its list items told from k by li_total and li_bold: sized(k, n_words, n_sentences, eligible, ...), signals(k, key, applicable, fired, value), graded(k, eligible, n_words, n_sentences, applicable_count, fired_count, tier)."""
    contrasts = _LEFTMOST.replace("{spans}", _contrasts())
    opening = "replace(regexp_replace(regexp_extract(lower(s), '\\A\\w+(?:\\s+|[''’])\\w+'), '\\s+', ' '), '’', '''')"
    one = lambda key, value, applies, fires: f"SELECT k, '{key}' AS key, {applies} AS applicable, coalesce(({applies}) AND {fires}, false) AS fired, CAST({value} AS DOUBLE) AS value FROM sized WHERE eligible"
    return rf"""src AS MATERIALIZED ({source}),
{WORDS},
{_STRETCHES},
clauses AS (SELECT * FROM {contrasts}),
turns AS (SELECT k, list_reduce(list(struct_pack(e := e, s := s, n := 1) ORDER BY s, o), lambda a, x: CASE WHEN x.s >= a.e THEN struct_pack(e := x.e, s := x.s, n := a.n + 1) ELSE a END).n AS contrasts FROM clauses GROUP BY k),
parts AS (
  SELECT k, t, len(regexp_extract_all(t, '{_WORD}')) AS n_words,
    list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '\A\s+|\s+\z', '', 'g')), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS ss,
    list_filter(list_transform(string_split_regex(t, '\n+'), lambda p: len(regexp_extract_all(p, '{_WORD}'))), lambda n: n > 0) AS pw
  FROM src),
counted AS (
  SELECT *, len(ss) AS n_sentences, list_filter(list_transform(ss, lambda s: len(regexp_extract_all(s, '{_WORD}'))), lambda n: n > 0) AS sw, len(regexp_extract_all(t, '—')) AS dashes,
    len(list_filter(ss, lambda s: list_contains({listed(TRANSITIONS)}, lower(regexp_extract(s, '[A-Za-z’'']+'))))) AS trans, len(list_filter(ss, lambda s: list_contains({listed(_OPENINGS)}, {opening}))) AS expl,
    CAST(regexp_matches(t, '[‘’“”]') AS INT) + CAST(contains(t, '…') OR contains(t, '...') AS INT) + CAST(contains(t, '—') AS INT) AS signs
  FROM parts),
sized AS MATERIALIZED (
  SELECT c.*, coalesce(u.contrasts, 0) AS contrasts, coalesce(x.triads, 0) AS triads, CAST({li_total.replace("k", "c.k")} AS INTEGER) AS li_total, CAST({li_bold.replace("k", "c.k")} AS INTEGER) AS li_bold, n_words >= 150 AND n_sentences >= 8 AS eligible,
    CASE WHEN len(sw) >= 2 THEN list_stddev_pop(sw) / list_avg(sw) END AS scv, CASE WHEN len(pw) >= 2 THEN list_stddev_pop(pw) / list_avg(pw) END AS pcv
  FROM counted c LEFT JOIN turns u ON c.k = u.k LEFT JOIN triads x ON c.k = x.k),
signals AS MATERIALIZED (
  {one('burstiness', 'scv', 'scv IS NOT NULL AND len(sw) >= 5', 'scv < 0.4')} UNION ALL {one('para-uniform', 'pcv', 'pcv IS NOT NULL AND len(pw) >= 4', 'pcv < 0.4')}
  UNION ALL {one('em-dash', 'dashes * 1000.0 / n_words', 'true', 'dashes * 1000.0 / n_words > 10')} UNION ALL {one('transitions', 'trans / n_sentences', 'true', 'trans / n_sentences > 0.1')}
  UNION ALL {one('expletives', 'expl / n_sentences', 'true', 'expl / n_sentences > 0.1')} UNION ALL {one('rule-of-three', 'triads * 1000.0 / n_words', 'true', '(triads >= 2 AND triads * 1000.0 / n_words > 5)')}
  UNION ALL {one('antithesis', 'contrasts * 1000.0 / n_words', 'true', '(contrasts >= 3 AND contrasts * 1000.0 / n_words > 5)')} UNION ALL {one('typography', 'signs', 'true', 'signs >= 3')}
  UNION ALL {one('bold-list', 'CASE WHEN li_total >= 3 THEN li_bold / li_total END', 'coalesce(li_total >= 3, false)', 'li_bold / li_total > 0.5')}),
graded AS MATERIALIZED (
  SELECT z.k, z.eligible, CAST(z.n_words AS INTEGER) AS n_words, CAST(z.n_sentences AS INTEGER) AS n_sentences, CAST(coalesce(g.applicable, 0) AS INTEGER) AS applicable_count, CAST(coalesce(g.fired, 0) AS INTEGER) AS fired_count,
    CASE WHEN coalesce(g.fired, 0) >= 7 THEN 'high' WHEN coalesce(g.fired, 0) >= 5 THEN 'elevated' WHEN coalesce(g.fired, 0) >= 3 THEN 'some' ELSE 'low' END AS tier
  FROM sized z LEFT JOIN (SELECT k, count(*) FILTER (WHERE applicable) AS applicable, count(*) FILTER (WHERE fired) AS fired FROM signals GROUP BY k) g ON z.k = g.k)"""
