"""Secret spans in texts, with DataFrame functions only.

Three kinds of patterns, and one of entropy: over strings of key characters a
window slides one character at a time; counts of characters (a string with a
character for each slot) and the sum of c * log2(c) are updated for the one that
enters and the one that leaves, which gives the Shannon entropy of every window. The threshold depends on the string's
character class; an allow-list of patterns suppresses strings that are known to
be harmless.

Positions count code points. A row is handled by itself: there is no shuffle. Long
arrays are folded by chunks, so that the work grows with the length of a text.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, and what a match (x) must satisfy; in the order that sorts equal starts (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, f"length(regexp_extract(x, r'''{ASSIGN}''', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(x) >= 20"),
    # Maximal runs of 24 and more are what [0-9a-f]+ finds, less the short ones.
    ("hex", "[0-9a-f]{24,}", "true"),
]
#: Characters of candidate strings, each a slot of the counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least bits for a window by class: strings of hexadecimal digits, and all others.
BITS = {"hex": 3.0, "other": 3.6}
#: Candidate strings that are no secrets: without a digit, without a letter, dashed identifiers, and one unit repeated.
ALLOWED = ["[^0-9]*", "[^A-Za-z]*", "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.{1,8})\1+.{0,8}"]
_SPAN = "struct<start: int, kind: int, stop: int>"
#: Elements of an array that are folded before their results are put together.
_CHUNK = 128


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chunks(array: str) -> str:
    return f"CASE WHEN size({array}) = 0 THEN array() ELSE transform(sequence(0, size({array}) - 1, {_CHUNK}), i -> slice({array}, i + 1, {_CHUNK})) END"


def _scanned(array: str, zero: str, step: str, out: str, keep: str, out_type: str) -> str:
    """``out`` of every element ``m`` with ``keep``; both, and ``step``, may use the running value ``at`` before the element."""
    inner = lambda at: f"""
      aggregate(ch, named_struct('at', {at}, 'out', CAST(array() AS array<{out_type}>)), (a, m) -> named_struct('at', {step.replace("$at", "a.at")},
        'out', CASE WHEN {keep.replace("$at", "a.at")} THEN concat(a.out, array({out.replace("$at", "a.at")})) ELSE a.out END))"""  # noqa: E731
    return f"""
    CASE WHEN size({array}) = 0 THEN CAST(array() AS array<{out_type}>) ELSE
    flatten(aggregate({_chunks(array)}, named_struct('at', {zero}, 'out', CAST(array() AS array<array<{out_type}>>)),
      (s, ch) -> transform(array({inner("s.at")}), d -> named_struct('at', d.at, 'out', concat(s.out, array(d.out))))[0],
      s -> s.out)) END"""


def _placed(text: str, pattern: str, keep: str, found: str) -> str:
    """Matches of ``pattern`` (array ``found``) with the gap before each and whether they satisfy ``keep``."""
    return f"zip_with({found}, slice(split({text}, {_sql_string(pattern)}, -1), 1, size({found})), (x, gap) -> named_struct('gap', length(gap), 'size', length(x), 'keep', {keep}, 'x', x))"


def _positions(placed: str, kind: int) -> str:
    """Spans of the matches that are kept: lengths of matches and of what stands between are summed."""
    return _scanned(placed, "0", "$at + m.gap + m.size", f"named_struct('start', $at + m.gap, 'kind', {kind}, 'stop', $at + m.gap + m.size)", "m.keep", _SPAN)


def _entropy(codes: str, window: int, bits: str) -> str:
    """First start and last stop, in the candidate of these ``codes`` (places in the alphabet), of windows with at least ``bits``; (-1, -1) if none has.

    A step judges the window that ends before its character, so that each new value is used once.
    """
    count = lambda code: f"(ascii(substr(a.counts, {code}, 1)) - 65)"
    xlogx = [n * log2(n) if n else 0.0 for n in range(window + 1)]
    rise = "array(" + ", ".join(f"{y - x!r}D" for x, y in zip(xlogx, xlogx[1:], strict=False)) + ")"  # of the sum, from n to n + 1
    enter, leave = f"{codes}[i - 1]", f"{codes}[i - {window + 1}]"
    entered = f"overlay(a.counts PLACING chr({count(enter)} + 66) FROM {enter} FOR 1)"
    moved = f"overlay({entered} PLACING chr({count(leave)} + 64) FROM {leave} FOR 1)"
    dense = lambda end: f"{end} >= {window} AND log2({window}) - a.total / {window} >= {bits}"
    first = lambda end: f"CASE WHEN a.first < 0 AND {dense(end)} THEN {end} - {window} ELSE a.first END"
    last = lambda end: f"CASE WHEN {dense(end)} THEN {end} ELSE a.last END"
    return f"""
    aggregate(
      sequence(1, size({codes})),
      named_struct('counts', repeat('A', {len(ALPHABET)}), 'total', 0D, 'first', -1, 'last', -1),
      (a, i) -> named_struct(
        'counts', CASE WHEN i <= {window} THEN {entered} WHEN {enter} = {leave} THEN a.counts ELSE {moved} END,
        'total', CASE WHEN i <= {window} THEN a.total + {rise}[{count(enter)}] WHEN {enter} = {leave} THEN a.total
          ELSE a.total + {rise}[{count(enter)}] - {rise}[{count(leave)} - 1] END,
        'first', {first("(i - 1)")},
        'last', {last("(i - 1)")}),
      a -> named_struct('first', {first(f"size({codes})")}, 'last', {last(f"size({codes})")}))"""


def with_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", window: int = 20, allowed: list[str] = ALLOWED) -> DataFrame:
    """``df`` with an array of ``start, kind, stop`` (kind: place in assign, access, hex, entropy), sorted.

    An entropy span is the least range of a candidate string that holds all its
    windows at or above the threshold; those within a span of another kind are left
    out. Other columns stay as they are, whatever their names; a column named
    ``out_col`` is replaced. The work grows with the length of a text.
    """
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    text, candidates, base, more, every = (f"{mark}{c}" for c in ("text", "candidates", "base", "more", "every"))
    last = len(KINDS)
    patterns = [(p, keep.replace(f"r'''{ASSIGN}'''", _sql_string(ASSIGN))) for _, p, keep in KINDS]
    suspect = " AND ".join(f"NOT x RLIKE {_sql_string(f'^(?:{p})$')}" for p in allowed) or "true"
    patterns.append((f"[{ALPHABET}]{{{window},}}", suspect))
    made = df.withColumn(text, F.coalesce(df[text_col].cast("string"), F.lit("")))
    for k, (p, keep) in enumerate(patterns):
        made = made.withColumn(f"{mark}found{k}", F.expr(f"regexp_extract_all({text}, {_sql_string(p)}, 0)"))
        made = made.withColumn(f"{mark}placed{k}", F.expr(_placed(text, p, keep, f"{mark}found{k}")))
    made = made.withColumn(base, F.expr(f"concat({', '.join(_positions(f'{mark}placed{k}', k) for k in range(last))})"))
    # Candidates with their places, then the range that entropy tells.
    found = "named_struct('start', $at + m.gap, 'text', m.x)"
    made = made.withColumn(candidates, F.expr(_scanned(f"{mark}placed{last}", "0", "$at + m.gap + m.size", found, "m.keep", "struct<start: int, text: string>")))
    bits = f"CASE WHEN x.text RLIKE '^[0-9a-fA-F]+$' THEN {BITS['hex']}D ELSE {BITS['other']}D END"
    codes = f"transform(split(x.text, ''), c -> instr({_sql_string(ALPHABET)}, c))"
    coded = f"transform({candidates}, x -> named_struct('start', x.start, 'bits', {bits}, 'codes', {codes}))"
    ranged = f"transform({coded}, x -> named_struct('start', x.start, 'range', {_entropy('x.codes', window, 'x.bits')}))"
    spans = f"transform(filter({ranged}, r -> r.range.first >= 0), r -> named_struct('start', r.start + r.range.first, 'kind', {last}, 'stop', r.start + r.range.last))"
    made = made.withColumn(more, F.expr(f"CASE WHEN size({candidates}) = 0 THEN CAST(array() AS array<{_SPAN}>) ELSE {spans} END"))
    # In order of starts, an entropy span lies in one of another kind if one before it reaches as far.
    # The sorted array is a column, so that it is made once and not for each chunk.
    made = made.withColumn(every, F.expr(f"array_sort(concat({base}, {more}))"))
    outside = _scanned(every, "0", f"CASE WHEN m.kind < {last} THEN greatest($at, m.stop) ELSE $at END", "m", f"m.kind < {last} OR m.stop > $at", _SPAN)
    result = F.expr(f"CASE WHEN size({more}) = 0 THEN {every} ELSE {outside} END")
    own = [text, candidates, base, more, every, *(f"{mark}{c}{k}" for c in ("found", "placed") for k in range(last + 1))]
    return made.withColumn(out_col, result).drop(*own)


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in [*(k for k, _, _ in KINDS), "entropy"]) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.stop)), ',')")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    Null and empty texts have no spans; equal rows get equal results; an empty
    table gives no rows; other columns are ignored.
    """
    found = with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), window=window)
    base = f"filter(spans, s -> s.kind < {len(KINDS)})"
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, s -> s.kind = {k})) AS long)").alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (touching and overlapping spans by one); null texts stay null."""
    name = "__spans"
    while name in df.columns:
        name += "_"
    found, text = with_spans(df, text_col, name), f"`{text_col}`"
    piece = "substr(g.seg, a.at - s.at + 1, greatest(c.start - a.at, 0))"
    fold = f"""
      aggregate({_chunks(f"`{name}`")}, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
        (s, ch) -> transform(array(named_struct('seg', substr({text}, s.at + 1, greatest(s.at, array_max(transform(ch, c -> c.stop))) - s.at))), g ->
          aggregate(ch, named_struct('at', s.at, 'out', CAST(array() AS array<string>)),
            (a, c) -> CASE WHEN c.stop <= a.at THEN a ELSE named_struct('at', c.stop, 'out', concat(a.out, array({piece}, CASE WHEN c.start > a.at OR a.at = 0 THEN {_sql_string(mark)} ELSE '' END))) END,
            a -> named_struct('at', a.at, 'out', concat(s.out, array(array_join(a.out, ''))))))[0],
        s -> concat(array_join(s.out, ''), substr({text}, s.at + 1)))"""
    return found.withColumn(text_col, F.expr(f"CASE WHEN size(`{name}`) = 0 OR {text} IS NULL THEN {text} ELSE {fold} END")).drop(name)
