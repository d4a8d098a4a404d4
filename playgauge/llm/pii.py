"""Personal data in texts: weak labelers vote, expectation-maximisation weighs them, a classifier decides.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they find and validate
always counts. Wider patterns, and matches that fail validation, are candidates beside them. Four labelers
vote on every candidate (for, against, or not at all): its form, a gazetteer of known values for its kind,
the words before it, and the characters around it. EM over the counts of equal votes estimates the share of
personal data in each kind and each labeler's reliability; a logistic regression on the candidates' features
is then fitted to the resulting probabilities, and accepts candidates of the wider patterns from
``THRESHOLD`` on. Matches that fail validation only teach it what personal data doesn't look like.

All steps are SQL expressions. Candidates meet only as counts of equal votes, at most a few hundred rows, and
the whole fit is one fold over them; the weights come back as literals of the second pass over the texts.

Nulls and unusual input: a null text is empty and has no spans. Other columns, nulls and repeats in them
included, pass through whatever their names; ``label_spans`` alone replaces columns named like its two results. An
empty table gives an empty result.
Positions are code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import field

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5

# The base patterns, in forms that can't backtrack over long runs. A match may begin inside a
# run only where the last one ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A spelled-out address from its sign to the first letters after its first point.
_SIGN = r"(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}"
_POINT = r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)"
#: Wider candidates by kind, and a text's quick test for them, which every match of the pattern passes.
WIDER = {
    "email": (
        rf"(?i)[a-z0-9._%+-]{{1,64}}\x20?{_SIGN}(?:{_POINT}[a-z0-9-]{{2,63}}){{1,8}}",
        rf"(?i){_SIGN}{_POINT}[a-z0-9-]{{2}}",
    ),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    "phone": (r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Gazetteers: values that speak for a kind, as patterns on the span.
KNOWN = {
    "email": r"(?i)[.\x20)\]](?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|192\.168\.|169\.254\.|2[3-5][0-9]\.)",
    "card": "^[3-6]",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Words shortly before a span that speak for its kind, and against any.
BEFORE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|serial|invoice|build|release|id)\b[^\n]{0,12}$"
CONTEXT = 40


def _luhn(digits: str) -> str:
    """SQL: whether the check sum of a string of digits is right."""
    d = f"CAST(substr({digits}, -place, 1) AS INT)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (luhn, place) -> luhn + "
        f"IF(place % 2 = 1, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"
    )


def _valid(kind: str) -> str:
    """SQL: whether a match ``v`` of the base pattern counts."""
    digits = "regexp_replace(v, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return rf"v RLIKE r'^{_PART}(?:\.{_PART}){{3}}$'"
    low, high = (16, 19) if kind == "card" else (8, 15)
    count = f"length({digits}) BETWEEN {low} AND {high}"
    return f"{count} AND {_luhn(digits)}" if kind == "card" else count


_SPAN = "STRUCT<kind: INT, form: INT, s: INT, e: INT, form_vote: INT, known: INT, before: INT, around: INT>"


def _hits(column: str, kind: int, form: str) -> str:
    """SQL: spans and votes of the matches in ``<column>_h``, between the gaps ``<column>_g``."""
    name, h, g = KINDS[kind], f"{column}_h", f"{column}_g"
    places = (
        f"aggregate(sequence(0, size({h}) - 1), named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), "
        f"(a, i) -> named_struct('at', a.at + length({g}[i]) + length({h}[i]), "
        f"'out', concat(a.out, array(a.at + length({g}[i])))), a -> a.out)"
    )
    before = f"right({g}[i], {CONTEXT})"
    tight = f"({g}[i] RLIKE r'[\\p{{L}}\\p{{N}}]$' OR {g}[i + 1] RLIKE r'^[\\p{{L}}\\p{{N}}]')"
    form = form.replace("(v)", f"({h}[i])").replace("v RLIKE", f"{h}[i] RLIKE").replace("(v,", f"({h}[i],")
    row = (
        f"named_struct('kind', {kind}, 'form', {form}, 's', s, 'e', s + length({h}[i]), 'form_vote', 0, "
        f"'known', IF({h}[i] RLIKE r'{KNOWN[name]}', 1, -1), "
        f"'before', IF({before} RLIKE r'{AGAINST}', -1, IF({before} RLIKE r'{BEFORE[name]}', 1, 0)), "
        f"'around', IF({tight}, -1, 1))"
    )
    spans = f"transform({places}, (s, i) -> {row})"
    voted = (
        f"transform({spans}, x -> named_struct('kind', x.kind, 'form', x.form, 's', x.s, 'e', x.e, "
        f"'form_vote', IF(x.form = 2, -1, 1), 'known', x.known, 'before', x.before, 'around', x.around))"
    )
    return f"IF(size({h}) > 0, {voted}, CAST(array() AS ARRAY<{_SPAN}>))"


def candidates(docs: DataFrame) -> DataFrame:
    """The rows with ``_base`` (valid base spans) and ``_more`` (other candidates), with form and votes.

    Forms: 0 base, 1 wider pattern, 2 a base match that failed validation.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_t", text)
    none = F.expr("CAST(array() AS ARRAY<STRING>)")

    def matched(pattern: str, when: Column) -> tuple[Column, Column]:
        hits = F.when(when, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none)
        return hits, F.split("_t", pattern, -1)

    found = []
    for kind, name in enumerate(KINDS):
        quick = {"email": F.col("_t").contains("@"), "phone": F.col("_t").contains("+")}.get(
            name, F.col("_t").rlike("[0-9]")
        )
        patterns = [(f"_{name}", BASE[name], quick, f"IF({_valid(name)}, 0, 2)")]
        if name in WIDER:
            patterns.append((f"_{name}w", WIDER[name][0], F.col("_t").rlike(WIDER[name][1]), "1"))
        for column, pattern, when, form in patterns:
            hits, gaps = matched(pattern, when)
            out = out.withColumn(f"{column}_h", hits)
            out = out.withColumn(f"{column}_g", F.when(F.size(f"{column}_h") > 0, gaps).otherwise(none))
            found.append((column, _hits(column, kind, form)))
    out = out.withColumn("_all", F.flatten(F.array(*(F.expr(sql) for _, sql in found))))
    out = out.drop(*(f"{column}_{x}" for column, _ in found for x in "hg"))
    out = out.withColumn("_base", F.expr("filter(_all, c -> c.form = 0)"))
    apart = "filter(_all, c -> c.form > 0 AND NOT exists(_base, b -> b.s < c.e AND c.s < b.e))"
    return out.withColumn("_more", F.expr(apart)).drop("_all", "_t")


@dataclass(frozen=True)
class PiiModel:
    """Weights of the span classifier: constant, kinds, forms 1 and 2, votes. ``votes``: EM's estimates."""

    weights: tuple[float, ...]
    votes: tuple[float, ...] = ()


_VOTES = ("form_vote", "known", "before", "around")
_X = (
    "array(1D, "
    + ", ".join(f"IF(kind = {k}, 1D, 0D)" for k in range(len(KINDS)))
    + ", IF(form = 1, 1D, 0D), IF(form = 2, 1D, 0D), "
    + ", ".join(f"CAST({v} AS DOUBLE)" for v in _VOTES)
    + ")"
)
_WIDTH = 1 + len(KINDS) + 2 + len(_VOTES)


def fit(docs: DataFrame, em_steps: int = 20, steps: int = 300, rate: float = 2.0) -> PiiModel:
    """Estimate labelers by EM over all candidates of all texts, then fit the span classifier."""
    seen = candidates(docs.select("text")).select(F.explode(F.concat("_base", "_more")).alias("c")).select("c.*")
    counts = seen.groupBy("kind", "form", *_VOTES).agg(F.count("*").cast("double").alias("n"))
    patterns = counts.select(
        F.expr(f"named_struct('kind', kind, 'v', array({', '.join(_VOTES)}), 'x', {_X}, 'n', n)").alias("p")
    ).agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most 4 kinds x 3 forms x 81 votes

    total = "aggregate(zip_with(ps, a.q, (p, y) -> {0}), 0D, (u, w) -> u + w)"
    # The state of EM: shares by kind, then each labeler's vote probabilities, given yes and given no.
    kinds, labelers = len(KINDS), len(_VOTES)

    def place(j: int, yes: int) -> str:
        return f"{kinds + (yes * labelers + j) * 3 + 1} + p.v[{j}] + 1"

    def likely(yes: int) -> str:
        prior = "element_at(a.t, p.kind + 1)"
        return " * ".join([prior if yes else f"(1 - {prior})", *(f"element_at(a.t, {place(j, yes)})" for j in range(labelers))])

    guess = f"transform(ps, p -> ({likely(1)}) / (({likely(1)}) + ({likely(0)})))"
    maximised = [
        f"({total.format(f'IF(p.kind = {k}, p.n * y, 0D)')} + 1) / ({total.format(f'IF(p.kind = {k}, p.n, 0D)')} + 2)"
        for k in range(kinds)
    ]
    for yes in (0, 1):
        y = "y" if yes else "(1 - y)"
        for j in range(labelers):
            for vote in (-1, 0, 1):
                hit = total.format(f"IF(p.v[{j}] = {vote}, p.n * {y}, 0D)")
                maximised.append(f"({hit} + 1) / ({total.format(f'p.n * {y}')} + 3)")
    majority = "transform(ps, p -> (aggregate(p.v, 0D, (u, w) -> u + w) + 5) / 10)"
    em = (
        f"aggregate(sequence(1, {2 * em_steps}), named_struct('t', CAST(array() AS ARRAY<DOUBLE>), 'q', {majority}), "
        f"(a, i) -> IF(i % 2 = 1, named_struct('t', array({', '.join(maximised)}), 'q', a.q), "
        f"named_struct('t', a.t, 'q', {guess})))"
    )
    product = "aggregate(zip_with(a.w, p.x, (u, w) -> u * w), 0D, (u, w) -> u + w)"
    wrong = f"zip_with(ps, em.q, (p, y) -> p.n * (y - 1 / (1 + exp(-{product}))))"
    slope = "aggregate(zip_with(ps, a.r, (p, y) -> p.x[{0}] * y), 0D, (u, w) -> u + w)"
    stepped = ", ".join(f"a.w[{d}] * 0.9999D + {rate}D * ({slope.format(d)}) / mass" for d in range(_WIDTH))
    logistic = (
        f"aggregate(sequence(1, {2 * steps}), named_struct('w', array_repeat(0D, {_WIDTH}), 'r', CAST(array() AS ARRAY<DOUBLE>)), "
        f"(a, i) -> IF(i % 2 = 1, named_struct('w', a.w, 'r', {wrong}), named_struct('w', array({stepped}), 'r', a.r)), a -> a.w)"
    )
    model = (
        patterns.where("size(ps) > 0")
        .withColumn("mass", F.expr("aggregate(ps, 0D, (u, p) -> u + p.n)"))
        .withColumn("em", F.expr(em))
        .select(F.expr(logistic).alias("w"), F.col("em.t").alias("t"))
        .first()
    )
    if model is None:
        return PiiModel((0.0,) * _WIDTH)
    return PiiModel(tuple(model["w"]), tuple(model["t"]))


def label_spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The rows with ``base_spans`` and ``spans``: arrays of kind (number in ``KINDS``), s and e, in that order."""
    kept = [field(c) for c in docs.columns if c not in ("base_spans", "spans")]
    return _labelled(docs, model).select(*kept, "base_spans", "spans")


def _labelled(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The input's ``row`` as a struct, its text, and its spans."""
    w = model.weights
    terms = [f"{w[0]!r}D", f"CASE c.kind {' '.join(f'WHEN {k} THEN {w[1 + k]!r}D' for k in range(len(KINDS)))} END"]
    at = 1 + len(KINDS)
    terms.append(f"CASE c.form WHEN 1 THEN {w[at]!r}D WHEN 2 THEN {w[at + 1]!r}D ELSE 0D END")
    terms += [f"{w[at + 2 + j]!r}D * c.{vote}" for j, vote in enumerate(_VOTES)]
    likely = f"1 / (1 + exp(-({' + '.join(terms)})))"
    short = "transform({0}, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))"
    out = candidates(docs.select(F.struct("*").alias("row"), "text"))
    added = f"filter(_more, c -> c.form = 1 AND {likely} >= {THRESHOLD}D)"
    return out.select(
        "row",
        "text",
        F.expr(f"array_sort({short.format('_base')})").alias("base_spans"),
        F.expr(f"array_distinct(array_sort({short.format(f'concat(_base, {added})')}))").alias("spans"),
    )


def written(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kind = f"element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1)"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {kind}, x.s, x.e)), ',')")


def redacted(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The rows with every span of the text replaced by its kind in angle brackets."""
    tags = f"element_at(array({', '.join(repr(f'<{k.upper()}>') for k in KINDS)}), x.kind + 1)"
    pieces = (
        "aggregate(array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind))), "
        "named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRING>)), "
        "(a, x) -> IF(x.s >= a.at, named_struct('at', x.e, 'out', "
        f"concat(a.out, array(substr(text, a.at + 1, x.s - a.at), {tags}))), "
        "named_struct('at', greatest(a.at, x.e), 'out', a.out)), "
        "a -> concat(a.out, array(substr(text, a.at + 1))))"
    )
    text = F.when(F.size("spans") > 0, F.expr(f"array_join({pieces}, '')")).otherwise(F.col("text"))
    return _labelled(docs, model).select(*(text.alias("text") if c == "text" else field(c) for c in docs.columns))
