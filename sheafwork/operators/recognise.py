"""Recognisers: every match of a pattern in a text as a span with a score, all in one pass and without Python.

Word boundaries, blanks and digits are those of Unicode. Matches are found on a copy of the text of the same length in
which combining marks are control characters, since a mark is no part of a word here; values are cut from the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import validators


@dataclass(frozen=True)
class Recogniser:
    name: str
    entity_type: str
    pattern: str
    score: float
    boost: float
    terms: tuple[str, ...] = ()
    validator: str | None = None
    ignore_case: bool = True
    #: A text without this character has no match; saves the pattern on most texts.
    needs: str | None = None
    jurisdiction: str = "GLOBAL_COMMON"
    #: Group of the pattern that is the value; the match around it must not repeat a boundary inside.
    group: int = 0


#: Fixed values.
RECOGNISERS = (
    Recogniser("email", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.90, 0.20, ("email", "e-mail", "contact"), needs="@"),
    Recogniser("ip", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.85, 0.20, needs="."),
    Recogniser("url", "URL", r"\bhttps?://[^\s<>\"']+\b", 0.85, 0.20, needs="://"),
    Recogniser("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b", 0.70, 0.20, ("iban", "bank account"), "iban", False),
    Recogniser("swift", "SWIFT_BIC", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.70, 0.20, ("swift", "bic"), None, False),
    Recogniser("card", "CREDIT_CARD_NUMBER", r"\b(?:\d[ \-]?){13,19}\b", 0.55, 0.20, ("card", "credit", "debit", "visa", "mastercard"), "luhn"),
    Recogniser("date", "DATE", r"\b(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b", 0.50, 0.20),
    Recogniser("postcode", "UK_POSTCODE", r"\b(?:GIR\s?0AA|(?:[A-PR-UWYZ][A-HK-Y0-9][A-HJKPSTUW0-9]?[ABEHMNPRVWXY0-9]?\s?[0-9][ABD-HJLNP-UW-Z]{2}))\b", 0.90, 0.20, ("postcode", "post code", "address"), jurisdiction="UK"),
    Recogniser("phone", "UK_PHONE_NUMBER", r"(?:\+44\s?\(?0?\)?|\b0)(?:\d\s?){9,10}", 0.75, 0.20, ("phone", "mobile", "tel", "contact", "call", "sms"), jurisdiction="UK"),
    Recogniser("nino", "UK_NATIONAL_INSURANCE_NUMBER", r"\b(?!BG)(?!GB)(?!KN)(?!NK)(?!NT)(?!TN)(?!ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.90, 0.20, ("national insurance", "ni number", "nino"), "nino", jurisdiction="UK"),
    Recogniser("sort_code", "UK_SORT_CODE", r"\b\d{2}[-\s]\d{2}[-\s]\d{2}\b", 0.70, 0.20, ("sort code", "bank details"), jurisdiction="UK"),
    Recogniser("account", "UK_BANK_ACCOUNT_NUMBER", r"\b\d{8}\b", 0.40, 0.35, ("account", "bank", "account number", "a/c"), jurisdiction="UK"),
    Recogniser("uk_iban", "UK_IBAN", r"\bGB\d{2}[A-Z]{4}\d{14}\b", 0.90, 0.20, ("iban",), "uk_iban", jurisdiction="UK"),
    Recogniser("nhs", "UK_NHS_NUMBER", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b", 0.60, 0.30, ("nhs", "patient", "medical"), "nhs", jurisdiction="UK"),
    Recogniser("utr", "UK_UTR", r"\b\d{10}\b", 0.40, 0.45, ("utr", "unique taxpayer", "tax reference", "hmrc"), jurisdiction="UK"),
    Recogniser("licence", "UK_DRIVING_LICENCE_NUMBER", r"\b[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}\b", 0.85, 0.20, ("driving licence", "dvla"), None, False, jurisdiction="UK"),
    Recogniser("lat_long", "LAT_LONG_PAIR", r"[-+]?\d{1,3}\.\d{3,}\s*,\s*[-+]?\d{1,3}\.\d{3,}", 0.70, 0.20, ("lat", "long", "lng", "coord"), "lat_long", needs=",", jurisdiction="EXTRAS"),
    Recogniser("map_google", "MAP_URL_GOOGLE", r"https?://(?:www\.)?google\.[a-z.]+/maps[^\s<>\"']*", 0.95, 0.20, needs="://", jurisdiction="EXTRAS"),
    Recogniser("map_apple", "MAP_URL_APPLE", r"https?://maps\.apple\.com/[^\s<>\"']*", 0.95, 0.20, needs="://", jurisdiction="EXTRAS"),
    Recogniser("map_osm", "MAP_URL_OSM", r"https?://(?:www\.)?openstreetmap\.org/[^\s<>\"']*", 0.95, 0.20, needs="://", jurisdiction="EXTRAS"),
)
#: The older set for single regions (fixed values): sort code with hyphens, account number after its word, postcode.
LEGACY = (
    Recogniser("legacy_sort_code", "UK_SORT_CODE", r"\b\d{2}-\d{2}-\d{2}\b", 0.95, 0.0, (), None, False),
    Recogniser("legacy_account", "UK_ACCOUNT_NUMBER", r"\b(?:account(?:\s*(?:no\.?|number|#))?|a/c)\b[^0-9]{0,16}(\d{8})\b", 0.95, 0.0, group=1),
    Recogniser("legacy_postcode", "UK_POSTCODE", r"\b([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\b", 0.90, 0.0),
)
WINDOW = 60
#: Before and after a match in the marked text; the text itself has none of them.
_OPEN, _CLOSE = "\u0002", "\u0003"
_MASKED = r"[\u0001-\u0003\p{M}]"


def _flags(r: Recogniser) -> str:
    return "(?Ui)" if r.ignore_case else "(?U)"


def _marked(masked: Column, r: Recogniser) -> Column:
    """The text with ``_OPEN`` before and ``_CLOSE`` after each value: one run of the pattern per text."""
    new = f"{_OPEN}$0{_CLOSE}"
    pattern = r.pattern
    if r.group:  # the value is the last group and ends the match
        at = pattern.rindex("(")
        pattern, new = f"({pattern[:at]}){pattern[at:]}", f"$1{_OPEN}$2{_CLOSE}"
    out = F.regexp_replace(masked, F.lit(_flags(r) + pattern), F.lit(new))
    return F.when(F.contains(masked, F.lit(r.needs)), out) if r.needs else out


def positions(marked: str) -> str:
    """SQL for (a, n) of every value of a marked text, in one fold that carries the position."""
    return f"""transform(array(split({marked}, '{_OPEN}', -1)), parts -> aggregate(slice(parts, 2, greatest(size(parts) - 1, 0)),
 named_struct('at', length(parts[0]), 'out', cast(array() as array<struct<a:int,n:int>>)),
 (s, p) -> named_struct('at', s.at + length(p) - 1, 'out', concat(s.out, array(named_struct('a', s.at, 'n', instr(p, '{_CLOSE}') - 1)))),
 s -> s.out))[0]"""


def _values(text: str, marked: str) -> str:
    return f"transform({positions(marked)}, p -> named_struct('a', p.a, 'n', p.n, 'v', substring({text}, p.a + 1, p.n)))"


def _scored(low: str, values: str, r: Recogniser, order: int) -> str:
    near = f"substring({low}, greatest(s.a - {WINDOW}, 0) + 1, s.a + {WINDOW} - greatest(s.a - {WINDOW}, 0))"
    terms = ", ".join(f"'{t}'" for t in r.terms)
    score = f"if(exists(array({terms}), t -> contains({near}, t)), {min(1.0, r.score + r.boost)!r}D, {r.score!r}D)" if r.terms else f"{r.score!r}D"
    return f"coalesce(transform({values}, s -> named_struct('place', {order}, 'recogniser', '{r.name}', 'entity_type', '{r.entity_type}', 'start_pos', s.a, 'end_pos', s.a + s.n, 'value', s.v, 'score', {score})), array())"


def _accepts(r: Recogniser) -> Callable[[Column], Column]:
    valid = getattr(validators, r.validator)
    return lambda s: F.coalesce(valid(s["v"]), F.lit(False))


def spans(texts: DataFrame, key: str | list[str], text: str = "text", recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> DataFrame:
    """(key, place, recogniser, entity_type, start_pos, end_pos, value, score): every match of every recogniser.

    ``place`` is the recogniser's place in the list. Null and empty texts have none. Each text is read once for all
    recognisers, and each pattern runs once over it; other columns of ``texts`` are left alone.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = texts.where(F.length(text) > 0).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text).alias("_t"))
    base = base.select("*", F.regexp_replace("_t", _MASKED, "\u0001").alias("_m"), F.lower("_t").alias("_l"))
    base = base.select("*", *(_marked(F.col("_m"), r).alias(f"_r{i}") for i, r in enumerate(recognisers)))
    base = base.selectExpr(*(f"_k{i}" for i in range(len(keys))), "_l", *(f"{_values('_t', f'_r{i}')} as _v{i}" for i in range(len(recognisers))))
    checks = {f"_v{i}": F.filter(f"_v{i}", _accepts(r)) for i, r in enumerate(recognisers) if r.validator}
    base = base.withColumns(checks) if checks else base
    each = ", ".join(_scored("_l", f"_v{i}", r, i) for i, r in enumerate(recognisers))
    return base.selectExpr(*(f"_k{i} as `{k}`" for i, k in enumerate(keys)), f"inline(flatten(array({each})))")


# The same as SQL for an engine whose word boundaries are ASCII: letters outside ASCII are masked as underscores.
_BLANK = r"\s\x0b\x{85}\pZ"
_DIGITS = tuple("".join(chr(first + d) for first in (0x660, 0x6F0, 0x966, 0xE50, 0xFF10)) for d in range(10))


def re2(pattern: str) -> str:
    """``pattern`` with the blanks of Unicode and without look-ahead."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith("(?!", i):
            i = pattern.index(")", i) + 1
            continue
        step = 2 if pattern[i] == "\\" else 1
        piece = pattern[i : i + step]
        inside = (inside or piece == "[") and piece != "]"
        out.append((_BLANK if inside else f"[{_BLANK}]") if piece == r"\s" else piece)
        i += step
    return "".join(out)


def masked_sql(text: str) -> str:
    """SQL for the masked copy of ``text``: same length, ASCII letters and digits kept, other letters underscores."""
    digits = f"translate({text}, '{''.join(_DIGITS)}', '{''.join(str(d) * len(s) for d, s in enumerate(_DIGITS))}')"
    return f"regexp_replace(regexp_replace({digits}, '[\\x01-\\x03\\pM]', chr(1), 'g'), '[^\\x00-\\x7F\\pP\\pS\\pZ]', '_', 'g')"


def spans_sql(table: str, key: str, r: Recogniser, text: str = "text") -> str:
    """One recogniser as SQL with list functions: (key, start_pos, end_pos, value, score)."""
    pattern = ("(?i)" if r.ignore_case else "") + re2(r.pattern).replace("'", "''")
    valid = validators.SQL[r.validator].format(v="value") if r.validator else "true"
    near = f"substring(lower({text}), greatest(a - {WINDOW}, 0) + 1, a + {WINDOW} - greatest(a - {WINDOW}, 0))"
    boosted = " or ".join(f"contains({near}, '{t}')" for t in r.terms) or "false"
    # the local part of an address may hold underscores, so a masked letter can stand in it: cut up to the next boundary
    local = f"split_part(substring({text}, a0 + 1, n0), '@', 1)"
    drop = f"case when regexp_matches({local}, '[^\\x00-\\x7F]') then (length({local}) - length(regexp_replace(regexp_replace({local}, '^.*[^\\x00-\\x7F]', ''), '^[A-Za-z0-9_]+', '')))::integer else 0 end" if r.name == "email" else "0"
    live = f"where drop_n < length({local})" if r.name == "email" else ""
    value_at = f"length(hit) - length(regexp_extract(hit, '{pattern}', {r.group}))" if r.group else "0"
    return f"""
with t as (select {key}, {text}, {masked_sql(text)} as m from {table} where length({text}) > 0),
f as (select *, regexp_extract_all(m, '{pattern}') as found, string_split_regex(m, '{pattern}') as gaps from t),
e as (select {key}, {text}, unnest(found) as hit, unnest(range(len(found))) as i, found, gaps from f),
q as (select {key}, {text}, length(hit)::integer as n1, ({value_at})::integer as lead_n, (list_sum(list_transform(gaps[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0))::integer as a1 from e),
q0 as (select {key}, {text}, n1 - lead_n as n0, a1 + lead_n as a0 from q),
p0 as (select *, {drop} as drop_n from q0),
p as (select {key}, {text}, n0 - drop_n as n, a0 + drop_n as a from p0 {live}),
s as (select *, substring({text}, a + 1, n) as value from p)
select {key}, a as start_pos, a + n as end_pos, value, case when {boosted} then {min(1.0, r.score + r.boost)!r}::double else {r.score!r}::double end as score from s where {valid}"""


#: Fixed values.
HIGH_RISK = ("CREDIT_CARD_NUMBER", "CARD_CVV", "UK_BANK_ACCOUNT_NUMBER", "UK_IBAN", "IBAN", "UK_NATIONAL_INSURANCE_NUMBER", "UK_NHS_NUMBER")
LOW_RISK = ("ORGANISATION", "LOCATION", "DATE", "URL", "IP_ADDRESS")
SPECIAL = ("UK_NHS_NUMBER", "HEALTH_INFORMATION", "RELIGION_OR_BELIEF", "POLITICAL_OPINION", "TRADE_UNION_MEMBERSHIP", "SEXUAL_ORIENTATION", "BIOMETRIC_IDENTIFIER", "GENETIC_INFORMATION")


def risk(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*HIGH_RISK), "high").when(entity_type.isin(*LOW_RISK), "low").otherwise("medium")


def sensitivity(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*SPECIAL), "special_category").otherwise("personal_data")


def category(entity_type: Column) -> Column:
    return F.when(entity_type.isin("QR_CODE", "BAR_CODE"), "Visual").when((entity_type == "LAT_LONG_PAIR") | entity_type.startswith("MAP_URL"), "Location").when(entity_type.isin("EMAIL_ADDRESS", "URL"), "Network").otherwise("PII")
