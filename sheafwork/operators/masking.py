"""Masks and same-length stand-ins for values, as SQL that both engines read, and their use inside a text.

A mask is an expression over ``entity_type`` and ``value``. Stand-ins ("mocks") have the length of the value, keep its
letters, digits and separators apart, and are the same for the same (run, type, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mode of a type (fixed values); others are replaced.
MODES = {
    "partial": ("CREDIT_CARD_NUMBER", "UK_BANK_ACCOUNT_NUMBER", "UK_SORT_CODE", "UK_IBAN", "IBAN", "EMAIL_ADDRESS", "UK_PHONE_NUMBER"),
    "replace": ("CARD_CVV", "UK_NATIONAL_INSURANCE_NUMBER", "UK_NHS_NUMBER", "UK_POSTCODE", "UK_ADDRESS", "PERSON"),
}
_KEEP = "greatest(2, cast(floor(length(value) / 4) as int))"
_AT = "instr(value, '@')"
MASKS = {
    "replace": "concat('<', entity_type, '>')",
    "partial": f"case when length(value) <= 4 then repeat('*', cast(length(value) as int)) when {_AT} > 0 then concat(left(value, cast(least(1, {_AT} - 1) as int)), repeat('*', cast(greatest(1, {_AT} - 2) as int)), '@', substring(value, cast({_AT} + 1 as int))) else concat(left(value, {_KEEP}), repeat('*', cast(length(value) - 2 * {_KEEP} as int)), right(value, {_KEEP})) end",
    "hash": "concat('HASH_', left({sha}, 8))",
    "remove": "''",
    "legacy": "case when entity_type in ('UK_BANK_ACCOUNT_NUMBER', 'UK_ACCOUNT_NUMBER', 'CREDIT_CARD', 'CREDIT_CARD_NUMBER', 'IBAN', 'IBAN_CODE', 'UK_IBAN') then concat(repeat('*', cast(greatest(0, length(value) - 4) as int)), right(value, 4)) when entity_type in ('PERSON', 'LOCATION') then concat('[', entity_type, ']') else repeat('*', cast(length(value) as int)) end",
}
SHA = ("sha2(value, 256)", "sha256(value)")


def mask_sql(mode: str, engine: int = 0) -> str:
    """The mask of one mode; ``engine`` 0 is Spark, 1 the checking engine."""
    return MASKS[mode].replace("{sha}", SHA[engine])


def default_sql(engine: int = 0, overrides: dict[str, str] | None = None, default: str = "replace") -> str:
    """Each type by its own mode: an override, else the table, else ``default``; an unknown mode replaces."""
    modes = {t: m for m, types in MODES.items() for t in types}
    modes.update(overrides or {})
    cases = " ".join(f"when entity_type = '{t}' then {mask_sql(m if m in MASKS else 'replace', engine)}" for t, m in sorted(modes.items()))
    return f"case {cases} else {mask_sql(default if default in MASKS else 'replace', engine)} end"


# Mocks: one hash per character. The first letters of a national insurance number come from letters that make no refused pair.
_HEAD, _SECOND, _TAIL = "ABCEGHJKLMNOPRSTWXYZ", "ACEHJLMPRSWXY", "ABCD"
_URL = ("URL", "MAP_URL_GOOGLE", "MAP_URL_APPLE", "MAP_URL_OSM")


def mock_sql(run: str, engine: int = 0) -> str:
    """Same-length stand-in of ``value``: letters for letters, digits for digits, the rest as it is."""
    urls = ", ".join(f"'{t}'" for t in _URL)
    kept = f"case when entity_type in ({urls}) and value like 'https://%' then 8 when entity_type in ({urls}) and value like 'http://%' then 7 when entity_type in ('IBAN', 'UK_IBAN') and upper(value) like 'GB%' then 2 else 0 end"
    salt = f"concat('{run}::', entity_type, '::', value, '::', cast({'i' if engine == 0 else 'i - 1'} as string))"
    if engine == 0:
        n = f"cast(conv(substring(sha2({salt}, 256), 1, 6), 16, 10) as bigint)"
        pick = lambda letters: f"substring('{letters}', cast({n} % {len(letters)} + 1 as int), 1)"
        is_ = lambda cls: f"c rlike '^{cls}$'"
        before = "length(regexp_replace(substring(value, 1, i), '[^\\\\p{L}]', ''))"
        nth = "i"
        head = "array_join(transform(filter(split(value, ''), c -> c <> ''), (c, i) -> "
        tail = "), '')"
        low, any_, num = "\\\\p{Ll}", "\\\\p{L}", "\\\\p{Nd}"
    else:
        n = f"('0x' || substring(sha256({salt}), 1, 6))::bigint"
        pick = lambda letters: f"substring('{letters}', ({n} % {len(letters)} + 1)::int, 1)"
        is_ = lambda cls: f"regexp_full_match(c, '{cls}')"
        before = "length(regexp_replace(substring(value, 1, (i - 1)::int), '[^\\p{L}]', '', 'g'))"
        nth = "i - 1"
        head = "array_to_string(list_transform(string_split(value, ''), lambda c, i: "
        tail = "), '')"
        low, any_, num = "\\p{Ll}", "\\p{L}", "\\p{Nd}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    nino = f"entity_type = 'UK_NATIONAL_INSURANCE_NUMBER' and {is_(any_)}"
    lowers = f"({is_(low)} or (entity_type = 'EMAIL_ADDRESS' and {is_(any_)}))"
    case = f"case when {nth} < {kept} then c when {nino} then case {before} when 0 then {pick(_HEAD)} when 1 then {pick(_SECOND)} else {pick(_TAIL)} end when entity_type = 'UK_POSTCODE' and {is_(any_)} then {pick(upper)} when {lowers} then {pick(lower)} when {is_(any_)} then {pick(upper)} when {is_(num)} then {pick('0123456789')} else c end"
    return f"{head}{case}{tail}"


def spliced(text: Column, spans: Column) -> Column:
    """``text`` with each of the spans (start_pos, end_pos, new; in order, apart) replaced by ``new``."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_pos"]))
    starts = F.concat(F.transform(spans, lambda s: s["start_pos"]), F.array(F.length(text)))
    news = F.concat(F.transform(spans, lambda s: s["new"]), F.array(F.lit("")))
    plain = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"]))
    return F.array_join(F.zip_with(plain, news, lambda p, n: F.concat(p, n)), "")


def mapped(spans: Column) -> Column:
    """The spans with ``new_start`` and ``new_end``: where their replacements stand in the new text; one fold."""
    first = F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<start_pos:int,end_pos:int,new_start:int,new_end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = s["start_pos"] + acc["by"]
        return F.struct((acc["by"] + F.length(s["new"]) - (s["end_pos"] - s["start_pos"])).alias("by"), F.concat(acc["out"], F.array(F.struct(s["start_pos"], s["end_pos"], at.alias("new_start"), (at + F.length(s["new"])).alias("new_end")))).alias("out"))

    return F.aggregate(spans, first, step, lambda acc: acc["out"])


def apart(spans: DataFrame, key: str) -> DataFrame:
    """Spans of each text without overlaps: by start, then the higher score, then the end; what begins inside is left out."""
    from sheafwork.operators.span_algebra import resolve

    lists = spans.groupBy(key).agg(resolve(F.collect_list(F.struct("start_pos", "end_pos", "score", "entity_type"))).alias("s"))
    return lists.select(key, F.inline("s"))


def replaced(texts: DataFrame, spans: DataFrame, key: str, new: str, text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos, entity_type, value, new) of the spans as they are replaced; ``new`` is SQL over value and type."""
    cut = texts.select(key, F.col(text).alias("_t")).join(apart(spans, key), key).select(key, "start_pos", "end_pos", "entity_type", F.expr("substring(_t, start_pos + 1, end_pos - start_pos)").alias("value"))
    return cut.withColumn("new", F.expr(new))


def applied(texts: DataFrame, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, new_text, spans, n) for every text, also those without spans; null texts stay null."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "new"))).alias("s"))
    out = texts.select(key, F.col(text).alias("_t")).join(lists, key, "left")
    s = F.coalesce("s", F.array().cast("array<struct<start_pos:int,end_pos:int,new:string>>"))
    return out.select(key, F.when(F.col("_t").isNotNull(), spliced(F.col("_t"), s)).alias("new_text"), mapped(s).alias("spans"), F.size(s).alias("n"))
