"""Queries over recognised spans.

The texts are all documents. What documents never hold (addresses of machines, bank numbers of other lands, places, map
links) is sought in them and in one made sentence per customer, so that every recogniser has something to find: the
sentence holds numbers with right and wrong check digits, built by the same arithmetic in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import validators
from sheafwork.operators import dictionary, recognise
from sheafwork.session import spread, table

# The SQL below is read by both engines: k is the customer, every number follows from it.
_K = "cast(c_custkey as bigint)"
_D = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
_LETTER = lambda x: f"chr(cast(65 + ({x}) % 26 as int))"
_FIELDS = f"""select k, {_D('(k * 7919) % 100000000', 8)} as account, {_D('(k * 31) % 100', 2)} as s1, {_D('(k * 17) % 100', 2)} as s2, {_D('(k * 13) % 100', 2)} as s3,
 {_D('(k * 104729 + 12345678) % 1000000000', 9)} as nine, (k * 7919000013) % 100000000000000 as d14, {_D('(k * 7907 + 400000000000000) % 1000000000000000', 15)} as c15 from (select {_K} as k from {{customer}}) t0"""
_NHS = "(11 - (" + " + ".join(f"cast(substring(nine, {i}, 1) as int) * {11 - i}" for i in range(1, 10)) + ") % 11) % 11"
_CARD = "(10 - (" + " + ".join(f"(case when cast(substring(c15, {i}, 1) as int) * {2 if i % 2 else 1} > 9 then cast(substring(c15, {i}, 1) as int) * {2 if i % 2 else 1} - 9 else cast(substring(c15, {i}, 1) as int) * {2 if i % 2 else 1} end)" for i in range(1, 16)) + ") % 10) % 10"
# remainder of NWBK (23321120), fourteen digits, GB00 (161100) by 97, in steps that stay within eight bytes
_REST = f"(((({23321120 % 97} * {10**14 % 97} + d14 % 97) % 97) * {10**6 % 97} + {161100 % 97}) % 97)"
_SYNTH = f"""select -k as doc_id, concat('Call +44 20 ', substring(nine, 1, 4), ' ', substring(nine, 5, 4), ' or mail user_', cast(k as string), '@mail', cast(k % 9 as string), '.example.org. ',
 'IBAN GB', {_D('case when k % 5 = 0 then 11 else 98 - rest end', 2)}, 'NWBK', {_D('d14', 14)}, ', account ', account, ', sort code ', s1, '-', s2, case when k % 3 = 0 then chr(160) else '-' end, s3, '. ',
 'Card ', substring(c15, 1, 4), ' ', substring(c15, 5, 4), ' ', substring(c15, 9, 4), ' ', substring(c15, 13, 3), cast(case when k % 4 = 0 then 0 else card end as string), ', NHS ', substring(nine, 1, 3), ' ', substring(nine, 4, 3), ' ', substring(nine, 7, 3), cast(nhs % 10 as string), ', UTR ', nine, '5. ',
 {_LETTER('k')}, {_LETTER('k * 3')}, ' ', s1, ' ', s2, ' ', s3, ' ', {_LETTER('k % 5')}, ' of ', {_LETTER('k')}, {_LETTER('k * 7')}, cast(k % 9 + 1 as string), ' ', cast(k % 10 as string), {_LETTER('k * 5')}, {_LETTER('k * 11')}, ', DVLA ', {_LETTER('k')}, {_LETTER('k * 2')}, {_LETTER('k * 3')}, '99', s1, s2, s3, 'AB', cast(k % 10 as string), 'CD, born ', s1, '/0', cast(k % 9 + 1 as string), '/19', s2, '. ',
 'Seen at 10.', cast(k % 256 as string), '.', cast(k % 300 as string), '.7, coord ', cast(k % 100 as string), '.', nine, ', -', cast(k % 200 as string), '.', nine, ', https://', case k % 4 when 0 then 'www.google.co.uk/maps/@' when 1 then 'maps.apple.com/?q=' when 2 then 'openstreetmap.org/node/' else 'bank.example/help/' end, account, ' BIC NWBKGB2L', case when k % 2 = 0 then 'XXX' else '' end, ' caf', chr(233), account) as text
 from (select *, {_REST} as rest, {_NHS} as nhs, {_CARD} as card from ({_FIELDS}) t1) t2"""
_TEXTS = f"select doc_id, text from {{documents}} union all {_SYNTH}"
#: Recognisers that find nothing, or next to nothing, in the documents.
MADE = ("ip", "url", "iban", "card", "uk_iban", "lat_long", "map_google", "map_apple", "map_osm")
TEXTS_SQL = _TEXTS.replace("{documents}", "documents").replace("{customer}", "customer")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents and a made sentence per customer (negative ids), over all cores."""
    return spread(spark.sql(_TEXTS, documents=table(spark, sf_dir, "documents"), customer=table(spark, sf_dir, "customer")), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), 1)


def _one(r: recognise.Recogniser) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = texts if r.name in MADE else documents
        return recognise.spans(read(spark, sf_dir), "doc_id", recognisers=(r,)).select("doc_id", "start_pos", "end_pos", "value", "score")

    return query


def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all recognisers by type, category, risk and sensitivity, in one pass."""
    return _summary(recognise.spans(documents(spark, sf_dir), "doc_id"))


def span_summary_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents and made sentences: all types have rows."""
    return _summary(recognise.spans(texts(spark, sf_dir), "doc_id"))


def _summary(found: DataFrame) -> DataFrame:
    kind = F.col("entity_type")
    per_text = found.groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    return per_text.groupBy("entity_type", recognise.category(kind).alias("category"), recognise.risk(kind).alias("risk"), recognise.sensitivity(kind).alias("sensitivity")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"))


def span_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences in the documents of every value that people marked in the gold items."""
    entries = table(spark, sf_dir, "gold_items").select(F.inline("entities")).select("entity_type", F.col("entity_text").alias("value"))
    return dictionary.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", entries)


def recogniser_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type with its jurisdictions and whether any of its recognisers checks its values."""
    rows = [(r.entity_type, r.jurisdiction, r.validator is not None, r.score) for r in recognise.RECOGNISERS]
    specs = spark.createDataFrame(rows, "entity_type string, jurisdiction string, checked boolean, score double")
    return specs.groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_set("jurisdiction")), ",").alias("jurisdictions"), F.bool_or("checked").alias("has_validator"), F.count(F.lit(1)).alias("n_recognisers"), F.max("score").alias("best_score"))


def _check(name: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(f"select doc_id, {column} as value from ({_CHECKED})", customer=table(spark, sf_dir, "customer"))
        return rows.select("doc_id", "value", F.coalesce(getattr(validators, name)(F.col("value")), F.lit(False)).alias("valid"))

    return query


_CHECKED = f"""select -k as doc_id, concat(case when k % 7 = 0 then 'DE' else 'GB' end, {_D('case when k % 5 = 0 then 11 else 98 - rest end', 2)}, ' NWBK ', {_D('d14', 14)}) as iban,
 concat(substring(c15, 1, 4), '-', substring(c15, 5, 11), cast(case when k % 4 = 0 then 0 else card end as string)) as card, concat(substring(nine, 1, 3), ' ', substring(nine, 4, 6), cast(nhs % 10 as string)) as nhs,
 concat({_LETTER('k')}, {_LETTER('k * 3')}, ' ', s1, s2, s3, {_LETTER('k % 5')}) as nino, concat(cast(k % 100 as string), '.', nine, ', -', cast(k % 200 as string), '.', nine) as place
 from (select *, {_REST} as rest, {_NHS} as nhs, {_CARD} as card from ({_FIELDS}) t1) t2"""
_COLUMNS = {"luhn": "card", "iban": "iban", "uk_iban": "iban", "nino": "nino", "nhs": "nhs", "lat_long": "place"}


def _in(values: tuple[str, ...]) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


_ALL = " union all ".join(f"select '{r.entity_type}' as entity_type, doc_id, score from ({recognise.spans_sql('texts', 'doc_id', r)})" for r in recognise.RECOGNISERS)
_PLAIN = "select doc_id, text from documents"
_SUMMARY = f"""with texts as ({{texts}}) select entity_type, case when entity_type in ('QR_CODE','BAR_CODE') then 'Visual' when entity_type = 'LAT_LONG_PAIR' or entity_type like 'MAP_URL%' then 'Location' when entity_type in ('EMAIL_ADDRESS','URL') then 'Network' else 'PII' end as category,
case when entity_type in {_in(recognise.HIGH_RISK)} then 'high' when entity_type in {_in(recognise.LOW_RISK)} then 'low' else 'medium' end as risk,
case when entity_type in {_in(recognise.SPECIAL)} then 'special_category' else 'personal_data' end as sensitivity,
count(*) as n, count(distinct doc_id) as n_docs, round(avg(score), 6) as mean_score from ({{all}}) group by all"""
_TAXONOMY = ", ".join(f"('{r.entity_type}', '{r.jurisdiction}', {str(r.validator is not None).lower()}, {r.score}::double)" for r in recognise.RECOGNISERS)
QUERIES = {
    **{f"span_{r.name}": _one(r) for r in recognise.RECOGNISERS + recognise.LEGACY},
    **{f"validate_{name}": _check(name, column) for name, column in _COLUMNS.items()},
    "span_summary": span_summary,
    "span_summary_made": span_summary_made,
    "span_dictionary": span_dictionary,
    "recogniser_taxonomy": recogniser_taxonomy,
}
ORACLES = {
    **{f"span_{r.name}": f"with texts as ({TEXTS_SQL if r.name in MADE else _PLAIN}) select * from ({recognise.spans_sql('texts', 'doc_id', r)})" for r in recognise.RECOGNISERS + recognise.LEGACY},
    **{f"validate_{name}": f"select doc_id, value, coalesce({validators.SQL[name].format(v='value')}, false) as valid from (select doc_id, {column} as value from ({_CHECKED.replace('{customer}', 'customer')}))" for name, column in _COLUMNS.items()},
    "span_summary": _SUMMARY.replace("{texts}", _PLAIN).replace("{all}", _ALL),
    "span_summary_made": _SUMMARY.replace("{texts}", TEXTS_SQL).replace("{all}", _ALL),
    "span_dictionary": dictionary.spans_sql("documents", "doc_id", "select distinct e.entity_type as entity_type, trim(e.entity_text) as value from (select unnest(entities) as e from gold_items)"),
    "recogniser_taxonomy": f"select entity_type, string_agg(distinct jurisdiction, ',' order by jurisdiction) as jurisdictions, bool_or(checked) as has_validator, count(*) as n_recognisers, max(score) as best_score from (values {_TAXONOMY}) t(entity_type, jurisdiction, checked, score) group by 1",
}
