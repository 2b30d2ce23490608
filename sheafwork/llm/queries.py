"""Queries over the operators of this package; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import consensus, leaks, linkage, mixing, pii, scans, sentences, survivors
from sheafwork.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"), pii.fit_on(table(spark, sf_dir, "gold_items")))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"), pii.fit_on(table(spark, sf_dir, "gold_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "detections")).select("item_id", "entity_type")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(table(spark, sf_dir, "detections"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(table(spark, sf_dir, "detections"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_confidence(spark, sf_dir).select("region_uid", "rescan_uid")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.linked(table(spark, sf_dir, "regions"), table(spark, sf_dir, "rescan_regions"), table(spark, sf_dir, "page_results"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_lines(table(spark, sf_dir, "page_results"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "page_results"))


def p5_repaired_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_regions(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "regions"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "gold_items")
    return leaks.leaked_items(leaks.leaks(table(spark, sf_dir, "documents"), items), items)


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.page_survivors(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "runs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = survivors.page_survivors(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "runs"))
    return kept.where("n_records > 1").select(F.col("survivor_id").alias("page_row_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "gold_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_reliability": p2_reliability, "p2_agreement": p2_agreement, "p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p5_repaired": p5_repaired, "p5_repaired_regions": p5_repaired_regions, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_quotas": p8_quotas, "p9_found": p9_found}

_DOC = "regexp_replace(regexp_replace(lower(trim(document_id)), '^uploads/', ''), '[.]pdf$', '')"
#: Where SQL can say the same over whole tables.
ORACLES: dict[str, str] = {
    "p6_found": f"""with u as (select run_id, max(updated_at) as r, min(started_at) as f from runs where run_id is not null group by 1),
p as (select page_row_id, {_DOC} as d, solution, page_index, (coalesce(len(regions), 0) > 0 or coalesce(n_tables, 0) > 0)::int as c, coalesce(case when confidence > 1 then confidence / 100 else confidence end, 0) as t, r, f from page_results left join u using (run_id)),
o as (select *, row_number() over (partition by d, solution, page_index, page_row_id order by c desc, t desc, r desc nulls last, f nulls last) as again from p),
k as (select page_row_id, row_number() over (partition by d, solution, page_index order by c desc, t desc, r desc nulls last, f nulls last, page_row_id) as place, count(*) over (partition by d, solution, page_index) as n from o where again = 1)
select page_row_id from k where place = 1 and n > 1""",
}
