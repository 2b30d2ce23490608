"""Sources mixed to target weights: Sainte-Laguë apportionment of equal token blocks, then seeded selection of blocks.

Block by block, the source with the highest quotient target / (2 * blocks + 1) gets the next one, as long as its cap
allows; the same is done for every shard, so that each shard has whole quotas too. The documents of a source are put
into a seeded order and cut into blocks of equal tokens; a quota of q blocks takes the whole order floor(q / blocks)
times and its first blocks once more.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheafwork.session import cut, spread

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKETS = 4096
#: Parts that the mix is dealt to, each with its own whole quotas.
SHARDS = 64
#: More targets than these are no list of sources.
MAX_SOURCES = 10_000


def source_key(column: str) -> Column:
    """One spelling of a source: small letters, words joined by underscores; null stays null."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def token_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the distinct documents; a null text has no tokens. ``ranks`` is a vocabulary file
    that every worker can read."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"].tolist()]})

    rows = documents.where("doc_id is not null").select("doc_id", source_key("source").alias("source"), "text")
    counted = spread(rows).mapInPandas(run, "doc_id long, source string, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max_by("source", "n_tokens").alias("source"), F.max("n_tokens").alias("n_tokens"))


def apportion(weights: dict[str, float], caps: dict[str, int], blocks: int) -> dict[str, int]:
    """Sainte-Laguë: ``blocks`` whole blocks to sources by highest quotients, none above its cap. Ties go to the source
    that comes first in the alphabet. Gives fewer blocks only where all caps are reached."""
    got = {s: 0 for s in weights}
    heap = [(-w, s) for s, w in sorted(weights.items()) if w > 0 and caps.get(s, 0) > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, s = heapq.heappop(heap)
        got[s] += 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-weights[s] / (2 * got[s] + 1), s))
    return got


def apportion_fast(weights: dict[str, float], caps: dict[str, int], blocks: int) -> dict[str, int]:
    """``apportion`` for any number of blocks: the quotient at which the blocks run out is found by halving, and only
    the blocks around it are given out one by one."""
    live = {s: w for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    blocks = min(blocks, sum(caps[s] for s in live))
    if blocks <= 0:
        return {s: 0 for s in weights}

    def above(q: float) -> dict[str, int]:
        # blocks whose quotient w / (2k + 1), k = 0.., is above q
        return {s: min(caps[s], max(0, int((w / q - 1) / 2) + 1 if w > q else 0)) for s, w in live.items()}

    low, high = min(live.values()) / (2 * blocks + 3), max(live.values()) * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if sum(above(mid).values()) > blocks:
            low = mid
        else:
            high = mid
    got = {s: max(0, n - 1) for s, n in above(high).items()}
    heap = [(-w / (2 * got[s] + 1), s) for s, w in sorted(live.items()) if got[s] < caps[s]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(got.values())):
        _, s = heapq.heappop(heap)
        got[s] += 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-live[s] / (2 * got[s] + 1), s))
    return {s: got.get(s, 0) for s in weights}


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], block: int, total: int | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """(quota, blocks) per source, in whole blocks.

    Sources without documents can't contribute; the others keep their proportions. Without ``total`` the mix is as large
    as the caps allow at these proportions: the source that runs out first sets the size.
    """
    blocks = {s: max(1, -(-totals[s] // block)) for s in targets if totals.get(s, 0) > 0}
    weights = {s: targets[s][0] for s in blocks if targets[s][0] > 0}
    caps = {s: blocks[s] * max(0, targets[s][1]) for s in weights}
    if not weights:
        return {}, blocks
    whole = sum(weights.values())
    if total is None:
        size = min(totals[s] * targets[s][1] * whole / w for s, w in weights.items())
        n = int(size // block)
    else:
        n = total // block
    return apportion_fast(weights, caps, n), blocks


def block_size(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """Tokens a block: about four documents' worth or a 20,000th of all, so that quotas come close to the targets."""
    used = sum(n for s, n in totals.items() if s in targets)
    return max(256, used // 20_000)


def _ordered(counts: DataFrame, seed: int) -> DataFrame:
    """``counts`` with ``at``, the tokens before each document in its source's seeded order.

    Sums run over buckets of the order first and inside a bucket then, so that a source may hold any share of the rows.
    """
    place = counts.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    place = place.withColumn("_b", F.shiftrightunsigned("_h", 64 - (BUCKETS.bit_length() - 1)).cast("int"))
    buckets = place.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_t"))
    before = buckets.select("source", "_b", F.coalesce(F.sum("_t").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return place.withColumn("_in", inside).join(before, ["source", "_b"]).select("doc_id", "source", "n_tokens", (F.col("_base") + F.col("_in")).alias("at"))


def _setup(documents: DataFrame, targets: DataFrame, block: int | None, total: int | None, ranks: str) -> tuple[DataFrame, dict, dict, dict, dict, int]:
    rows = targets.where("source is not null").groupBy(source_key("source").alias("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources")
    wanted = {r["source"]: (float(r["w"] or 0.0), int(r["m"] or 0)) for r in rows}
    counts = cut(token_counts(documents, ranks))
    totals = {r["source"]: r["t"] for r in counts.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()} if wanted else {}
    block = block or block_size(totals, wanted)
    quota, blocks = plan(totals, wanted, block, total)
    return counts, wanted, totals, quota, blocks, block


def shard_quotas(quota: dict[str, int], shards: int) -> list[dict[str, int]]:
    """Whole quotas per shard: each shard is apportioned from what is left, so that they add up to ``quota``."""
    left, out = dict(quota), []
    total = sum(quota.values())
    for i in range(shards):
        size = total * (i + 1) // shards - total * i // shards
        got = apportion_fast({s: float(q) for s, q in quota.items()}, left, size)
        short = size - sum(got.values())
        for s in sorted(left):
            more = min(short, left[s] - got[s])
            got[s] += more
            short -= more
        left = {s: left[s] - got[s] for s in left}
        out.append(got)
    return out


def _drawn(counts: DataFrame, quota: dict[str, int], blocks: dict[str, int], block: int, seed: int, shards: int) -> DataFrame:
    """(doc_id, source, n_tokens, shard, copy): one row per draw.

    The draws of a source are its blocks in seeded order, again and again until its quota is used up; the shards take
    them in turn, each as many blocks of the source as its own quota says.
    """
    if not any(quota.values()):
        return counts.select("doc_id", "source", "n_tokens", F.lit(0).alias("shard"), F.lit(0).alias("copy")).limit(0)
    usable = counts.where(F.col("source").isin([s for s, q in quota.items() if q]) & (F.col("n_tokens") > 0))
    pick = lambda values: F.coalesce(*(F.when(F.col("source") == s, v) for s, v in values.items()))
    lit = lambda values: pick({s: F.lit(v) for s, v in values.items()})
    full = {s: q // blocks[s] for s, q in quota.items()}
    rest = {s: q % blocks[s] for s, q in quota.items()}
    ends: dict[str, list[int]] = {s: [] for s in quota}
    for got in shard_quotas(quota, shards):
        for s in quota:
            ends[s].append((ends[s][-1] if ends[s] else 0) + got.get(s, 0))
    rows = _ordered(usable, seed).withColumn("_number", F.floor(F.col("at") / block))
    rows = rows.withColumn("_n", (lit(full) + F.when(F.col("_number") < lit(rest), 1).otherwise(0)).cast("int")).where("_n > 0")
    rows = rows.select("doc_id", "source", "n_tokens", "_number", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    draw = F.col("copy") * lit(blocks) + F.col("_number")
    ended = pick({s: F.array(*(F.lit(x) for x in e)) for s, e in ends.items()})
    return rows.withColumn("_d", draw).select("doc_id", "source", "n_tokens", F.least(F.size(F.filter(ended, lambda x: x <= F.col("_d"))), F.lit(shards - 1)).alias("shard"), "copy")


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 17, block: int | None = None, total: int | None = None, ranks: str = RANKS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, n_tokens, shard, copy): the documents drawn, one row per copy, and the shard that each goes to.

    No document comes more than its source's ``max_repeats`` times. Each shard holds its whole quota of every source, so
    any shard alone has the mix too. Documents of other sources, of none, and without tokens aren't drawn; repeated rows
    of a document count once; an empty table on either side gives no rows.
    """
    counts, _, _, quota, blocks, block = _setup(documents, targets, block, total, ranks)
    return _drawn(counts, quota, blocks, block, seed, shards)


def shares(documents: DataFrame, targets: DataFrame, seed: int = 17, block: int | None = None, total: int | None = None, ranks: str = RANKS, shards: int = SHARDS) -> DataFrame:
    """(source, target_share, actual_share, tokens_available, tokens_drawn, max_repeats, most_repeats, blocks): one row per
    target; sources without documents have nothing drawn. Shares are of all tokens drawn, null if none are."""
    counts, wanted, totals, quota, blocks, block = _setup(documents, targets, block, total, ranks)
    drawn = _drawn(counts, quota, blocks, block, seed, shards).groupBy("source").agg(F.sum("n_tokens").alias("tokens_drawn"), (F.max("copy") + 1).alias("most_repeats"))
    spark = documents.sparkSession
    base = spark.createDataFrame([(s, w, int(totals.get(s, 0)), m, int(quota.get(s, 0))) for s, (w, m) in sorted(wanted.items())], "source string, target_share double, tokens_available long, max_repeats int, blocks long")
    all_ = W.partitionBy()
    joined = base.join(drawn, "source", "left")
    return joined.select("source", "target_share", F.try_divide(F.coalesce("tokens_drawn", F.lit(0)), F.sum("tokens_drawn").over(all_)).alias("actual_share"), "tokens_available", F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "blocks")


def quotas(documents: DataFrame, targets: DataFrame, shards: int = SHARDS, block: int | None = None, total: int | None = None, ranks: str = RANKS) -> DataFrame:
    """(shard, source, blocks): the blocks of every source in every shard."""
    *_, quota, _, _ = _setup(documents, targets, block, total, ranks)
    rows = [(i, s, n) for i, got in enumerate(shard_quotas(quota, shards)) for s, n in sorted(got.items())]
    return documents.sparkSession.createDataFrame(rows, "shard int, source string, blocks long")
