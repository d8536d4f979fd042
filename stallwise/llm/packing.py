"""Best-fit packing of texts into sequences under conflict constraints.

Texts become chunks of at most ``capacity`` words; a chunk goes to the open bin with the smallest residual
that takes it, among the bins that hold neither its source nor its duplicate cluster. Bins are kept ordered by
residual and carry one bitmap of the sources and clusters inside; if the tightest bin is not compatible, the
search goes on to its successor, and a new bin opens only if none is. Chunks are placed by falling length.

Spark deals narrow rows (no texts) into shards of about ``shard_rows`` chunks by a hash of a row number, so a
hot source, cluster or repeated id spreads evenly and every shard is one bounded group. The row number is
part of a written table: a task that runs again on another executor packs the same chunks the same way.
Which chunks share a shard depends on how that table was written, so bins may differ between clusters.

Edge cases: null and empty texts are one chunk of no words, which conflicts with nothing and goes to the fullest
bin (a bin of its own only if there is no other); a null source is a source of its own; texts equal
up to white space and case form a cluster, unless a column gives the clusters (``near_dedup``'s class ids, say; a
null there falls back to the text); repeated rows are packed one by one, in different bins; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .base import SPACE, text_of, words_of

CAPACITY = 2048
SHARD_ROWS = 4096
_BIN_BITS = 32


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, by_source: bool = True) -> list[tuple[int, int]]:
    """(bin, offset) per item; the items must come by falling length."""
    labels: list[tuple] = []
    if by_source:
        labels += [("source", s) for s in dict.fromkeys(sources)]
    # a cluster with one item here can meet no conflict, and no words conflict with nothing
    sized = Counter(c for c, length in zip(clusters, lengths, strict=True) if length)
    labels += [("cluster", c) for c, n in sized.items() if n > 1]
    bit = {label: 1 << n for n, label in enumerate(labels)}
    order: list[tuple[int, int]] = []  # (residual, bin)
    held: list[int] = []
    placed = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        own = bit.get(("source", source), 0) | bit.get(("cluster", cluster), 0) if length else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and held[order[at][1]] & own:
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append(0)
        held[number] |= own
        placed.append((number, capacity - residual))
        insort(order, (residual - length, number))
    return placed


def chunks(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int, cluster_col: str | None = None
) -> DataFrame:
    """Rows (_id, _source, _cluster, chunk, start_word, n_words, _row), written."""
    text = text_of(text_col)
    copies = F.xxhash64(F.lower(F.regexp_replace(text, SPACE, " ")))
    given = F.col(cluster_col) if cluster_col else None
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.xxhash64(F.col(source_col).cast("string")), F.lit(0)).alias("_source"),
        (copies if given is None else F.when(given.isNull(), copies).otherwise(F.xxhash64(given))).alias("_cluster"),
        F.size(words_of(text)).cast("long").alias("_words"),
    )
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_words") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    rows = rows.select("*", F.posexplode(starts).alias("chunk", "start_word"))
    rows = rows.select(
        "_id",
        "_source",
        "_cluster",
        "chunk",
        "start_word",
        F.least(F.col("_words") - F.col("start_word"), F.lit(capacity)).alias("n_words"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return materialise(rows, "packing_chunks")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    by_source: bool = True,
    cluster_col: str | None = None,
) -> DataFrame:
    """One row per chunk: ``id_col``, chunk, start_word, n_words, bin_id, bin_offset (both in words)."""
    rows = chunks(docs, id_col, text_col, source_col, capacity, cluster_col)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "_row"], ascending=[False, True], kind="stable")
        placed = best_fit(
            group["n_words"].tolist(), group["_source"].tolist(), group["_cluster"].tolist(), capacity, by_source
        )
        bins = group["_shard"].astype("int64") * (1 << _BIN_BITS) + [number for number, _ in placed]
        return group[["_id", "chunk", "start_word", "n_words"]].assign(bin_id=bins, bin_offset=[o for _, o in placed])

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("_shard").applyInPandas(
        place, f"_id {kind}, chunk int, start_word long, n_words long, bin_id long, bin_offset long"
    )
    return out.withColumnRenamed("_id", id_col)
