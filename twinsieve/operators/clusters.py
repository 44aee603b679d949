"""Clusters of verified edges: connected components, or cliques, and what is known of each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.operators.components import connected_components
from twinsieve.operators.pairs import candidate_pairs, in_window
from twinsieve.operators.signals import STRENGTH, verify_pairs
from twinsieve.shared import materialize

ORDER = ["hash", "identity", "hash_partial", "name", "caption", "size_time"]


def loose_clusters(edges: DataFrame) -> DataFrame:
    """(channel_id, idx, cluster): members of components; ``idx`` must be unique over all channels."""
    members = connected_components(edges, "i", "j").select(F.col("node").alias("idx"), F.col("component").alias("cluster"))
    channels = edges.select("channel_id", F.col("i").alias("idx")).unionByName(edges.select("channel_id", F.col("j").alias("idx"))).distinct()
    return members.join(channels, "idx").select("channel_id", "idx", "cluster")


def strict_clusters(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(channel_id, idx, cluster): each component greedily covered by cliques, vertices by falling degree; single ones are left over.

    Greedy covering is sequential inside a component, so one component is one task.
    """

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for i, j in zip(pdf["i"], pdf["j"], strict=True):
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
        groups: list[list[int]] = []
        for v in sorted(near, key=lambda v: (-len(near[v]), v)):
            fit = next((g for g in groups if all(u in near[v] for u in g)), None)
            groups.append([v]) if fit is None else fit.append(v)
        rows = [(pdf["channel_id"].iloc[0], v, min(g)) for g in groups if len(g) > 1 for v in g]
        return pd.DataFrame(rows, columns=["channel_id", "idx", "cluster"])

    by = edges.join(members.select("channel_id", F.col("idx").alias("i"), "cluster"), ["channel_id", "i"])
    kind = edges.schema["channel_id"].dataType.simpleString()
    return by.select("channel_id", "i", "j", "cluster").groupBy("cluster").applyInPandas(cover, f"channel_id {kind}, idx long, cluster long")


def describe_clusters(edges: DataFrame, members: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per cluster: count, links, density, chain, signals, strength, flags, reason and score, from its inner edges.

    Members stay rows of their own table; ``with_ids`` adds the array of a cluster's ids, for clusters that fit in a row.
    An edge with a ``weight`` stands for so many links.
    """
    i = members.select("channel_id", F.col("idx").alias("i"), "cluster")
    j = members.select("channel_id", F.col("idx").alias("j"), F.col("cluster").alias("cluster_j"))
    inner = edges.join(i, ["channel_id", "i"]).join(j, ["channel_id", "j"]).where("cluster = cluster_j")
    keys = ["channel_id", "cluster"]
    links = F.sum("weight").cast("long") if "weight" in edges.columns else F.count("*")
    scores = inner.groupBy(*keys).agg(links.alias("links"), F.bool_or("size_eq").alias("any_size"), F.bool_or("dur_eq").alias("any_dur"), *(F.max(s).alias(s) for s in STRENGTH))
    rows = members.select("channel_id", "cluster", "idx").distinct()
    some = [F.count("*").alias("count"), F.min("idx").alias("first_id")] + [F.sort_array(F.collect_list("idx")).alias("ids")] * with_ids
    c = rows.groupBy(*keys).agg(*some).join(scores, keys)
    pairs = F.greatest(F.lit(1), F.floor(F.col("count") * (F.col("count") - 1) / 2))
    has = {s: F.col(s).isNotNull() for s in STRENGTH}
    strength = F.greatest(*(F.when(has[s], F.lit(n)).otherwise(0) for s, n in STRENGTH.items()))
    signals = F.filter(F.array(*(F.when(has[s], F.lit(s)) for s in ORDER)), lambda x: x.isNotNull())
    only = F.concat_ws(",", signals) == "size_time"
    c = c.withColumn("signals", signals).withColumn("strength", strength).withColumn("exact", has["hash"] | has["identity"])
    c = c.withColumn("chain", (F.col("count") >= 3) & (F.col("links") < pairs)).withColumn("density", F.bround(F.col("links") / pairs, 3))
    both = F.col("any_size") & F.col("any_dur")
    c = c.withColumn("size_time_exact", both).withColumn("approx", only & ~both).withColumn("review", only & (F.col("count") > 50))
    variant = F.when(both, "size_time:exact").when(F.col("any_size"), "size_time:size").when(F.col("any_dur"), "size_time:time").otherwise("size_time:near")
    reason = F.concat_ws(" + ", F.transform("signals", lambda s: F.when(s == "size_time", variant).otherwise(s)))
    c = c.withColumn("reason", F.when(F.col("chain"), F.concat(reason, F.lit(" (chain)"))).otherwise(reason))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in STRENGTH), F.lit(0.0))
    return c.select(*keys, *["ids"] * with_ids, "count", "links", "density", "chain", "signals", "strength", "exact", has["size_time"].alias("sizetime"), "size_time_exact", "approx", "review", "reason", "first_id", F.bround(total, 4).alias("score"))


def leftovers(loose: DataFrame, strict: DataFrame) -> DataFrame:
    """(channel_id, strict_leftovers): members of components that the cliques leave single, where any."""
    gone = loose.join(strict.select("channel_id", "idx"), ["channel_id", "idx"], "left_anti")
    return gone.groupBy("channel_id").agg(F.count("*").alias("strict_leftovers"))


def find_clusters(files: DataFrame, cfg: MatchConfig = MatchConfig(), pairs: DataFrame | None = None, fresh: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of ``files`` (channel_id, idx and any of the columns that ``verify_pairs`` reads), by candidates, verification and grouping.

    ``idx`` is unique over all channels. ``pairs`` replaces the candidates; ``fresh`` (channel_id, idx) limits them to pairs with an end
    in it and the result to clusters with a member in it. Clusters are ranked by ``ranked``; what caps left out is in ``pair_drops``.
    """
    for c in ("name_norm", "caption_norm"):
        files = files if c in files.columns else files.withColumn(c, F.lit(""))
    for c in ("size", "duration"):
        files = files if c in files.columns else files.withColumn(c, F.lit(0).cast("long"))
    pairs = candidate_pairs(files, cfg) if pairs is None else pairs
    if fresh is not None:
        pairs = in_window(pairs, fresh)
    edges = materialize(verify_pairs(materialize(pairs, "pairs"), files, cfg), "edges")
    members = loose_clusters(edges)
    if cfg.cluster_mode == "strict":
        members = strict_clusters(edges, members)
    if fresh is not None:
        seen = members.join(fresh.select("channel_id", "idx").distinct(), ["channel_id", "idx"], "left_semi")
        members = members.join(seen.select("channel_id", "cluster").distinct(), ["channel_id", "cluster"], "left_semi")
    members = materialize(members, "members")
    return describe_clusters(edges, members), members


def ranked(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("strength"), F.desc("count"), "first_id")
