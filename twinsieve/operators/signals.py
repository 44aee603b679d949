"""Verification of candidate pairs by independent signals: hash, identity, name, caption, size and time.

One row per pair that holds any signal, with a nullable score per signal. The ratio, which needs
Python, is computed for pairs only that the native conditions leave undecided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators.overlaps import likely
from twinsieve.operators.pairs import candidate_pairs, generic_values, meet, same_time, size_probes, text_candidates, without_generic
from twinsieve.shared import materialize

#: Signals from strongest to weakest, and their strength.
STRENGTH = {"hash": 4, "identity": 4, "hash_partial": 3, "size_time": 3, "name": 2, "caption": 1}
SIDES = ["idx", "content_hash", "hash_scope", "file_unique_id", "file_identify", "doc_id", "file_name", "name_norm", "caption_norm", "size", "duration"]
_EMPTY = {"content_hash": "", "hash_scope": "", "file_unique_id": "", "file_identify": "", "doc_id": 0, "file_name": "", "name_norm": "", "caption_norm": "", "size": 0, "duration": 0}
IDS = ["doc_id", "file_unique_id", "file_identify"]


def hash_signal(full: bool) -> Column:
    same = (F.col("a.content_hash") != "") & (F.col("a.content_hash") != "ERR") & (F.col("a.content_hash") == F.col("b.content_hash")) & (F.col("a.hash_scope") == F.col("b.hash_scope"))
    return same & ((F.col("a.hash_scope") == "full") if full else (F.col("a.hash_scope") != "full"))


def identity_signal(ids: list[str] = IDS) -> Column:
    """Whether any of ``ids`` is known and the same."""
    return reduce(Column.__or__, ((F.col(f"a.{c}") != _EMPTY[c]) & (F.col(f"a.{c}") == F.col(f"b.{c}")) for c in ids))


def size_tolerance(a: Column, b: Column, cfg: MatchConfig) -> Column:
    return F.greatest(F.lit(float(cfg.size_tol_min)), F.rint(F.greatest(a, b) * cfg.size_tol_pct / 100))


def size_time_signal(a_size: Column, b_size: Column, a_time: Column, b_time: Column, cfg: MatchConfig) -> tuple[Column, Column]:
    """Whether sizes and durations agree, and the score."""
    tol = size_tolerance(a_size, b_size, cfg)
    apart, late = F.abs(a_size - b_size), F.abs(a_time - b_time)
    ok = (F.least(a_size, b_size) >= cfg.min_size_for_match) & (apart <= tol) & (F.least(a_time, b_time) >= cfg.min_duration_s) & (late <= cfg.dur_tol_s)
    if cfg.size_time_require_one_exact:
        ok = ok & ((apart == 0) | (late == 0))
    score = 0.6 * (1 - F.least(F.lit(1.0), apart / F.greatest(tol, F.lit(1.0)))) + 0.4 * (1 - F.least(F.lit(1.0), late / F.lit(max(cfg.dur_tol_s, 1e-9))))
    return ok, F.bround(score, 4)


def _contains(a: Column, b: Column) -> Column:
    """Whether the shorter text's tokens, two or more, all stand in the longer one, which has others too."""
    x, y = F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))
    short = F.when(F.length(a) <= F.length(b), F.size(x)).otherwise(F.size(y))
    lengths = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (short >= 2) & (F.size(x) != F.size(y)) & (F.size(F.array_intersect(x, y)) == short) & (lengths >= 0.5)


def _with_ratio(pairs: DataFrame, a: str, b: str, undecided: Column) -> DataFrame:
    """``pairs`` with ``ratio``: the UDF sees the undecided rows alone."""
    marked = pairs.withColumn("_go", F.coalesce(undecided, F.lit(False)))
    asked = marked.where("_go").withColumn("ratio", X.sequence_ratio(F.col(a), F.col(b)))
    rest = marked.where("not _go").withColumn("ratio", F.lit(None).cast("double"))
    return asked.unionByName(rest).drop("_go")


def _signature(name: Column, cfg: MatchConfig) -> Column:
    """The episode that tells names apart; ``name`` is the file's own name under the strict guard, else the normalized one."""
    return X.episode_signature(X.normalize(name, unicode=cfg.strict_episode_guard))


def _no_clash(ea: Column, eb: Column) -> Column:
    return ~((ea != "") & (eb != "") & (ea != eb))


def _least_jaccard(cfg: MatchConfig) -> float:
    """The least Jaccard index with which a ratio of names can matter."""
    return min(cfg.th_name_jaccard, max(0.45, cfg.th_name_jaccard - 0.15), min(0.98, cfg.th_name_jaccard + 0.25))


def _overlap(an: Column, bn: Column) -> list[Column]:
    return [X.jaccard(an, bn).alias("nj"), _contains(an, bn).alias("inside")]


def _caption_overlap(ac: Column, bc: Column) -> list[Column]:
    return [X.jaccard(ac, bc).alias("cj"), X.shared_tokens(ac, bc).alias("cs"), F.least(F.size(X.tokens(ac)), F.size(X.tokens(bc))).alias("ct")]


def _score_names(p: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``p`` (an, bn, name_open, nj, inside, ...) with ``name``; a ratio can only matter if the token sets agree enough."""
    short = F.least(F.length("an"), F.length("bn")) < 3
    bound = 2 * F.least(F.length("an"), F.length("bn")) / F.greatest(F.lit(1), F.length("an") + F.length("bn"))
    ask = F.col("name_open") & (F.col("an") != F.col("bn")) & ~short & (F.col("inside") | ((F.col("nj") >= _least_jaccard(cfg)) & (bound >= min(0.60, cfg.th_name_ratio))))
    p = _with_ratio(p, "an", "bn", ask)
    r, j = F.col("ratio"), F.col("nj")
    good = ((r >= cfg.th_name_ratio) & (j >= cfg.th_name_jaccard)) | F.col("inside")
    good = good | ((r >= cfg.th_name_ratio + 0.06) & (j >= max(0.45, cfg.th_name_jaccard - 0.15))) | ((j >= min(0.98, cfg.th_name_jaccard + 0.25)) & (r >= 0.60))
    mixed = F.bround(0.6 * r + 0.4 * j, 4)
    name = F.when(F.col("name_open") & (F.col("an") == F.col("bn")), 1.0).when(r.isNotNull() & good, F.when(F.col("inside") & (r >= 0.95), F.greatest(mixed, F.lit(0.99))).otherwise(mixed))
    return p.withColumn("name", name).drop("ratio")


def _score_captions(p: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``p`` (ac, bc, cap_open, cj, cs, ct, ...) with ``caption``."""
    few = F.least(F.length("ac"), F.length("bc")) < 25
    th_r, th_j = F.when(few, F.greatest(F.lit(0.90), F.lit(cfg.th_cap_ratio))).otherwise(cfg.th_cap_ratio), F.when(few, F.greatest(F.lit(0.75), F.lit(cfg.th_cap_jaccard))).otherwise(cfg.th_cap_jaccard)
    enough = (F.col("cs") >= 6) | (F.col("cs") / F.greatest(F.lit(1), F.col("ct")) >= 0.6)
    bound = 2 * F.least(F.length("ac"), F.length("bc")) / F.greatest(F.lit(1), F.length("ac") + F.length("bc"))
    p = _with_ratio(p, "ac", "bc", F.col("cap_open") & (F.col("ac") != F.col("bc")) & enough & (F.col("cj") >= th_j) & (bound >= th_r))
    caption = F.when(F.col("cap_open") & (F.col("ac") == F.col("bc")), 1.0).when(F.col("ratio") >= th_r, F.bround(0.6 * F.col("ratio") + 0.4 * F.col("cj"), 4))
    return p.withColumn("caption", caption).drop("ratio")


def verify_pairs(pairs: DataFrame, files: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(channel_id, i, j, hash, identity, hash_partial, size_time, name, caption, size_eq, dur_eq): verified edges and their scores.

    ``files`` has channel_id, idx and any of the columns of SIDES; missing ones are unknown.
    """
    for c, empty in _EMPTY.items():
        files = files.withColumn(c, F.coalesce(F.col(c), F.lit(empty)) if c in files.columns else F.lit(empty))
    for c, flag in (("name_norm", "name_generic"), ("caption_norm", "caption_generic")):
        generic = generic_values(files, c).select("channel_id", F.col("value").alias(c), F.lit(True).alias(flag))
        files = files.join(generic, ["channel_id", c], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    side = F.struct(*SIDES, "name_generic", "caption_generic")
    a = files.select("channel_id", F.col("idx").alias("i"), side.alias("a"))
    b = files.select("channel_id", F.col("idx").alias("j"), side.alias("b"))
    p = pairs.select("channel_id", "i", "j").join(a, ["channel_id", "i"]).join(b, ["channel_id", "j"])

    st, st_score = size_time_signal(F.col("a.size"), F.col("b.size"), F.col("a.duration"), F.col("b.duration"), cfg)
    an, bn, ac, bc = (F.col(x) for x in ("a.name_norm", "b.name_norm", "a.caption_norm", "b.caption_norm"))
    guard = (F.col("a.file_name"), F.col("b.file_name")) if cfg.strict_episode_guard else (an, bn)
    ea, eb = (_signature(x, cfg) for x in guard)
    p = p.select(
        "channel_id", "i", "j", an.alias("an"), bn.alias("bn"), ac.alias("ac"), bc.alias("bc"),
        F.when(hash_signal(True), 1.0).alias("hash"), F.when(identity_signal(), 1.0).alias("identity"), F.when(hash_signal(False), 1.0).alias("hash_partial"),
        F.when(st, st_score).alias("size_time"),
        (st & (F.col("a.size") == F.col("b.size"))).alias("size_eq"), (st & (F.col("a.duration") == F.col("b.duration"))).alias("dur_eq"),
        ((an != "") & (bn != "") & ~F.col("a.name_generic") & ~F.col("b.name_generic") & _no_clash(ea, eb)).alias("name_open"),
        ((F.length(ac) >= cfg.min_caption_len) & (F.length(bc) >= cfg.min_caption_len) & ~F.col("a.caption_generic") & ~F.col("b.caption_generic")).alias("cap_open"),
        *_overlap(an, bn), *_caption_overlap(ac, bc),
    )
    p = _score_captions(_score_names(p, cfg), cfg)
    return p.where(F.coalesce(*STRENGTH).isNotNull()).select("channel_id", "i", "j", *STRENGTH, "size_eq", "dur_eq")


def _numbered(texts: DataFrame, tag: str) -> DataFrame:
    return materialize(texts.withColumn("id", F.monotonically_increasing_id()), tag)


def _text_pairs(texts: DataFrame, column: str, least: float, contained: bool) -> DataFrame:
    """(channel_id, i, j): pairs of ``texts`` (channel_id, id, ...) that may be alike, in both orders, as the ratio depends on it."""
    c = F.col(column)
    held = texts.select("channel_id", F.col("id").alias("idx"), F.size(X.token_set(c)).alias("n"), F.transform(F.array_distinct(X.tokens(c)), lambda t: F.xxhash64(t)).alias("t"))
    one = materialize(likely(held, least, contained), "likely")
    return one.unionByName(one.select("channel_id", F.col("j").alias("i"), F.col("i").alias("j")))


def _alike_names(names: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(a, b, name): ids of different ``names`` (channel_id, name_norm, episode, id) that are evidence of identity."""
    pairs = _text_pairs(names, "name_norm", _least_jaccard(cfg), True)
    if cfg.strict_episode_guard:  # names that are equal but for their episodes, without tokens too
        pairs = pairs.unionByName(_ordered(names, "name_norm")).distinct()
    for e, x, t in (("i", "an", "ea"), ("j", "bn", "eb")):
        pairs = pairs.join(names.select(F.col("id").alias(e), F.col("name_norm").alias(x), F.col("episode").alias(t)), e)
    p = pairs.select("i", "j", "an", "bn", _no_clash(F.col("ea"), F.col("eb")).alias("name_open"), *_overlap(F.col("an"), F.col("bn")))
    return materialize(_score_names(p, cfg).where("name is not null").select(F.col("i").alias("a"), F.col("j").alias("b"), "name"), "alike")


def _ordered(texts: DataFrame, column: str) -> DataFrame:
    """(channel_id, i, j): pairs of different rows of equal ``column``, in both orders."""
    left, right = (texts.select("channel_id", column, F.col("id").alias(e)) for e in ("i", "j"))
    return left.join(right, ["channel_id", column]).where("i != j").select("channel_id", "i", "j")


def _alike_captions(captions: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(a, b, caption): ids of different ``captions`` (channel_id, caption_norm, id) that are evidence of identity."""
    pairs = _text_pairs(captions, "caption_norm", cfg.th_cap_jaccard, False)
    for e, x in (("i", "ac"), ("j", "bc")):
        pairs = pairs.join(captions.select(F.col("id").alias(e), F.col("caption_norm").alias(x)), e)
    p = pairs.select("i", "j", "ac", "bc", F.lit(True).alias("cap_open"), *_caption_overlap(F.col("ac"), F.col("bc")))
    return materialize(_score_captions(p, cfg).where("caption is not null").select(F.col("i").alias("a"), F.col("j").alias("b"), "caption"), "alike")


def verified_candidates(files: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """What ``verify_pairs`` finds among ``candidate_pairs``; without caps the pairs that hold no signal are not made.

    Signals are keys that two rows share: duration, size, hash, ids, name or caption; different texts that are alike are found
    among distinct ones. One join on all of them gives each pair from its first key and leaves out what is no candidate.
    """
    if not (cfg.exhaustive_pairs and cfg.size_time_require_one_exact and cfg.min_duration_s > 0):
        return verify_pairs(candidate_pairs(files, cfg), files, cfg)
    if "content_hash" in files.columns and "hash_scope" not in files.columns:
        files = files.withColumn("hash_scope", F.lit(""))
    have = [c for c in SIDES if c in files.columns]
    files = files.select("channel_id", *(F.coalesce(F.col(c), F.lit(_EMPTY[c])).alias(c) if c in _EMPTY and c != "duration" else F.col(c) for c in have))
    named = ["channel_id", "name_norm"]
    if cfg.strict_episode_guard:
        named.append("episode")
        files = files.withColumn("episode", _signature(F.col("file_name"), cfg) if "file_name" in have else F.lit(""))
    files = materialize(files, "files")
    names = without_generic(files, "name_norm").where("name_norm != ''").select(*named).distinct()
    names = _numbered(names if cfg.strict_episode_guard else names.withColumn("episode", _signature(F.col("name_norm"), cfg)), "names")
    captions = _numbered(without_generic(files, "caption_norm").where(F.length("caption_norm") >= cfg.min_caption_len).select("channel_id", "caption_norm").distinct(), "captions")
    alike_names, alike_captions = _alike_names(names, cfg), _alike_captions(captions, cfg)

    ids = [c for c in IDS if c in have]
    hashes = ["content_hash", "hash_scope"] if "content_hash" in have else []
    rows = files.join(names.select(*named, F.col("id").alias("nm")), named, "left").join(captions.select("channel_id", "caption_norm", F.col("id").alias("cp")), ["channel_id", "caption_norm"], "left")
    can = (F.col("size") >= max(1, cfg.min_size_for_match)) & (F.coalesce("duration", F.lit(0)) >= cfg.min_duration_s)
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0))).select("channel_id", "idx", "size", "duration", can.alias("can"), "nm", "cp", F.struct("nm", "cp", *hashes, *ids).alias("x"))
    rows = materialize(rows, "rows")
    row = ["idx", "size", "duration", "can", "x"]

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        left = left.select(*on, *(F.col(c).alias(n) for c, n in zip(row, ("ia", "sa", "ad", "ca", "a"), strict=True)), *(["far"] if "far" in left.columns else []))
        return meet(left, right.select(*on, *(F.col(c).alias(n) for c, n in zip(row, ("ib", "sb", "bd", "cb", "b"), strict=True))), on)

    sa, sb, ad, bd = (F.col(c) for c in ("sa", "sb", "ad", "bd"))
    st, st_score = size_time_signal(sa, sb, ad, bd, cfg)
    # pairs that agree in size and time: of equal durations, then of equal sizes
    near = F.abs(sa - sb) <= size_tolerance(sa, sb, cfg)
    late = F.abs(ad - bd) <= cfg.dur_tol_s
    told = rows.where("can")
    parts = [pairs(told.select("channel_id", *row, F.col("duration").alias("d")), told.select("channel_id", *row, F.col("duration").alias("d")), ["channel_id", "d"]).where("ia < ib").where(near).drop("d")]
    parts.append(pairs(told.select("channel_id", *row, F.col("size").alias("s")), told.select("channel_id", *row, F.col("size").alias("s")), ["channel_id", "s"]).where("ia < ib and ad != bd").where(late).drop("s"))

    # a row's key of each other kind, and whether the kind holds for a pair
    kinds = [(F.when(~F.col("x.content_hash").isin("", "ERR"), F.xxhash64("x.content_hash", "x.hash_scope")), hash_signal(True) | hash_signal(False))] if hashes else []
    kinds += [(F.when(F.col(f"x.{c}") != _EMPTY[c], F.xxhash64(f"x.{c}")), identity_signal([c])) for c in ids]
    name_kind, caption_kind = len(kinds), len(kinds) + 1
    keys = [k for k, _ in kinds] + [F.col("nm"), F.col("cp")]
    keyed = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in enumerate(keys))), lambda k: k["key"].isNotNull())).alias("k")
    sized = rows.where("size > 0")
    right = sized.select("channel_id", keyed, *row).select("channel_id", "k.kind", "k.key", *row)
    left, known = right, []
    for t, n, c in ((alike_names, name_kind, "nm"), (alike_captions, caption_kind, "cp")):
        if not t.isEmpty():
            known.append(n)
            both = t.select("a", "b").union(t.select("b", "a")).distinct()
            left = left.unionByName(sized.join(both, F.col(c) == F.col("a")).select("channel_id", F.lit(n).alias("kind"), F.col("b").alias("key"), *row))
    # they meet within equal durations and near sizes alone, as only these are candidates
    timed = [d.where(F.col("duration") >= cfg.min_duration_s).withColumn("d", F.col("duration")) for d in (left, right)]
    timed = pairs(*timed, ["channel_id", "kind", "key", "d"]).where("ia < ib").where(~(F.col("ca") & F.col("cb") & near)).drop("d")
    far, probes, own = size_probes(F.col("size"), cfg)
    banded = [d.withColumn("at", at).withColumn("p", F.col("at.p")).withColumn("at", F.col("at.b")) for d, at in ((left.withColumn("far", far), F.explode(probes)), (right, own))]
    banded = pairs(*banded, ["channel_id", "kind", "key", "p", "at"]).where("sb <= far and (sa < sb or (sa = sb and ia < ib))").where(~same_time(ad, bd, cfg)).where(~(F.col("ca") & F.col("cb") & (sa == sb) & late)).drop("p", "at", "far")
    found = timed.unionByName(banded)
    if kinds:
        first = F.lit(None).cast("int")
        for n, (_, holds) in reversed(list(enumerate(kinds))):
            first = F.when(holds, n).otherwise(first)
        found = found.where(F.coalesce(first == F.col("kind"), F.col("kind") >= name_kind))
    p = reduce(DataFrame.unionByName, [q.withColumn("kind", F.lit(-1)) for q in parts], found.drop("key"))
    texts = text_candidates(files, cfg).select("channel_id", F.col("i").alias("ia"), F.col("j").alias("ib"))
    for e, names_of in (("ia", ("sa", "ad", "ca", "a")), ("ib", ("sb", "bd", "cb", "b"))):
        texts = texts.join(rows.select("channel_id", F.col("idx").alias(e), *(F.col(c).alias(n) for c, n in zip(row[1:], names_of, strict=True))), ["channel_id", e])
    p = p.unionByName(texts.withColumn("kind", F.lit(-1)))

    none = F.lit(None).cast("double")
    ordered = F.col("ia") < F.col("ib")
    p = p.select(
        "channel_id", F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j"), "kind",
        *(F.when(ordered, F.col(f"{s}.{c}")).otherwise(F.col(f"{o}.{c}")).alias(f"{s}_{c}") for s, o in ("ab", "ba") for c in ("nm", "cp")),
        (F.when(hash_signal(True), 1.0) if hashes else none).alias("hash"), (F.when(identity_signal(ids), 1.0) if ids else none).alias("identity"), (F.when(hash_signal(False), 1.0) if hashes else none).alias("hash_partial"),
        F.when(st, st_score).alias("size_time"), F.coalesce(st & (sa == sb), F.lit(False)).alias("size_eq"), F.coalesce(st & (ad == bd), F.lit(False)).alias("dur_eq"),
    )
    for t, n, c, score in ((alike_names, name_kind, "nm", "name"), (alike_captions, caption_kind, "cp", "caption")):
        if n in known:
            p = p.join(t.select(F.col("a").alias(f"a_{c}"), F.col("b").alias(f"b_{c}"), F.col(score).alias("other")), [f"a_{c}", f"b_{c}"], "left")
        p = p.withColumn(score, F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1.0).otherwise(F.col("other") if n in known else none)).drop("other")
    # a caption's pair that its names find too comes from these
    p = p.where(F.coalesce(*STRENGTH).isNotNull() & ((F.col("kind") != caption_kind) | F.col("name").isNull()))
    return p.select("channel_id", "i", "j", *STRENGTH, "size_eq", "dur_eq")
