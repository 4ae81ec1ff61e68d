"""Stacks of sequences, their column profiles and the conserved segments in them.

A stack is a long table: key columns, ``ord`` and ``seq``. Profiles and scans stay long, one row for
each column, so a deep stack never becomes an array in a row; a profile is as long as its sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.functions import expr as E
from spanwright.operators.ranking import least_per_key, numbered
from spanwright.session import Tables


SIDES = ("left", "right")


def both_sides(units: DataFrame, keys: list[str]) -> DataFrame:
    """Each unit with a left and a right side, whether it has sequences there or not; ``keys`` are without side."""
    return units.select(*keys).distinct().withColumn("side", F.explode(F.array(*map(F.lit, SIDES))))


def anchor_consistency(stacks: DataFrame, keys: list[str], n: int, side_aware: bool = True) -> DataFrame:
    """How far the inner ends of a unit's windows agree: empty, lonely, matching or mismatching, and how many are short.

    ``keys`` has ``side``; a unit with windows on one side only is empty on the other.
    """
    df = stacks.withColumn("anchor", E.anchor("seq", "side", n, side_aware))
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("n_variants"), F.count_if(F.length("seq") < n).alias("n_short"))
    per = both_sides(per, [k for k in keys if k != "side"]).join(per, keys, "left")
    per = per.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_variants", "n_short")})
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("n") == 1, "lonely").when(F.col("n_variants") == 1, "multi_matching").otherwise("multi_mismatching")
    return per.withColumn("verdict", verdict)


def anchor_variants(stacks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The variants of inner ends, with how many windows have each."""
    return stacks.withColumn("anchor", E.anchor("seq", "side", n)).groupBy(*keys, "anchor").agg(F.count("*").alias("n"))


def anchor_members(stacks: DataFrame, keys: list[str], n: int, id: str = "mge_id") -> DataFrame:
    """A row for each window: its id, its variant, and whether and how far it is shorter than ``n``.

    Ids of a variant stay rows, as one variant can have very many.
    """
    short = F.length("seq") < n
    return stacks.select(*keys, id, E.anchor("seq", "side", n).alias("anchor"), short.alias("is_short"), F.when(short, F.length("seq")).cast("bigint").alias("short_length"))


def anchor_tally(verdicts: DataFrame, kind: str) -> DataFrame:
    """Units by verdict, for each type and in all (TOTAL)."""
    names = ("lonely", "multi_matching", "multi_mismatching", "empty")
    return verdicts.rollup(kind).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in names)).withColumn(kind, F.coalesce(F.col(kind), F.lit("TOTAL")))


def pool_stacks(flanks: DataFrame, level: str) -> DataFrame:
    """Windows of duplicate groups, ordered within their group or within all groups of their cluster; a cluster of any size is numbered in ranges."""
    df = flanks.where(F.col("singleton") == "no")
    unit = ["rec_type", "cluster_number", "side"] + (["group_dir"] if level == "group" else [])
    kept = Tables(flanks.sparkSession)
    df = kept.keep(df.select(*unit, "mge_id", "seq", *([] if level == "group" else ["group_dir"])))
    return numbered(df, unit, ["group_dir", "mge_id"], "ord", kept)


def column_profile(stacks: DataFrame, keys: list[str], trim: int = 0, reverse: bool = False) -> DataFrame:
    """``col, n, tot, ident, base``: each column's most frequent character and its share.

    Sequences no longer than ``trim`` are left out, shorter ones leave the columns behind their end.
    Of equally frequent characters the one met first in stack order counts. Aggregated by column and
    character before anything is compared, so rows that move are bounded by the alphabet.
    """
    seq = F.reverse("seq") if reverse else F.col("seq")
    df = stacks.where(F.length("seq") > trim).select(*keys, "ord", F.posexplode(F.split(F.substr(seq, F.lit(trim + 1)), "")).alias("col", "base"))
    return majority(df.where(F.col("base") != "").groupBy(*keys, "col", "base").agg(F.count("*").alias("n"), F.min("ord").alias("first")), keys)


def majority(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A profile from ``col, base, n, first``: how many sequences have a character in a column, and the first of these."""
    per = counts.groupBy(*keys, "col").agg(F.sum("n").alias("tot"), F.max(F.struct("n", (-F.col("first")).alias("early"), "base")).alias("x"))
    return per.select(*keys, F.col("col").cast("bigint").alias("col"), F.col("x.n").alias("n"), F.col("tot"), (F.col("x.n") / F.col("tot")).alias("ident"), F.col("x.base").alias("base"))


def consensus_text(profile: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``n_cols, full``: the majority characters of all columns in order; and further aggregates."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "base")))
    return profile.groupBy(*keys).agg(F.count("*").alias("n_cols"), F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("full"), *more)


def _cut(df: DataFrame, keys: list[str], reason: Column, units: DataFrame | None) -> DataFrame:
    length = F.coalesce("cut", "n_cols")
    out = df.select(*keys, length.cast("bigint").alias("length"), reason.alias("reason"), F.left("full", length.cast("int")).alias("text"))
    if units is None:
        return out
    fill = {"length": F.coalesce("length", F.lit(0).cast("bigint")), "reason": F.coalesce("reason", F.lit("empty")), "text": F.coalesce("text", F.lit(""))}
    return units.select(*keys).join(out, keys, "left").withColumns(fill)


def cutoff_run(profile: DataFrame, keys: list[str], units: DataFrame | None = None) -> DataFrame:
    """Cut before the first run of low columns: ``length, reason, text`` per unit.

    ``profile`` has ``threshold`` and ``run``, equal within a unit. A column is low at or below the
    threshold. The reason is pos1_low whenever the first column is low, even if nothing was cut; it is
    empty for ``units`` (if given) of which the profile has no column. The profile is read once.
    """
    low = F.col("ident") <= F.col("threshold")
    w = W.partitionBy(*keys).orderBy("col")
    # Columns since the last one that isn't low, counted along the unit
    high = F.coalesce(F.max(F.when(~low, F.col("col"))).over(w), F.lit(-1))
    rows = profile.withColumn("nth", F.when(low, F.col("col") - high))
    cut = F.min(F.when(F.col("nth") >= F.col("run"), F.col("col") - F.col("run") + 1)).alias("cut")
    df = consensus_text(rows, keys, cut, F.min(F.when(F.col("nth").isNotNull(), F.col("col"))).alias("first_low"))
    reason = F.when(F.col("first_low") == 0, "pos1_low").when(F.col("cut").isNotNull(), "cutoff").otherwise("maxed_out")
    return _cut(df, keys, reason, units)


def cutoff_single(profile: DataFrame, keys: list[str], units: DataFrame | None = None) -> DataFrame:
    """Cut before the first low column: ``length, reason, text`` per unit; empty as in ``cutoff_run``."""
    df = consensus_text(profile, keys, F.min(F.when(F.col("ident") <= F.col("threshold"), F.col("col"))).alias("cut"))
    reason = F.when(F.col("cut").isNull(), "maxed_out").when(F.col("cut") == 0, "low_start").otherwise("normal")
    return _cut(df, keys, reason, units)


def segments(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of columns at or above the threshold: ``seg_no, start, length, text, is_open``.

    ``profile`` has ``threshold`` and ``run``. Fewer than ``run`` low columns in a row stay inside a
    segment. A segment is closed if enough low columns follow; an open one runs to the last column.
    """
    w = W.partitionBy(*keys).orderBy("col")
    whole = W.partitionBy(*keys)
    is_high = F.col("ident") >= F.col("threshold")
    before = F.max(F.when(is_high, F.col("col"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = profile.withColumns({"last_col": F.max("col").over(whole), "fresh": F.when(is_high & (before.isNull() | (F.col("col") - before - 1 >= F.col("run"))), 1).otherwise(0), "high": is_high})
    # Low columns carry the number of the segment before them, so that its text can be read on through gaps
    rows = rows.withColumn("seg_no", F.sum("fresh").over(w)).where(F.col("seg_no") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("col", "base")))
    segs = rows.groupBy(*keys, "seg_no").agg(F.min("col").alias("start"), F.max(F.when(F.col("high"), F.col("col"))).alias("end"), F.first("run").alias("run"), F.first("last_col").alias("last_col"), F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("full"))
    is_open = F.col("last_col") - F.col("end") < F.col("run")
    length = F.when(is_open, F.col("last_col")).otherwise(F.col("end")) - F.col("start") + 1
    return segs.select(*keys, F.col("seg_no").cast("bigint").alias("seg_no"), "start", length.cast("bigint").alias("length"), F.left("full", length.cast("int")).alias("text"), is_open.alias("is_open"))


def segments_side_aware(stacks: DataFrame, keys: list[str], threshold: float, run: int, trim: int = 0) -> DataFrame:
    """Segments of left stacks read forwards and of right stacks read backwards, in the stacks' own columns."""
    left = column_profile(stacks.where(F.col("side") == "left"), keys, trim)
    right_rows = stacks.where(F.col("side") == "right")
    right = column_profile(right_rows, keys, trim, reverse=True)
    return segments_of_sides(left, right, right_rows.groupBy(*keys).agg(F.max(F.length("seq")).alias("size")), keys, threshold, run, trim)


def segments_of_sides(left: DataFrame, right: DataFrame, sizes: DataFrame, keys: list[str], threshold: float, run: int, trim: int = 0) -> DataFrame:
    """Segments from profiles of both sides, the right one read backwards from the ends that ``sizes`` has (``size``)."""
    params = lambda p: p.withColumns({"threshold": F.lit(threshold), "run": F.lit(run)})
    left, right = segments(params(left), keys), segments(params(right), keys)
    right = right.join(sizes, keys).withColumn("start", F.col("size") - (F.col("start") + trim) - F.col("length")).withColumn("text", F.reverse("text")).drop("size")
    return left.withColumn("start", F.col("start") + trim).unionByName(right)


def boundary_segment(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The segment next to the element: the open one if its length fits, else the closest closed one that fits.

    ``keys`` has ``side``. Closest is the largest start on the left and the smallest on the right.
    """
    fits = segs.where(F.col("length").between(E.MIN_LEN, E.MAX_LEN))
    near = F.when(F.col("side") == "left", F.col("start")).otherwise(-F.col("start"))
    best = fits.groupBy(*keys).agg(F.max(F.struct(F.col("is_open").cast("int").alias("o"), near.alias("near"), "start", "length", "text", "is_open")).alias("x"))
    return best.select(*keys, F.col("x.start").alias("start"), F.col("x.length").alias("length"), F.col("x.text").alias("text"), F.col("x.is_open").alias("is_open"))


def unit_sizes(stacks: DataFrame, keys: list[str]) -> DataFrame:
    """``n_members``: sequences of the larger side of each unit."""
    return stacks.groupBy(*keys, "side").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("n_members"))


def universe_totals(stacks: DataFrame, group: list[str], cluster: list[str]) -> DataFrame:
    """Elements (the larger side of each group), clusters and groups."""
    sizes = unit_sizes(stacks, group)
    return sizes.agg(F.sum("n_members").alias("n_elements"), F.count_distinct(*cluster).alias("n_clusters"), F.count("*").alias("n_groups"))


def build_consensus(stacks: DataFrame, keys: list[str], source: str, overlap: int = 30, small: float = 0.9, large: float = 0.7, cutoff: int = 3, run: int = 2) -> DataFrame:
    """The consensus of each unit and side, by source: raw stacks are cut at a run, alignments give a boundary segment.

    The bases inside the element are stripped first; threshold and run length follow the unit's size.
    Stripped windows, sizes and segments are kept as tables, as several steps read them.
    """
    kept = Tables(stacks.sparkSession)
    df = stacks.withColumn("seq", E.strip_overlap("seq", "side", overlap)).where(F.length("seq") > 0)
    df = kept.keep(df.select(*keys, "side", "ord", "seq"))
    sized = unit_sizes(df, keys).withColumns({"threshold": E.dynamic_threshold(F.col("n_members"), small, large, cutoff), "run": E.dynamic_run_len(F.col("n_members"), run, cutoff)})
    sized = kept.keep(sized)
    both = [*keys, "side"]
    if source == "stacking":
        cut = cutoff_run(column_profile(df, both).join(sized, keys), both)
        out = cut.select(*both, F.when(F.col("length") > 0, F.lit(0).cast("bigint")).alias("consensus_start"), "length", "text", (F.col("reason") == "maxed_out").alias("maxed"))
    else:
        parts = []
        for side in ("left", "right"):
            own = df.where(F.col("side") == side)
            segs = segments(column_profile(own, both, reverse=side == "right").join(sized, keys), both)
            if side == "right":
                size = own.groupBy(*both).agg(F.max(F.length("seq")).alias("size"))
                segs = segs.join(size, both).withColumn("start", F.col("size") - F.col("start") - F.col("length")).withColumn("text", F.reverse("text")).drop("size")
            parts.append(segs)
        segs = kept.keep(parts[0].unionByName(parts[1]))
        chosen = boundary_segment(segs, both)
        open_ones = segs.groupBy(*both).agg(F.bool_or("is_open").alias("has_open"))
        units = df.select(*both).distinct().join(open_ones, both, "left").join(chosen, both, "left")
        maxed = F.coalesce("has_open", F.lit(False)) & ~F.coalesce("is_open", F.lit(False))
        out = units.select(*both, F.col("start").alias("consensus_start"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.coalesce("text", F.lit("")).alias("text"), maxed.alias("maxed"))
    return out.join(sized.select(*keys, "n_members", "threshold"), keys).withColumn("consensus_source", F.lit(source))


def _bucket_sums() -> dict[str, Column]:
    b = E.length_bucket(F.col("length"))
    return {"n_found": F.count("length"), "len_found": F.sum("length"), "n_in": F.count_if(b == "4_to_20"), "n_under": F.count_if(b == "under_4"), "n_over": F.count_if(b == "over_20")}


def strategy_units(stacks: DataFrame, keys: list[str], strategies: DataFrame, trim: int = 10) -> DataFrame:
    """Per strategy and unit whether it is maxed out, and counts and lengths of what was found.

    ``strategies`` is a short table: ``strategy, kind`` (A, B or S for segments) ``, small, large,
    run_small, run_large, cutoff``, and at most some dozen rows. The profile is computed once for all of
    them; it and the units are kept as tables.
    """
    both = [*keys, "side"]
    kept = Tables(stacks.sparkSession)
    profile = column_profile(stacks, both, trim)
    units = unit_sizes(stacks, keys).join(F.broadcast(strategies))  # a row for each strategy and unit
    few = F.col("n_members") <= F.col("cutoff")
    units = units.withColumns({"threshold": F.when(few, F.col("small")).otherwise(F.col("large")), "run": F.when(few, F.col("run_small")).otherwise(F.col("run_large"))})
    units = kept.keep(units)
    rated = kept.keep(profile.join(units.select(*keys, "strategy", "kind", "threshold", "run"), keys))
    named = ["strategy", *both]
    cut = cutoff_run(rated.where(F.col("kind") == "A"), named).unionByName(cutoff_single(rated.where(F.col("kind") == "B"), named))
    # In cut strategies a side without sequences counts as found, with length 0
    sides = units.where(F.col("kind") != "S").select("strategy", *keys, F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    cut = sides.join(cut, named, "left").withColumn("maxed", F.coalesce(F.col("reason") == "maxed_out", F.lit(False)))
    cut = cut.withColumn("length", F.when(~F.col("maxed"), F.coalesce("length", F.lit(0))))
    segs = segments(rated.where(F.col("kind") == "S"), named)
    segs = segs.select(*named, F.col("is_open").alias("maxed"), F.when(~F.col("is_open"), F.col("length")).alias("length"))
    per = cut.select(*named, "maxed", "length", F.lit(0).alias("seg")).unionByName(segs.select(*named, "maxed", "length", F.lit(1).alias("seg")))
    side = per.groupBy(*named).agg(F.bool_or("maxed").alias("maxed"), *(c.alias(n) for n, c in _bucket_sums().items()), F.count(F.when(F.col("seg") == 1, F.col("length"))).alias("n"))
    sums = [F.sum(n).alias(n) for n in ("n_found", "len_found", "n_in", "n_under", "n_over")]
    per = side.groupBy("strategy", *keys).agg(F.bool_or("maxed").alias("maxed"), *sums, F.max((F.col("n") > 1).cast("int")).alias("multi"))
    out = units.select("strategy", *keys, "n_members").join(per, ["strategy", *keys], "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("n_found", "len_found", "n_in", "n_under", "n_over", "multi")}
    return out.withColumns(zero | {"maxed": F.coalesce("maxed", F.lit(False))})


def multi_segment_units(units: DataFrame, keys: list[str], sample: int = 5, seed: int = 42) -> DataFrame:
    """Units with more than one segment on a side, by strategy, and which of them a seeded sample takes.

    ``in_sample`` marks the ``sample`` units of a strategy that come first in an order of digests.
    """
    some = units.where(F.col("multi") == 1)
    mark = F.md5(F.concat_ws("#", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))
    first = least_per_key(some.select("strategy", *keys), ["strategy"], [mark, *keys], sample)
    # ``sample`` rows of each strategy, of which there are some dozen at most
    return some.select("strategy", *keys).join(F.broadcast(first), ["strategy", *keys], "left").select("strategy", *keys, F.col("rank").isNotNull().alias("in_sample"))


def strategy_outcome(units: DataFrame, cluster: list[str]) -> DataFrame:
    """Per strategy: elements and units found and maxed out, clusters all maxed out and with any found."""
    per_cluster = units.groupBy("strategy", *cluster).agg(F.bool_and("maxed").alias("all_maxed"), F.bool_or(~F.col("maxed")).alias("any"), *(F.sum(x).alias(n) for n, x in {"f": F.when(~F.col("maxed"), F.col("n_members")).otherwise(0), "m": F.when(F.col("maxed"), F.col("n_members")).otherwise(0), "uf": F.when(~F.col("maxed"), 1).otherwise(0), "um": F.when(F.col("maxed"), 1).otherwise(0)}.items()))
    return per_cluster.groupBy("strategy").agg(F.sum("f").alias("n_elements_found"), F.sum("m").alias("n_elements_maxed"), F.sum("uf").alias("n_units_found"), F.sum("um").alias("n_units_maxed"), F.count_if("all_maxed").alias("n_clusters_all_maxed"), F.count_if("any").alias("n_clusters_any_found"))


def length_stats(units: DataFrame) -> DataFrame:
    """Per strategy the mean length of what was found and the shares of its length buckets; null if nothing was."""
    s = lambda c: F.sum(c)
    share = lambda c: F.try_divide(s(c) * 100.0, s("n_found"))
    return units.groupBy("strategy").agg(s("n_found").alias("n_consensuses"), F.try_divide(s("len_found") * 1.0, s("n_found")).alias("avg_length"), share("n_under").alias("pct_under_4"), share("n_in").alias("pct_4_to_20"), share("n_over").alias("pct_over_20"))


def strategy_comparison(units: DataFrame, totals: DataFrame, strategies: DataFrame, cluster: list[str]) -> DataFrame:
    """One row for each strategy: outcome, lengths and shares of the universe; group columns only at group level."""
    df = strategies.select("strategy", "kind", "level").join(strategy_outcome(units, cluster), "strategy").join(length_stats(units), "strategy")
    df = df.join(F.broadcast(totals))  # one row
    group = F.col("level") == "group"
    pct = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    seg = F.col("kind") == "S"
    return df.select(
        "strategy", "n_elements", "n_elements_found", "n_elements_maxed", "n_clusters", "n_clusters_all_maxed", "n_clusters_any_found",
        F.when(group, F.col("n_groups")).alias("n_groups"), F.when(group, F.col("n_units_found")).alias("n_groups_found"), F.when(group, F.col("n_units_maxed")).alias("n_groups_maxed"),
        pct("n_elements_found", "n_elements").alias("pct_elements_found"), pct("n_clusters_any_found", "n_clusters").alias("pct_clusters_any_found"), F.when(group, pct("n_units_found", "n_groups")).alias("pct_groups_found"),
        F.when(seg, F.try_divide(F.col("n_consensuses") * 1.0, F.col("n_clusters"))).alias("avg_per_cluster"), F.when(seg & group, F.try_divide(F.col("n_consensuses") * 1.0, F.col("n_groups"))).alias("avg_per_group"),
        "avg_length", "pct_under_4", "pct_4_to_20", "pct_over_20",
    )


#: The comparison's strategies: name, kind, level, thresholds of small and large units, runs, cutoff.
STRATEGIES = (
    *((f"A {t}", "A", "cluster", t, t, 2, 2, 3) for t in (0.9, 0.7, 0.5)),
    *((f"B {t}", "B", "cluster", t, t, 1, 1, 3) for t in (0.9, 0.7, 0.5)),
    ("A dynamic", "A", "cluster", 0.9, 0.7, 2, 2, 3),
    ("B dynamic", "B", "cluster", 0.9, 0.7, 1, 1, 3),
    ("C group", "S", "group", 1.0, 1.0, 1, 1, 3),
    ("C cluster", "S", "cluster", 1.0, 1.0, 1, 1, 3),
    ("C dynamic", "S", "cluster", 0.9, 0.7, 1, 1, 3),
    ("D group", "S", "group", 1.0, 1.0, 2, 2, 3),
    ("D cluster", "S", "cluster", 1.0, 1.0, 2, 2, 3),
    ("D dynamic", "S", "cluster", 0.9, 0.7, 2, 2, 3),
    ("E cluster", "S", "cluster", 1.0, 1.0, 1, 2, 3),
)
STRATEGY_SCHEMA = "strategy string, kind string, level string, small double, large double, run_small int, run_large int, cutoff int"
