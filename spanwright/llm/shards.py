"""Shards of equal row counts that keep linked documents together: balanced label propagation.

Documents that share a key (here: equal texts) are linked. All start dealt by a hash. In each round
every group of linked documents looks at how many members it has in which shard and asks those elsewhere
to move to one shard; moves are granted in order of the cut links that they save, as far as shards
have room or exchange rows. Members of a group are alike to these rules, so a group is one row
with its members' number in each shard, however many they are. In the end documents without links
fill the shards up to their exact quotas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.operators.ranking import numbered
from spanwright.operators.skew import even_join
from spanwright.session import Tables

SHARDS = 40
#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Rounds at most, and the share of its quota that a shard may take beyond it until the end, if fewer rows than that have no links.
ROUNDS, SLACK = 12, 0.02


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _at(values: Column, shard: Column) -> Column:
    return F.get(values, shard.cast("int"))


def granted(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to go from one shard to another may: as many as come back, and more while there is room."""
    out = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    left, going = list(room), True
    while going:
        going = False
        for (a, b), n in sorted(asked.items()):
            if (more := min(n - out[a, b], left[b])) > 0:
                out[a, b] += more
                left[a] += more
                left[b] -= more
                going = True
    return out


def asked(groups: DataFrame, room: list[int], exchange: bool) -> DataFrame:
    """``key, shard, target, n, score``: members of split groups that ask to move, and the cut links that a move saves.

    ``groups`` has ``key, size, by`` (members by shard). If a shard has room for all members that are
    elsewhere, the group asks for the one of these with the most members; else members ask for the shard with
    more of them than their own that has any room, in an exchange whatever its room. Ties go by a hash.
    """
    left, size = _numbers(room), F.col("size")
    have = lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0).cast("bigint"))
    fits = lambda s: F.lit(not exchange) & (size - have(s) <= _at(left, s)) & (_at(left, s) > 0)
    each = F.transform(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.struct(fits(s).alias("fits"), have(s).alias("have"), F.xxhash64("key", s).alias("tie"), s.alias("s")))
    best = F.array_max(F.filter(each, lambda c: (c["have"] > 0) & (F.lit(exchange) | (_at(left, c["s"]) > 0)) | c["fits"]))
    per = groups.where(F.size("by") > 1).withColumn("best", best).where(F.col("best").isNotNull())
    squares = F.aggregate(F.map_values("by"), F.lit(0).cast("bigint"), lambda acc, v: acc + v * v)
    saved = (size * size - squares) / (2 * (size - F.col("best.have")))
    rows = per.select("key", "best", saved.alias("saved"), F.explode("by").alias("shard", "n")).where(F.col("shard") != F.col("best.s"))
    there, tie = F.col("best.have"), F.col("best.tie")
    more = (there > F.col("n")) | ((there == F.col("n")) & (tie > F.xxhash64("key", "shard")))
    score = F.when(F.col("best.fits"), F.col("saved")).otherwise((there - F.col("n") + 1).cast("double"))
    return rows.where(F.col("best.fits") | more).select("key", "shard", F.col("best.s").alias("target"), "n", score.alias("score"))


def _by_key(cells: DataFrame, shards: int) -> DataFrame:
    """``key, size, by`` of ``key, shard, n``, which may have several rows of a key and shard: a few dozen of a key at most."""
    per = cells.groupBy("key").agg(F.collect_list(F.struct("shard", "n")).alias("x"), F.sum("n").alias("size"))
    total = lambda s: F.aggregate(F.filter("x", lambda c: c["shard"] == s), F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("s"), total(s).alias("n")))
    return per.select("key", "size", F.map_from_entries(F.filter(each, lambda c: c["n"] > 0)).alias("by"))


def propagated(groups: DataFrame, most: list[int], kept: Tables) -> DataFrame:
    """``groups`` (``key, size, by``, a kept table) after the rounds; shards hold ``most`` members, where they did at first.

    A round takes a number for each pair of shards to the driver. Moves between two shards are ranked in one window, which
    holds about one in shards * shards of the groups that ask.
    """
    shards = len(most)
    held = [0] * shards
    for shard, n in groups.select(F.explode("by").alias("shard", "n")).groupBy("shard").agg(F.sum("n")).collect():
        held[shard] = n
    exchange, idle = False, 0
    for _ in range(ROUNDS):
        room = [m - h for m, h in zip(most, held, strict=True)]
        asks = asked(groups, room, exchange)
        wanted = {(r.shard, r.target): r.n for r in asks.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        grants = granted(wanted, room)
        # An exchange follows where room grants little; when both grant nothing, all is done
        some = sum(grants.values())
        exchange = not exchange and (2 * some < sum(wanted.values()) or not some)
        idle = 0 if some else idle + 1
        if idle == 2:
            break
        if not some:
            continue
        for (a, b), n in grants.items():
            held[a] -= n
            held[b] += n
        limits = groups.sparkSession.createDataFrame([(a, b, n) for (a, b), n in grants.items()], "shard int, target int, most bigint")
        before = F.coalesce(F.sum("n").over(W.partitionBy("shard", "target").orderBy(F.desc("score"), "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        moved = asks.withColumn("before", before).join(F.broadcast(limits), ["shard", "target"])  # a row for each pair of shards
        moved = moved.withColumn("n", F.least("n", F.col("most") - F.col("before"))).where(F.col("n") > 0)
        ends = F.explode(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("target").alias("shard"), "n"))).alias("x")
        cells = groups.select("key", F.explode("by").alias("shard", "n")).unionByName(moved.select("key", ends).select("key", "x.shard", "x.n"))
        after = kept.keep(_by_key(cells, shards))
        kept.drop(groups)
        groups = after
    return groups


def sharded(rows: DataFrame, key: str, order: list[str | Column], shards: int = SHARDS, kept: Tables | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: counts of shards at most one apart, rows of one ``key`` together where quotas allow.

    Rows with a null key or one of their own have no links. ``order`` should tell rows apart; it sets the
    even start. A key with more rows than a shard's quota is in several shards.
    """
    kept = kept or Tables(rows.sparkSession)
    columns = [c for c in rows.columns if c != key]
    named = kept.keep(rows.withColumnRenamed(key, "key") if key != "key" else rows)
    quota = quotas(named.count(), shards)
    start = F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int")
    counts = named.where(F.col("key").isNotNull()).groupBy("key", start.alias("shard")).agg(F.count("*").alias("n"))
    groups = kept.keep(_by_key(counts, shards).where(F.col("size") > 1))
    n_linked = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sizes = groups.select("key", F.col("size").alias("n"))
    both = kept.keep(even_join(named, sizes.withColumnRenamed("n", "linked"), ["key"], "left", counts=sizes, total=named.count()))
    slack = SLACK if n_linked > (1 - SLACK) * sum(quota) else 0
    groups = propagated(groups, [q + int(q * slack) for q in quota], kept)
    # Members are dealt to the shards of their group by their place in it
    linked = kept.keep(numbered(both.where(F.col("linked").isNotNull()), ["key"], order, "place", kept))
    linked = even_join(linked, groups.select("key", F.map_entries("by").alias("by")), ["key"], counts=groups.select("key", F.col("size").alias("n")), total=n_linked)
    upto = F.aggregate("by", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("shard")), lambda acc, c: F.struct((acc["sum"] + c["value"]).alias("sum"), F.when((acc["sum"] < F.col("place")), c["key"]).otherwise(acc["shard"]).alias("shard")))
    linked = kept.keep(linked.withColumn("shard", upto["shard"]).withColumn("row", F.col("place")).drop("by", "place"))
    # What is beyond a quota goes from the largest groups
    linked = kept.keep(numbered(linked, ["shard"], ["linked", "key", "row"], "place", kept))
    held = [0] * shards
    for shard, n in linked.groupBy("shard").count().collect():
        held[shard] = min(n, quota[shard])
    stay = F.col("place") <= _at(_numbers(quota), F.col("shard"))
    free = both.where(F.col("linked").isNull()).select("key", *columns).unionByName(linked.where(~stay).select("key", *columns))
    free = numbered(free, [], [F.xxhash64(*order), *order], "place", kept)
    needed = [q - h for q, h in zip(quota, held, strict=True)]
    ends = [sum(needed[: s + 1]) for s in range(shards)]
    at = F.col("place") - 1
    shard = F.size(F.filter(_numbers(ends), lambda e: e <= at))
    slot = at + _at(_numbers([h - e + n for h, e, n in zip(held, ends, needed, strict=True)]), shard)
    filled = free.select(*columns, shard.cast("int").alias("shard"), slot.alias("slot"))
    return linked.where(stay).select(*columns, "shard", (F.col("place") - 1).alias("slot")).unionByName(filled)


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard and slot of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: counts of shards are at most one apart. Equal texts are linked, empty ones too; a null text
    has no bytes, no link and the checksum 0. Repeated rows are rows of their own; null ids are
    ids; an empty table has no rows; other columns are not read. Slots count from 0 without gaps.
    """
    text = F.coalesce("text", F.lit(""))
    columns = [F.col("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")]
    out = sharded(docs.select(*columns), "key", ["doc_id", "key"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
