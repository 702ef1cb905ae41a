"""Candidates, links and groups of similar items, whatever these are, in DataFrame functions alone.

An item has an identity of two longs, h and h2, a ``size`` of two 32-bit numbers, keys (``packed``), and places: a row of a
stored table (``common.stored_rows``) and a number within it. A key's items are sorted by the item's next keys, then each is paired with the one
before it and with the least, the pivot: a key that many items share costs two comparisons each, and similar items,
which share several keys, are neighbours for some of them. A key of more rows than an average partition is dealt out by the next keys as well.
What this leaves out is made up for: of each key, all items are then paired with all that the links found so far don't connect them to (``remaining_pairs``), so
groups are those of all pairs that share a key. Both ways compare only what sizes and marks allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, materialize, remove, settings

#: A key has 44 bits of its own and 10 of each of the next two.
NEXT = 10
#: One item in so many is counted to find keys of more than ``HOT`` rows.
COUNTED, HOT = 16, 2000
#: Tables that making links leaves.
LINKING = ("texts", "places", "wanted", "by_words")
#: Distances are dear and their rows few bytes: adaptive execution would put them into few tasks.
NARROW = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
#: So many items of a key meet all others of it in one task.
LANE = 2000
#: Keys are compared in so many passes; what one shuffles is gone before the next.
PASSES = 4


def packed(own: Column, after: Column, then: Column) -> Column:
    low = F.lit((1 << NEXT) - 1).cast("long")
    return F.shiftleft(own, 2 * NEXT).bitwiseOR(F.shiftleft(after.bitwiseAND(low), NEXT)).bitwiseOR(then.bitwiseAND(low))


def allowed(n: Column, similarity: float) -> Column:
    """Edits of an item of size ``n`` that ``similarity`` leaves room for."""
    return F.floor(F.lit(1 - similarity) * n + 1e-9)


def near(a: Column, b: Column, similarity: float) -> Column:
    """Whether sizes a and b allow ``similarity``."""
    return F.abs(a - b) <= allowed(F.greatest(a, b), similarity)


def dealt(keyed: DataFrame, rows: int) -> DataFrame:
    """``keyed`` (key, h, size) and ``part``, the part of the key that its items are grouped by.

    That is the key's own bits; its next keys as well where those have more rows than an average partition, and a hash of the item
    where that is not enough. Such prefixes are found by counting one item in ``COUNTED``, so there are as many as
    partitions at most, and few enough to broadcast. This deals rows out; none is left out.
    """
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT, rows // partitions)
    counted = keyed.where(F.pmod(F.xxhash64("h", F.lit(11)), F.lit(COUNTED)) == 0)
    steps = [F.shiftrightunsigned("key", NEXT * k) for k in (2, 1, 0)]
    prefixes = F.array(*[F.struct(F.lit(k).alias("step"), s.alias("prefix")) for k, s in enumerate(steps)])
    hot = counted.select(F.explode(prefixes).alias("p")).groupBy("p.step", "p.prefix").count().where(F.col("count") * COUNTED > most)
    found = hot.select("step", "prefix").collect()
    part, salt = steps[0], F.pmod(F.xxhash64("key", "h", F.lit(12)), F.lit(max(1 << 10, partitions)))
    for k, longer in ((0, steps[1]), (1, steps[2]), (2, F.xxhash64("key", salt))):
        prefix = sorted({r["prefix"] for r in found if r["step"] == k})
        if prefix:
            part = F.when(steps[k].isin(prefix), longer).otherwise(part)
    return keyed.withColumn("part", part)


def candidate_pairs(distinct: DataFrame, where: str, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), by h, of items that are neighbours or pivot and member of a key, one of whose sizes allows ``similarity``.

    ``distinct`` has h, size and keys, a row per item.
    """
    keyed = distinct.select("h", "size", F.explode("keys").alias("key"))
    group = Window.partitionBy("part").orderBy("key", "h")
    keyed = dealt(keyed, distinct.select(F.sum(F.size("keys"))).first()[0] or 0)
    line = F.struct("h", "size")
    first = F.first(line).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keyed = keyed.select("h", "size", first.alias("first"), F.lag(line).over(group).alias("last")).where("last is not null")
    pairs = keyed.select("h", "size", F.explode(F.array_distinct(F.array("first", "last"))).alias("other"))
    pairs = pairs.where(sizes_allow("size", "other.size", similarity) & (F.col("h") != F.col("other.h")))
    return materialize(pairs.select(F.least("h", "other.h").alias("a"), F.greatest("h", "other.h").alias("b")).distinct(), where)


def sizes_allow(a: str, b: str, similarity: float) -> Column:
    units_of, chars = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), (lambda c: F.shiftright(c, 32))
    return near(units_of(a), units_of(b), similarity) | near(chars(a), chars(b), similarity)


def meeting(members: DataFrame, similarity: float, may: Callable[[str, str], Column] | None) -> DataFrame:
    """Pairs (a, b), once each, of items x and y of one key and different roots whose sizes, and ``may``, allow a link.

    ``members`` has a row per key and item: key, lanes, h, root, size, ``own``, the item's keys, and what ``may`` reads. Items that share several keys meet in the least of them.
    Of a key of many items, each lot of ``LANE`` meets all, in a task of its own.
    """
    names = [c for c in members.columns if c not in ("key", "lanes")]
    one = members.select("key", F.pmod(F.xxhash64("h", F.lit(13)), F.col("lanes")).cast("int").alias("lane"), F.struct(*names).alias("x"))
    every = members.select("key", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.struct(*names).alias("y"))
    ok = (F.col("x.root") < F.col("y.root")) & sizes_allow("x.size", "y.size", similarity)
    here = F.array_min(F.array_intersect("x.own", "y.own")) == F.col("key")
    met = one.hint("merge").join(every, ["key", "lane"]).where((ok & may("x", "y") if may else ok) & here)
    return met.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))


def remaining_pairs(distinct: DataFrame, pairs: DataFrame, found: DataFrame, where: str, similarity: float, may: Callable[[str, str], Column] | None, described: Callable[[DataFrame, str], DataFrame] | None) -> DataFrame:
    """Pairs (a, b) of items that share a key, are in different groups of ``found`` and aren't among ``pairs``, the ``candidate_pairs`` written at ``where``.

    ``may`` gives a condition on items x and y that every link meets; x and y have the columns of ``distinct``, keys and places aside, and those that ``described``, given
    h of the items that are left, adds by h.
    """
    own = F.array_distinct(F.transform("keys", lambda k: F.shiftrightunsigned(k, 2 * NEXT)))
    items = distinct.select(*[c for c in distinct.columns if c not in ("keys", "n", "_row", "at")], own.alias("own"))
    roots = found.select("node.h", "node.h2", F.col("root.h").alias("root"))
    items = materialize(items.join(roots.hint("merge"), ["h", "h2"], "left").withColumn("root", F.coalesce("root", "h")).drop("h2"), f"{where}_items")
    keyed = items.select("h", "root", F.explode("own").alias("key"))
    lanes = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes"))
    lanes = materialize(lanes.where("low < high").select("key", "lanes"), f"{where}_lanes")
    left = materialize(keyed.select("h", "key").join(lanes.hint("merge"), "key"), f"{where}_left")
    wanted = left.select("h").distinct()
    more = described(wanted, f"{where}_described") if described else wanted
    items = materialize(items.join(more.hint("merge"), "h"), f"{where}_known")
    remove(distinct.sparkSession, f"{where}_items", f"{where}_described")
    met = None
    for k in range(PASSES):
        members = left.where(F.pmod("key", F.lit(PASSES)) == k).join(items.hint("merge"), "h")
        some = materialize(meeting(members, similarity, may), f"{where}_met{k}")
        met = some if met is None else met.unionByName(some)
    met = materialize(met.join(pairs.hint("merge"), ["a", "b"], "left_anti"), f"{where}_rest")
    remove(distinct.sparkSession, *[f"{where}_{x}" for x in ("lanes", "left", "known", *[f"met{k}" for k in range(PASSES)])])
    return met


def linked_groups(
    distinct: DataFrame, where: str, similarity: float, links: Callable[[DataFrame, str], DataFrame], may: Callable[[str, str], Column] | None = None, described: Callable[[DataFrame, str], DataFrame] | None = None, given: DataFrame | None = None,
    between: Callable[[DataFrame | None, str], DataFrame] | None = None,
) -> DataFrame:
    """``groups`` of the links among all pairs of items that share a key, and of those ``given``. ``links`` takes pairs and a folder, and gives those that are similar.
    ``between``, given the groups so far and the folder, gives further links of these pairs, which cost more; it may leave out those within a group."""
    spark, stored = distinct.sparkSession, f"{where}/pairs"
    pairs = candidate_pairs(distinct, stored, similarity)
    linked = links(pairs, where)
    found = groups(linked.unionByName(given) if given is not None else linked, where)
    if between:
        found = merged(found, between(found, where), where)
    remove(spark, *[f"{where}/{x}" for x in LINKING])
    rest = remaining_pairs(distinct, pairs, found, stored, similarity, may, described)
    remove(spark, stored)
    if not rest.isEmpty():
        linked = links(rest, f"{where}/rest")
        found = merged(found, linked.unionByName(between(None, f"{where}/rest")) if between else linked, f"{where}/rest")
    remove(spark, *[f"{where}/rest/{x}" for x in LINKING], f"{stored}_rest")
    return found


def places(distinct: DataFrame, pairs: DataFrame, where: str) -> DataFrame:
    """``_part``, ``_row`` and ``spots`` (at, h, h2): where each item of a pair first occurs, by row."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    wanted = materialize(wanted, f"{where}/wanted")
    found = distinct.select("h", "h2", "_row", "at").join(wanted.hint("merge"), "h")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("at", "h", "h2")).alias("spots")).withColumn("_part", F.shiftright("_row", 33))
    return materialize(found, f"{where}/places")


def paired(pairs: DataFrame, texts: DataFrame, form: str = "text") -> DataFrame:
    """``pairs`` as identities (a, a2) and (b, b2) with their texts ta and tb; ``texts`` has h, h2 and the column ``form``."""
    one, two = texts.select("h", "h2", form).toDF("a", "a2", "ta"), texts.select("h", "h2", form).toDF("b", "b2", "tb")
    return pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "a2", "b", "b2", "ta", "tb")


def groups(linked: DataFrame, where: str) -> DataFrame:
    """Connected components of the links (a, a2) to (b, b2), as identities ``node`` and ``root``."""
    node = lambda h, h2: F.struct(F.col(h).alias("h"), F.col(h2).alias("h2"))
    with settings(linked.sparkSession, NARROW):
        edges = materialize(linked.select(node("a", "a2").alias("u"), node("b", "b2").alias("v")), f"{where}/edges")
    found = connected_components(edges, f"{where}/components")
    found = materialize(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), f"{where}/groups")
    remove(linked.sparkSession, f"{where}/edges", f"{where}/components")
    return found


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, a2, b, b2) that are not in one group of ``found``, and the roots ``ra`` and ``rb``, an item of no group its own."""
    out = pairs.select("a", "a2", "b", "b2")
    for x in "ab":
        of = found.select(F.col("node.h").alias(x), F.col("node.h2").alias(f"{x}2"), F.col("root").alias(f"r{x}"))
        out = out.join(of.hint("merge"), [x, f"{x}2"], "left").withColumn(f"r{x}", F.coalesce(f"r{x}", F.struct(F.col(x).alias("h"), F.col(f"{x}2").alias("h2"))))
    return out.where("ra <> rb")


def merged(found: DataFrame, linked: DataFrame, where: str) -> DataFrame:
    """``groups`` of ``found`` joined by links: components of their roots alone."""
    roots = apart(linked, found).select("ra.h", "ra.h2", "rb.h", "rb.h2").toDF("a", "a2", "b", "b2")
    top = groups(roots, f"{where}/between")
    old = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = top.join(found.select("node").hint("merge"), "node", "left_anti").select("node", "root")
    out = materialize(old.unionByName(new), f"{where}/merged")
    remove(linked.sparkSession, f"{where}/between")
    return out


def later(seen: DataFrame, distinct: DataFrame, found: DataFrame, where: str) -> DataFrame:
    """``_row`` and ``at`` of every occurrence of an item but the first of its group, by (doc, row, at), a null doc last."""
    # the joins are merges at any size: what is small here is a share of the input, and grows with it
    again = distinct.select("h", "h2", "n").join(found.select("node.h", "node.h2", "root").hint("merge"), ["h", "h2"], "left").where("n > 1 or root is not null")
    again = materialize(again.select("h", "h2", F.coalesce("root", F.struct("h", "h2")).alias("root")), f"{where}/again")
    spots = seen.select("h", "h2", "_row", "at", "doc").join(again.hint("merge"), ["h", "h2"])
    spots = materialize(spots.select("root", F.struct(F.col("doc").isNull().alias("last"), "doc", "_row", "at").alias("spot")), f"{where}/spots")
    least = materialize(spots.groupBy("root").agg(F.min("spot").alias("least")), f"{where}/least")
    return spots.join(least.hint("merge"), "root").where("spot > least").select("spot._row", "spot.at")
