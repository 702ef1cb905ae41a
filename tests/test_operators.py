import random

import pytest
from pyspark.sql import functions as F

from quillon.errors import Corrupted, DuplicateKey, KeyNotFound, RecordTooLarge, SqlError
from quillon.functions.bitset import BitSet
from quillon.functions.codec import decode_row, encode_row, row_size
from quillon.operators import bitmap, join, scan, sort


def keyed(spark, pairs):
    return spark.createDataFrame(list(pairs), "key long, payload long")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scans(spark, tmp_path):
    df = keyed(spark, ((k, k * 10) for k in range(1000)))
    scan.bulk_load(df, str(tmp_path / "t"), "key")
    t = scan.full_scan(spark, str(tmp_path / "t"), df.schema)
    assert t.count() == 1000
    assert [r[0] for r in rows(scan.ordered_range(t, "key", 100, 200))] == list(range(100, 201))
    assert scan.range_scan(t, "key", 5, 4).count() == 0 and scan.range_scan(t, "key", 990, 5000).count() == 10
    assert scan.lookup(t, "key", 42)["payload"] == 420
    with pytest.raises(KeyNotFound):
        scan.lookup(t, "key", 1000)
    assert scan.empty_scan(t).collect() == [] and scan.empty_scan(t).columns == ["key", "payload"]
    plan = scan.range_scan(t, "key", 100, 200)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,100)" in plan and "LessThanOrEqual(key,200)" in plan


def test_keyed_append(spark, tmp_path):
    target = str(tmp_path / "t")
    scan.keyed_append(keyed(spark, [(42, 1), (2**63 - 1, 2)]), target, "key")
    with pytest.raises(DuplicateKey, match="42"):
        scan.keyed_append(keyed(spark, [(7, 3), (42, 9)]), target, "key")
    with pytest.raises(DuplicateKey, match="5"):
        scan.keyed_append(keyed(spark, [(5, 3), (5, 9)]), target, "key")
    scan.keyed_append(keyed(spark, [(43, 5)]), target, "key")
    assert sorted(rows(spark.read.parquet(target))) == [(42, 1), (43, 5), (2**63 - 1, 2)]


@pytest.mark.parametrize("strategy", join.STRATEGIES)
def test_joins(spark, strategy):
    a, b = keyed(spark, ((k, 2 * k) for k in range(50))), keyed(spark, ((k, 3 * k) for k in range(50)))
    out = join.hash_join(a.alias("a"), b.alias("b"), F.col("a.key"), F.col("b.key"), strategy)
    assert len(out.columns) == 4 and sorted(rows(out)) == [(k, 2 * k, k, 3 * k) for k in range(50)]
    c = keyed(spark, ((k, k) for k in range(100, 110)))
    assert join.hash_join(a, c, a["key"], c["key"], strategy).count() == 0
    m, n = keyed(spark, ((k, k % 5) for k in range(20))), keyed(spark, ((k, k % 5) for k in range(10)))
    assert join.hash_join(m, n, m["payload"], n["payload"], strategy).count() == 40
    assert join.joined_on(m, n, F.col("payload") * 2, F.col("payload") + 4).count() == sum(1 for i in range(20) for k in range(10) if i % 5 * 2 == k % 5 + 4)


def test_join_rejects_unknown_strategy_and_ignores_nulls(spark):
    a = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(ValueError):
        join.hash_join(a, a, "x", "x", "magic")
    assert join.joined_on(a, a, F.col("x"), F.col("x")).count() == 1


def test_pipeline(spark):
    left = sort.sort_by(keyed(spark, ((k, 100 - k) for k in range(100))), "payload")
    right = keyed(spark, ((k, k) for k in range(1, 51)))
    assert join.hash_join(left, right, left["payload"], right["payload"]).count() == 50


def test_sorts(spark):
    rng = random.Random(3)
    pairs = [(k, rng.randrange(50)) for k in range(500)]
    df = keyed(spark, pairs)
    assert rows(sort.sort_by(df, "payload", "key")) == sorted(pairs, key=lambda p: (p[1], p[0]))
    assert rows(sort.sort_by(df, F.col("payload") % 7, "key", descending=True)) == sorted(pairs, key=lambda p: (-(p[1] % 7), p[0]))
    assert [p for _, p in rows(sort.external_sort(df, "payload", 3))] == sorted(p for _, p in pairs)
    big = keyed(spark, [(-1, 0), (1, 0), (-(2**63), 0), (0, 0)])
    assert [k for k, _ in rows(sort.sort_by(big, sort.unsigned("key")))] == [0, 1, -(2**63), -1]


def test_bitmap_index(spark):
    pairs = [(10, 0), (10, 5), (10, 99), (20, 1), (20, 99), (20, 99), (30, 32767), (30, 32768), (30, 100_000)]
    df = spark.createDataFrame(pairs, "key long, row long")
    index = bitmap.build_index(df, "key", "row")
    got = lambda x: sorted(r[0] for r in bitmap.positions(x).collect())
    assert got(bitmap.lookup(index, 10)) == [0, 5, 99] and got(bitmap.lookup(index, 999)) == []
    assert got(bitmap.lookup(index, 30)) == [32767, 32768, 100_000]
    assert got(bitmap.any_of(index, [10, 20])) == [0, 1, 5, 99] and got(bitmap.any_of(index, [])) == []
    assert got(bitmap.all_of(index, [10, 20])) == [99] and got(bitmap.all_of(index, [])) == [] and got(bitmap.all_of(index, [10, 30])) == []
    assert bitmap.num_values(index).first()[0] == 3
    assert bitmap.total_rows(df, "row").first()[0] == 100_001 and bitmap.total_rows(df.limit(0), "row").first()[0] == 0
    assert bitmap.count_rows(index, 20).first()[0] == 2 and bitmap.count_rows(index, 21).first()[0] == 0
    a, b = bitmap.lookup(index, 10), bitmap.lookup(index, 20)
    assert got(bitmap.set_and(a, b)) == [99] and got(bitmap.set_or(a, b)) == [0, 1, 5, 99]
    far, length = bitmap.lookup(index, 30), 100_003
    absent = set(range(length)) - {32767, 32768, 100_000}
    assert got(bitmap.set_not(far, length)) == sorted(absent) and got(bitmap.set_not(bitmap.lookup(index, 999), 65536)) == list(range(65536))
    assert got(bitmap.set_not(a, 0)) == [] and got(bitmap.set_not(far, bitmap.total_rows(df, "row").withColumn("total_rows", F.lit(9)))) == list(range(9))
    assert got(bitmap.set_and(bitmap.set_or(a, far), bitmap.set_not(a, 200_000))) == [32767, 32768, 100_000]
    assert got(bitmap.row_set(df.where("key = 20"))) == [1, 99]
    assert got(bitmap.set_not(a, 8)) == [1, 2, 3, 4, 6, 7] and bitmap.set_count(a).first()[0] == 3
    assert [r[0] for r in bitmap.set_iterate(b).collect()] == [1, 99]


def test_scans_through_an_index(spark):
    index = bitmap.build_index(spark.createDataFrame([(10, 1), (10, 3), (10, 5), (20, 3), (20, 5), (20, 7)], "key long, row long"), "key", "row")
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", 5), ("e", 9)], "v string, id long")  # 7 is absent
    got = lambda x: sorted(r[0] for r in x.collect())
    assert got(bitmap.scan_by_index(df, "id", index, 10)) == ["b", "c", "d"] and got(bitmap.scan_by_index(df, "id", index, 30)) == []
    assert got(bitmap.scan_by_index_or(df, "id", index, [10, 20])) == ["b", "c", "d"] and got(bitmap.scan_by_index_or(df, "id", index, [])) == []
    assert got(bitmap.scan_by_index_and(df, "id", index, [10, 20])) == ["c", "d"] and got(bitmap.scan_by_index_and(df, "id", index, [])) == []
    assert bitmap.scan_by_index(df, "id", index, 20).columns == ["v", "id"]


def test_bitmap_scans(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "b")], "row long, key string")
    assert bitmap.scan_equal(df, "key", "a").count() == 2
    assert bitmap.scan_or(df, "key", ["a", "z"]).count() == 2 and bitmap.scan_or(df, "key", []).count() == 0
    assert bitmap.scan_and(df, F.col("key") == "b", F.col("row") == 3).count() == 2 and bitmap.scan_and(df).count() == 0
    assert rows(bitmap.scan_and_keys(df, "row", "key", ["a", "b", "a"])) == [(1,)] and bitmap.scan_and_keys(df, "row", "key", []).count() == 0


def test_bitset():
    a, b = BitSet.of(100, [1, 3, 5, 64, 99]), BitSet.of(64, [3, 5, 7])
    assert len(a & b) == 64 and list(a & b) == [3, 5] and len(a | b) == 100 and (a | b).count() == 6
    assert (~b).count() == 61 and ~~b == b and len(~b) == 64
    assert a.get(64) and not a.get(2) and not a.get(1000)
    a.clear(64)
    a.set(2)
    assert list(a) == [1, 2, 3, 5, 99] and BitSet.from_words(100, a.words()) == a
    with pytest.raises(IndexError):
        a.set(100)
    a.ensure_capacity(128)
    a.set(127)
    assert a.get(127) and BitSet(0).is_empty() and list(BitSet(10)) == []


def test_codec():
    row = [42, "hello world", True, -7, "é😀", ""]
    data = encode_row(row)
    assert len(data) == 256 and decode_row(data) == row and data[0] == 6
    assert row_size(["x" * 252]) == 256
    for bad in (["x" * 253], ["é" * 127], [1] * 52):
        with pytest.raises(RecordTooLarge):
            encode_row(bad)
    with pytest.raises(SqlError):
        encode_row([True] * 256)
    for damaged in (b"", b"\x01\x09", b"\x01\x01\xff\x00ab", b"\x01\x01\x01\x00\xff", b"\x02\x00\x01\x00\x00\x00"):
        with pytest.raises(Corrupted):
            decode_row(damaged)
