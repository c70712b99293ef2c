import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from locusforge.llm import sharding
from locusforge.llm.common import fresh_path
from locusforge.llm.sharding import Conflict, Shard, ShardStore, arrive


def store(spark, **options):
    return ShardStore(spark, fresh_path(spark, "shards"), **{"target_bytes": 40_000, "fan_in": 3, "least_bytes": 2_000, **options})


def rows(spark, n, parts, start=0):
    return spark.range(start, start + n, 1, parts).selectExpr("id as doc_id", "case when id % 7 = 0 then null else repeat(sha2(cast(id as string), 256), 3) end as text", "id % 3 as shard", "'v' as version")


def test_appends_merge_into_target_sized_shards(spark):
    s = store(spark)
    want = Counter()
    for k in range(4):
        df = rows(spark, 500, 6, k * 500)
        s.append(df)
        before = {x for x in s.shards()}
        s.compact()
        want.update(r.doc_id for r in df.collect())
        assert Counter(r.doc_id for r in s.read().select("doc_id").collect()) == want
        assert before != set(s.shards()) or not s.plan(s.shards())
    shards = s.shards()
    assert not s.plan(shards) and max(x.bytes for x in shards) <= 1.3 * 40_000
    assert sum(x.rows for x in shards) == 2000 and max(x.generation for x in shards) >= 1
    assert Counter(r.shard_rows for r in s.placement().collect()) == Counter({n: n * k for n, k in Counter(x.rows for x in shards).items()})


def test_versions_are_snapshots_until_vacuum(spark):
    s = store(spark)
    first = s.append(rows(spark, 300, 6))
    held = s.shards(first)
    second = s.compact()
    assert second > first and s.shards(first) == held and s.read(first).count() == s.read(second).count() == 300
    s.vacuum()
    assert s.versions() == [second] and s.read().count() == 300


def test_a_version_is_committed_once(spark):
    s = store(spark)
    s.append(rows(spark, 10, 1))
    with pytest.raises(Conflict):
        s._commit(0, [], s.schema().json())
    assert s.read().count() == 10


def test_plan_is_size_tiered(spark):
    s = store(spark)
    of = lambda *sizes: [Shard(f"s{i}", "f", 1, b, 0) for i, b in enumerate(sizes)]
    assert s.plan(of(100, 200)) == [] and s.plan(of(100, 39_000, 15_000)) == []
    assert [len(g) for g in s.plan(of(100, 200, 300, 15_000, 39_000))] == [3]
    assert [sum(x.bytes for x in g) <= 40_000 for g in s.plan(of(*[15_000] * 7))] == [True] * 3
    assert s.tier(1) == 0 and s.tier(6_000) == 1 and s.tier(18_000) == 2


def test_odd_rows(spark):
    s = store(spark)
    df = rows(spark, 40, 4)
    more = spark.createDataFrame([(None, None, None, None), (None, "x" * 90_000, 1, "")], "doc_id long, text string, shard long, version string")
    odd = df.union(df.limit(3)).union(more)
    arrive(s, odd, arrivals=3)
    got = Counter(tuple(r) for r in s.read().collect())
    assert got == Counter(tuple(r) for r in odd.collect())
    empty = store(spark)
    arrive(empty, df.limit(0), arrivals=2)
    assert empty.read().count() == 0 and empty.placement().count() == 0 and empty.read().columns == df.columns


def test_clearing_between_write_and_commit_loses_nothing(spark, monkeypatch):
    """Two writers of one store: the second one clears when the first has written and not yet committed."""
    one = store(spark)
    other = ShardStore(spark, one.root, target_bytes=40_000, fan_in=3, least_bytes=2_000)
    other.append(rows(spark, 100, 2, 5000))
    commit, calls = one._commit, []

    def late(*args):
        if not calls:
            calls.append(1)
            other.append(rows(spark, 50, 1, 9000))
            other.compact()
            other.vacuum()
        return commit(*args)

    monkeypatch.setattr(one, "_commit", late)
    one.append(rows(spark, 300, 6))
    assert sorted(r.doc_id for r in one.read().collect()) == [*range(300), *range(5000, 5100), *range(9000, 9050)]
    one.compact()
    one.vacuum()
    assert one.read().count() == 450


def test_what_a_dead_writer_left_goes_in_time(spark):
    s = store(spark)
    s.append(rows(spark, 10, 1))
    with s._intent("append-dead"):
        rows(spark, 10, 1).write.parquet(f"{s.root}/data/append-dead")
        assert s.vacuum() == 0
        assert s.vacuum(intent_seconds=-5) == 1
    assert s.read().count() == 10


def test_later_columns_are_added_and_kept_by_merges(spark):
    s = store(spark)
    s.append(rows(spark, 20, 2))
    s.append(rows(spark, 20, 2, 100).selectExpr("doc_id", "doc_id * 2 as extra", "text"))
    s.compact()
    s.vacuum()
    got = {r.doc_id: r for r in s.read().collect()}
    assert s.read().columns == ["doc_id", "text", "shard", "version", "extra"] and len(got) == 40
    assert all(r.extra == (2 * i if i >= 100 else None) and r.version == (None if i >= 100 else "v") for i, r in got.items())
    for bad in ("cast(doc_id as string) as doc_id", "doc_id as DOC_ID"):
        with pytest.raises(ValueError):
            s.append(rows(spark, 1, 1).selectExpr(bad))
    assert s.read().count() == 40


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_placement_by_opening_each_file(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "BROADCAST_SHARDS", broadcast)
    s = store(spark)
    arrive(s, rows(spark, 900, 5), arrivals=3)
    version, want = max(s.versions()), Counter()
    for x in s.shards():
        path = f"{s.root}/data/{x.folder}/{x.name}".removeprefix("file:")
        ids = pq.read_table(path, columns=["doc_id"]).column(0).to_pylist()
        size = os.path.getsize(path)
        tier = 0
        while size >= 2_000 * 3 ** (tier + 1):
            tier += 1
        want.update((i, x.name, len(ids), size, tier, x.generation, version) for i in ids)
    assert Counter(map(tuple, s.placement().collect())) == want and sum(want.values()) == 900
