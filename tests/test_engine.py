"""Objects, layouts, graphs, merging, verification, journal and cache."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import binary, canonical
from palimpsest.operators import cache, graph, integrity, intervals, journal, merge, offsets, topology, transfer
from palimpsest.sources.objects import ObjectStore


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}")
    data = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),), (None,)], "data binary")
    assert store.put(data) == 2 and store.put(data) == 0
    key = canonical.digest(b"a")
    assert store.get(key) == b"a" and store.exists(key) and store.verify(key)
    assert store.hashes().count() == 2
    with pytest.raises(FileNotFoundError):
        store.get("00" * 32)
    assert not store.verify("00" * 32)
    wanted = spark.createDataFrame([(key,), ("00" * 32,)], "hash string")
    assert [r[0] for r in store.present(wanted).collect()] == [key]
    bad = spark.createDataFrame([("ff" + "0" * 62, 1, bytearray(b"x"), "ff")], "hash string, size bigint, data binary, shard string")
    bad.write.mode("append").partitionBy("shard").parquet(store.path)
    with pytest.raises(ValueError):
        store.get("ff" + "0" * 62)
    with pytest.raises(Exception, match="altered"):
        transfer.transfer(spark.createDataFrame([("ff" + "0" * 62,)], "hash string"), store.table()).collect()
    pruned = store.find(key)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in pruned or "PartitionFilters: [(shard" in pruned or "shard#" in pruned


def test_binary():
    rng = random.Random(1)
    a, b = rng.randbytes(1000), rng.randbytes(1000)
    assert binary.exclusive_or(a, binary.exclusive_or(a, b)) == b
    with pytest.raises(ValueError):
        binary.exclusive_or(b"a", b"ab")
    for data in (b"", a, b"x" * 5000):
        assert binary.decompress(binary.compress(data)) == data
    import zlib

    assert binary.decompress(bytes([binary.DEFLATE]) + zlib.compress(a)) == a and binary.compress(a) == bytes([binary.STORED]) + a
    with pytest.raises(ValueError):
        binary.decompress(b"\x09abc")
    assert binary.unpack_u64(binary.pack_u64(1 << 40)) == 1 << 40
    for dtype, (width, _) in binary.DTYPES.items():
        raw = bytes(width * 6) if dtype == "BOOL" else rng.randbytes(width * 6)
        x = binary.decode(raw, dtype, [2, 3])
        assert x.shape == (2, 3)
        if dtype not in ("F16", "BF16", "F32", "F64"):
            assert binary.encode(x, dtype) == raw
    assert binary.encode(binary.decode(b"\x80\x3f\x00\xc0", "BF16", [2]), "BF16") == b"\x80\x3f\x00\xc0"
    with pytest.raises(ValueError):
        binary.decode(b"", "F8", [0])


def test_canonical():
    assert canonical.canonical({"b": None, "a": [1, "é"]}) == b'{"a":[1,"\\u00e9"],"b":null}'
    commit = canonical.commit_bytes("m", ["p"], "msg", "me", 1.5)
    assert canonical.read_commit(commit) == {"manifest": "m", "parents": ["p"], "message": "msg", "author": "me", "at": 1.5}
    with pytest.raises(ValueError):
        canonical.read_commit(b'{"parents":[]}')
    assert canonical.read_manifest(b"{}") == {"tensors": {}, "metadata": {}, "header": None}
    assert canonical.read_manifest(canonical.manifest_bytes({"a": {}}, {"k": "v"}, "h")) == {"tensors": {"a": {}}, "metadata": {"k": "v"}, "header": "h"}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-500, 500), rng.randrange(9)) for _ in range(400)]
    rows = list({k: (k, n) for k, n in rows}.values())
    df = spark.createDataFrame(rows, "k long, n long")
    out = offsets.running_before(df, [F.col("k")], F.col("n"), offsets.number_buckets(df, "k", 7), "before").collect()
    total = 0
    for r in sorted(out, key=lambda r: r["k"]):
        assert r["before"] == total
        total += r["n"]
    assert offsets.running_before(df.limit(0), [F.col("k")], F.col("n"), offsets.number_buckets(df.limit(0), "k", 7), "before").count() == 0


def test_byte_ranges(spark):
    rng = random.Random(3)
    parts = [(i, rng.randbytes(rng.choice([0, 1, 7, 300, 5000]))) for i in range(60)]
    header = b"H" * 37
    whole = header + b"".join(d for _, d in parts)
    df = spark.createDataFrame([(i, bytearray(d), len(d)) for i, d in parts], "name long, data binary, size long")
    placed = intervals.layout(df, "name", "size", origin=len(header))
    total = intervals.file_size(placed, len(header))
    assert total == len(whole)
    asked = [(0, 8), (8, 200), (30, 40), (500, 1024), (0, len(whole)), (len(whole) - 3, 99), (len(whole), 5), (-1, 4), (5, 0)] + [(rng.randrange(total), rng.randrange(9000)) for _ in range(60)]
    requests = spark.createDataFrame([(i, o, s) for i, (o, s) in enumerate(asked)], "req_id long, offset long, size long")
    got = {r["req_id"]: bytes(r["data"]) for r in intervals.read_ranges(requests, placed, total, header).collect()}
    for i, (o, s) in enumerate(asked):
        assert got[i] == (whole[o : o + s] if o >= 0 and s > 0 else b"")
    gap = spark.createDataFrame([(4, 6, bytearray(b"ab"))], "start long, end long, data binary")
    assert bytes(intervals.read_ranges(requests.limit(0).unionAll(spark.createDataFrame([(1, 1, 9)], requests.schema)), gap, 8).first()["data"]) == b"\x00\x00\x00ab\x00\x00"


def test_overlap_pairs_come_once(spark):
    rng = random.Random(4)
    spans = [(i, a := rng.randrange(1000), a + rng.randrange(200)) for i in range(50)]
    asked = [(i, rng.randrange(1000), rng.randrange(150)) for i in range(50)]
    want = sorted((r, i) for r, o, s in asked for i, a, b in spans if s > 0 and b > a and o < b and a < o + s)
    met = intervals.overlaps(spark.createDataFrame(asked, "req_id long, offset long, size long"), spark.createDataFrame(spans, "id long, start long, end long"), 16)
    assert sorted((r["req_id"], r["id"]) for r in met.collect()) == want


def test_virtual_file():
    data = bytes(range(200))
    file = intervals.VirtualFile(lambda o, n: data[o : o + n], len(data))
    assert file.read(5) == data[:5] and file.tell() == 5
    assert file.seek(-10, os.SEEK_END) == 190 and file.read() == data[190:]
    assert file.seek(-500) == 0 and file.seek(3, os.SEEK_CUR) == 3
    with pytest.raises(ValueError):
        file.seek(0, 9)
    assert file.readable() and file.seekable() and not file.writable()
    file.close()
    assert file.closed


EDGES = [("m", 0, "l"), ("m", 1, "r"), ("l", 0, "base"), ("r", 0, "x"), ("x", 0, "base"), ("base", 0, "root"), ("other", 0, "alone")]


def by_hand(start, edges):
    found, queue = [start], [start]
    while queue:
        node = queue.pop(0)
        for _, parent in sorted((p, t) for c, p, t in edges if c == node):
            if parent not in found:
                found.append(parent)
                queue.append(parent)
    return found


@pytest.mark.parametrize("held_edges", [graph.HELD_EDGES, 0])
def test_history_and_ancestors(spark, monkeypatch, held_edges):
    """On a broadcast graph and level by level."""
    monkeypatch.setattr(graph, "HELD_EDGES", held_edges)
    rng = random.Random(5)
    edges = EDGES + [(f"n{i}", k, f"n{j}") for i in range(1, 40) for k, j in enumerate(rng.sample(range(i), min(i, rng.choice([1, 1, 2, 3]))))]
    df = spark.createDataFrame(edges, "child string, pos int, parent string")
    for start in ("m", "n39", "root"):
        rows = graph.history(spark.createDataFrame([(start,)], "node string"), df).orderBy("depth", "rank").collect()
        assert [r["node"] for r in rows] == by_hand(start, edges)
    pairs = [("m", "r"), ("l", "r"), ("r", "l"), ("m", "other"), ("n39", "n38"), ("n30", "n39"), ("root", "root")]
    out = graph.common_ancestors(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string"), df).collect()
    for r in out:
        above = set(by_hand(r["a"], edges))
        assert r["ancestor"] == next((n for n in by_hand(r["b"], edges) if n in above), None)
    seeds = [(0, "m"), (0, "l"), (0, "nowhere"), (1, "n5"), (1, "nowhere"), (2, None)]
    walked = graph.walk(spark.createDataFrame(seeds, "seed int, node string").where("node is not null"), df)
    assert {(r["seed"], r["node"]) for r in walked.where("depth = 0").collect()} == {s for s in seeds if s[1]}
    assert {r["node"] for r in walked.where("seed = 0").collect()} == {*by_hand("m", edges), "nowhere"} and walked.groupBy("seed", "node").count().where("count > 1").isEmpty()
    known = spark.createDataFrame([("l",), ("r",)], "node string")
    assert {r["node"] for r in graph.walk(spark.createDataFrame([(0, "m")], "seed int, node string"), df, known).collect()} == {"m", "l", "r"}


def test_long_history(spark):
    """A line of 10,000 commits with a fork near each end."""
    n = 10_000
    edges = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("pos"))
    edges = edges.unionAll(spark.createDataFrame([(n, 5, 0), (n + 1, n - 5, 0)], edges.schema))
    last = graph.history(spark.createDataFrame([(n - 1,)], "node long"), edges)
    assert last.agg(F.max("depth"), F.count("*")).first() == (n - 1, n)
    pairs = spark.range(1, n).select(F.col("id").alias("pair"), F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionAll(spark.createDataFrame([(n, n, n - 1), (n + 1, n + 1, n - 1)], "pair long, a long, b long"))
    out = graph.common_ancestors(pairs, edges)
    assert out.where("pair < 10000 and ancestor <> b").isEmpty() and {r["pair"]: r["ancestor"] for r in out.where("pair >= 10000").collect()} == {n: 5, n + 1: n - 5}
    with pytest.raises(ValueError, match="cycle"):
        graph.common_ancestors(pairs, spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "child long, parent long, pos int"))


def test_merge_truth_table(spark):
    values = [None, "x", "y", "z"]
    cases = list(itertools.product(values, repeat=3))
    side = lambda k: spark.createDataFrame([(i, c[k]) for i, c in enumerate(cases) if c[k] is not None], "name int, entry string")
    got = {r["name"]: r["entry"] for r in merge.three_way(side(0), side(1), side(2)).collect()}
    for i, (head, source, base) in enumerate(cases):
        if head is None and source is None:
            assert i not in got
        elif head == source:
            assert got[i] == head
        elif head == base and source is not None:
            assert got[i] == source
        elif source == base and head is not None:
            assert got[i] == head
        else:
            assert got[i] == (head if head is not None else source)


def test_verification(spark):
    good, altered = canonical.digest(b"good"), canonical.digest(b"before")
    objects = spark.createDataFrame([(good, bytearray(b"good")), (altered, bytearray(b"after"))], "hash string, data binary")
    refs = spark.createDataFrame([(good, "residual", 2), (good, "blob", 1), (altered, "blob", 1), ("gone", "blob", 1)], "hash string, type string, ord int")
    found = integrity.classify(refs, objects)
    assert {(r["hash"], r["type"], r["state"]) for r in found.collect()} == {(good, "blob", "ok"), (altered, "blob", "tampered"), ("gone", "blob", "missing")}
    assert integrity.report(found).first().asDict() == {"is_valid": False, "n_verified": 1, "n_missing": 1, "n_tampered": 1, "bytes_verified": 4}
    assert transfer.missing(refs, objects).collect()[0]["hash"] == "gone"


def test_journal(spark, tmp_path):
    log = journal.Journal(spark, f"file://{tmp_path}")
    first, second = log.begin("commit", {"x": 1}), log.begin("commit")
    log.record_blobs(first, spark.createDataFrame([("b1",), ("b2",), (None,), ("b1",)], "hash string"))
    log.mark_committed(second, "c")
    open_ = {r["tx_id"]: r for r in journal.open_transactions(log.events()).collect()}
    assert open_[first]["status"] == "PREPARING" and open_[first]["blobs"] == ["b1", "b2"] and open_[second]["status"] == "COMMITTED"
    assert log.recover(older_than=600) == {"n_aborted": 0, "n_completed": 0, "n_unreadable": 0}
    assert log.recover() == {"n_aborted": 1, "n_completed": 1, "n_unreadable": 0}
    assert log.recover() == {"n_aborted": 0, "n_completed": 0, "n_unreadable": 0}


def test_cache(spark):
    items = spark.createDataFrame([("a", 3, 10), ("b", 2, 10), ("c", 1, 10)], "item string, last long, size long")
    age = -F.col("last")
    rows = cache.resident(items, 20, F.floor(age / 2))
    assert {r["item"]: r["is_resident"] for r in rows.collect()} == {"a": True, "b": True, "c": False}
    assert cache.cache_stats(rows, 20).first()["utilization_pct"] == 100.0
    assert cache.resident(items, 5, F.lit(0)).where("is_resident").count() == 1


def test_recent_bytes():
    made = []
    held = cache.RecentBytes(10, lambda k: made.append(k) or k.encode() * 4)
    assert [held.get(k) for k in "abab"] == [b"aaaa", b"bbbb"] * 2 and made == ["a", "b"]
    held.get("c")  # the least recent one goes
    held.get("b")
    assert made == ["a", "b", "c"] and held.stats() == {"n_items": 2, "bytes": 8, "capacity": 10, "utilization_pct": 80.0}
    assert held.get("dddd") == b"dddd" * 4 and held.stats()["n_items"] == 1
    held.clear()
    assert held.stats()["bytes"] == 0


def test_binary_columns(spark):
    rng = random.Random(9)
    rows = [(i, bytearray(rng.randbytes(n)), bytearray(rng.randbytes(n))) for i, n in enumerate([0, 1, 9, 400] * 12)]
    rows += [(50, None, bytearray(b"a")), (51, bytearray(b"a"), None)]
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    out = {r["i"]: r["d"] for r in df.select("i", binary.decompress_column(binary.compress_column(binary.xor_column("a", "b"))).alias("d")).collect()}
    assert out == {i: None if a is None or b is None else binary.exclusive_or(bytes(a), bytes(b)) for i, a, b in rows}


def test_cost_rows(spark):
    import numpy as np

    from palimpsest.operators import similarity

    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8 if i % 7 else 5) for i in range(600)} | {600: np.zeros(8)}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(601, None), (602, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = {(r["target"], r["base"]): r["cost"] for r in similarity.cost_rows(df.where("id % 2 = 0"), df, "id", "v").collect()}
    want = {(t, b): 1 - x @ y / ((np.linalg.norm(x) + 1e-8) * (np.linalg.norm(y) + 1e-8)) for t, x in vectors.items() if t % 2 == 0 for b, y in vectors.items() if len(x) == len(y)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert similarity.cost_rows(df.limit(0), df, "id", "v").count() == 0


def test_topology(spark):
    shapes = {"conv1.weight": [32, 3, 3, 3], "bn1.weight": [32], "bn1.bias": [32], "bn1.running_mean": [32], "conv2.weight": [64, 32, 3, 3], "fc.weight": [10, 64], "fc.bias": [10], "extra10": [32]}
    tensors = spark.createDataFrame([("m", n, s) for n, s in shapes.items()], "model string, name string, shape array<bigint>")
    groups = topology.groups_of(tensors, "m")
    assert [(g.group_id, g.size, g.output, g.inputs) for g in groups] == [("perm_group_0_conv1", 32, [("conv1.weight", 0)], [("conv2.weight", 1)]), ("perm_group_1_conv2", 64, [("conv2.weight", 0)], [("fc.weight", 1)])]
    assert groups[0].vectors == ["bn1.weight", "bn1.bias", "bn1.running_mean", "extra10"]
    assert topology.Group.from_json(groups[0].to_json()) == groups[0]
    assert topology.groups_of(tensors, "m", {"permutation_groups": []}) == []


def test_streams(spark, tmp_path):
    from palimpsest.streaming.ingest import ingest_objects, transaction_states

    spark.createDataFrame([("a",), ("b",), ("a",)], "data string").write.parquet(f"{tmp_path}/in")
    store = ObjectStore(spark, f"file://{tmp_path}/store")
    ingest_objects(spark.readStream.schema("data string").parquet(f"{tmp_path}/in"), store, f"{tmp_path}/check").awaitTermination()
    assert store.hashes().count() == 2
    spark.createDataFrame([("t", 1, "PREPARING", "", 0.0, ""), ("t", 2, "BLOB", "", 0.0, ""), ("t", 3, "COMMITTED", "", 0.0, "")], journal.SCHEMA).write.parquet(f"{tmp_path}/log")
    run = transaction_states(spark.readStream.schema(journal.SCHEMA).parquet(f"{tmp_path}/log")).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from states").collect()] == [("t", "COMMITTED", 3)]
