"""The repository under two writers, damage, failures and stops between any two writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from palimpsest.functions import canonical
from palimpsest.functions.binary import encode
from palimpsest.operators import journal
from palimpsest.plans import repository as plans
from palimpsest.plans.repository import Repository, find_root
from palimpsest.sources import files, tensorfile
from palimpsest.sources.objects import ObjectStore


def model(seed, names=("fc1.weight", "fc1.bias")):
    rng = np.random.default_rng(seed)
    shapes = {n: [6, 4] if n.endswith("weight") else [6] for n in names}
    return {n: ("F32", s, encode(rng.normal(size=s), "F32")) for n, s in shapes.items()}


def put(path, tensors, metadata=None):
    path.write_bytes(tensorfile.serialize(tensors, metadata))
    return f"file://{path}"


def repository(spark, path):
    repo = Repository(spark, f"file://{path}")
    repo.init()
    return repo


def bytes_of(repo, commit, path):
    repo.materialize(commit, f"file://{path}")
    return path.read_bytes()


def test_two_writers_and_damage(spark, tmp_path):
    repo = repository(spark, tmp_path / "repo")
    first = put(tmp_path / "a", model(1), {"k": "v"})
    commit = repo.commit(first, "one").commit_id
    stored = repo.objects.table().where("size > 0").collect()
    n = repo.verify()["n_verified"]
    again = spark.createDataFrame([(r["hash"], r["size"], r["data"], r["shard"]) for r in stored], "hash string, size bigint, data binary, shard string")
    again.write.mode("append").partitionBy("shard").parquet(repo.objects.path)  # a second writer's
    again.withColumn("data", F.lit(b"damaged")).write.mode("append").partitionBy("shard").parquet(repo.objects.path)
    assert bytes_of(repo, commit, tmp_path / "out") == (tmp_path / "a").read_bytes()
    report = repo.verify()
    assert report["is_valid"] and report["n_verified"] == n and repo.objects.verify(stored[0]["hash"])
    assert repo.objects.shards().agg(F.sum("n_objects")).first()[0] == len(stored)

    only = repository(spark, tmp_path / "damaged")
    commit = only.commit(first).commit_id
    blob = only.entries().first()["blob_hash"]
    for path in only.objects.places(blob):
        files.delete(spark, path)
    with pytest.raises(Exception, match="missing or altered"):
        only.tensors(commit).collect()
    assert only.verify()["missing"] == [blob] and not only.verify()["is_valid"]
    spark.createDataFrame([(blob, 1, bytearray(b"x"), blob[:2])], "hash string, size bigint, data binary, shard string").write.mode("append").partitionBy("shard").parquet(only.objects.path)
    assert only.verify()["tampered"] == [blob]
    with pytest.raises(Exception, match="missing or altered"):
        only.tensors(commit).collect()


def test_incremental_pull_moves_three_objects(spark, tmp_path):
    repo, remote = repository(spark, tmp_path / "repo"), repository(spark, tmp_path / "remote")
    remote.commit(put(tmp_path / "a", model(1, ["fc1.weight"])), "one")
    assert repo.pull(remote) == 4  # commit, manifest, blob, header
    second = remote.commit(put(tmp_path / "b", model(2, ["fc1.weight"])), "two").commit_id
    assert repo.pull(remote) == 3  # commit, manifest, residual
    assert repo.pull(remote) == 0
    assert repo.branch_commit("main") == second and repo.verify()["is_valid"]
    assert bytes_of(repo, second, tmp_path / "out") == (tmp_path / "b").read_bytes()
    repo.checkout("main")
    third = repo.commit(put(tmp_path / "c", model(3, ["fc1.weight"]))).commit_id
    assert repo.push(remote) == 3 and remote.branch_commit("main") == third
    with pytest.raises(ValueError, match="no branch"):
        repo.pull(remote, "nowhere")


def test_pull_that_stops_anywhere_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    remote = repository(spark, tmp_path / "remote")
    remote.commit(put(tmp_path / "a", model(1)), "one")
    target = remote.commit(put(tmp_path / "b", model(2)), "two").commit_id
    whole, count = DataFrameWriter.parquet, [0, 0]

    def counted(self, *args, **kwargs):
        count[0] += 1
        if count[0] == count[1]:
            raise OSError("stopped")
        return whole(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    for stop in (3, 4, 5, 6):  # before objects, entries, commits and the branch; two writes of the journal come first
        repo = repository(spark, tmp_path / f"repo{stop}")
        count[:] = [0, stop]
        with pytest.raises(OSError):
            repo.pull(remote)
        count[1] = 0
        assert repo.branch_commit("main") is None
        repo.pull(remote)
        assert repo.branch_commit("main") == target and repo.verify()["is_valid"]
        assert repo.commits().count() == 2 and repo.entries().count() == remote.entries().count()
    assert bytes_of(repo, target, tmp_path / "out") == (tmp_path / "b").read_bytes()


def test_failed_commits_are_closed(spark, tmp_path, monkeypatch):
    repo = repository(spark, tmp_path / "repo")
    (tmp_path / "bad").write_bytes(b"\x05")
    with pytest.raises(ValueError):
        repo.commit(f"file://{tmp_path}/bad")
    assert journal.open_transactions(repo.journal.events()).isEmpty() and repo.head()[1] is None
    first = repo.commit(put(tmp_path / "a", model(1))).commit_id
    noted = {r["payload"] for r in repo.journal.events().where("status = 'BLOB'").collect()}
    assert noted == {r["hash"] for r in repo.objects.hashes().collect()} - {first}
    monkeypatch.setattr(Repository, "create_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        repo.commit(put(tmp_path / "b", model(2)))
    assert journal.open_transactions(repo.journal.events()).isEmpty() and repo.head()[1] == first
    assert repo.orphans().count() > 0 and repo.verify()["is_valid"]


def test_recovery_cleans_what_crashed_writers_left(spark, tmp_path):
    repo = repository(spark, tmp_path / "repo")
    commit = repo.commit(put(tmp_path / "a", model(1))).commit_id
    repo.journal.begin("commit")
    (tmp_path / "repo" / "objects" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "repo" / "out.part").write_bytes(b"half")
    assert repo.recover(older_than=600) == {"n_aborted": 0, "n_completed": 0, "n_unreadable": 0, "n_temporary": 0}
    assert repo.recover() == {"n_aborted": 1, "n_completed": 0, "n_unreadable": 0, "n_temporary": 2}
    assert repo.recover() == {"n_aborted": 0, "n_completed": 0, "n_unreadable": 0, "n_temporary": 0}
    assert repo.verify()["is_valid"] and bytes_of(repo, commit, tmp_path / "out") == (tmp_path / "a").read_bytes()


def test_long_chains_of_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "CHAIN", 1)
    repo = repository(spark, tmp_path / "repo")
    for k in range(3):
        last = repo.commit(put(tmp_path / f"m{k}", model(k, ["fc1.weight"]))).commit_id
    assert bytes_of(repo, last, tmp_path / "out") == (tmp_path / f"m{k}").read_bytes()
    file = repo.open(last)
    file.seek(8)
    assert file.read(40) == (tmp_path / f"m{k}").read_bytes()[8:48]
    assert [r["depth"] for r in repo.log().collect()] == list(range(3))


def test_paths_and_roots(spark, tmp_path):
    repo = repository(spark, tmp_path / "repo")
    os.makedirs(tmp_path / "repo" / "below" / "it")
    assert find_root(spark, f"file://{tmp_path}/repo/below/it") == f"file://{tmp_path}/repo"
    assert find_root(spark, f"{tmp_path}/repo") == f"{tmp_path}/repo" and find_root(spark, f"file://{tmp_path}") is None
    path = f"file://{tmp_path}/with space.tensors"
    files.write(spark, path, iter([b"abc", b"", b"def" * 10]))
    files.write(spark, path, iter([b"0123456789"]))
    assert files.read(spark, path, 3, 4) == b"3456" and files.read(spark, path, 8) == b"89" and files.read(spark, path, 20, 5) == b""
    assert sorted(n for _, n, _ in files.children(spark, f"file://{tmp_path}")) == ["repo", "with space.tensors"]
    assert files.children(spark, f"file://{tmp_path}/none") == [] and not files.exists(spark, f"file://{tmp_path}/none")
    with pytest.raises(RuntimeError):
        files.write(spark, path, failing())
    assert files.read(spark, path) == b"0123456789" and not files.exists(spark, f"{path}.part")
    assert repo.head() == ("main", None)


def failing():
    yield b"some"
    raise RuntimeError("stopped")


def test_tensors_are_read_by_ranges(spark, tmp_path, monkeypatch):
    first, second = model(1), model(2, ["x.weight", "y.bias"])
    put(tmp_path / "a.tensors", first)
    put(tmp_path / "b.tensors", second)
    rows = tensorfile.read_tensors(spark, f"file://{tmp_path}/*.tensors").collect()
    assert {(os.path.basename(r["model"]), r["name"]): bytes(r["data"]) for r in rows} == {(f, n): d for f, m in (("a.tensors", first), ("b.tensors", second)) for n, (_, _, d) in m.items()}
    monkeypatch.setattr(files, "by_ranges", lambda path: False)
    assert {r["name"]: bytes(r["data"]) for r in tensorfile.read_tensors(spark, f"file://{tmp_path}/a.tensors").collect()} == {n: d for n, (_, _, d) in first.items()}
    broken = (tmp_path / "a.tensors").read_bytes()[:-3]
    (tmp_path / "c").write_bytes(broken)
    monkeypatch.undo()
    with pytest.raises(Exception, match="cut off"):
        tensorfile.read_tensors(spark, f"file://{tmp_path}/c").collect()


def test_store_reads_each_hash_once(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}")
    key = canonical.digest(b"a")
    rows = [(key, 1, bytearray(b"b"), key[:2]), (key, 1, bytearray(b"a"), key[:2]), (key, 1, bytearray(b"a"), key[:2])]
    spark.createDataFrame(rows, "hash string, size bigint, data binary, shard string").write.partitionBy("shard").parquet(store.path)
    assert store.get(key) == b"a" and store.verify(key) and store.contents().count() == 1
    assert store.put_bytes(b"a") == [key] and store.table().count() == 3
