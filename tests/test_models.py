"""Assignment, alignment, residuals, files and the repository."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.assignment import assign
from palimpsest.functions.binary import decode, encode
from palimpsest.operators import alignment
from palimpsest.operators.topology import Group
from palimpsest.plans.repository import Repository
from palimpsest.sources import tensorfile


def mlp(seed=42, sizes=(24, 32, 32, 8), dtype="F16"):
    rng = np.random.default_rng(seed)
    out = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:]), 1):
        out[f"fc{k}.weight"], out[f"fc{k}.bias"] = rng.normal(size=(b, a)) / 4, rng.normal(size=b) / 4
    return {n: (dtype, list(x.shape), encode(x, dtype)) for n, x in out.items()}


def shuffled(model, seed=99, noise=0.0):
    rng = np.random.default_rng(seed)
    x = {n: decode(d, t, s).astype(float) for n, (t, s, d) in model.items()}
    for k in (1, 2):
        perm = rng.permutation(len(x[f"fc{k}.bias"]))
        x[f"fc{k}.weight"], x[f"fc{k}.bias"] = x[f"fc{k}.weight"][perm], x[f"fc{k}.bias"][perm]
        x[f"fc{k + 1}.weight"] = x[f"fc{k + 1}.weight"][:, perm]
    return {n: ("F16", list(v.shape), encode(v + noise * rng.normal(size=v.shape), "F16")) for n, v in x.items()}


def frame(spark, model):
    return spark.createDataFrame([(n, t, s, bytearray(d)) for n, (t, s, d) in model.items()], alignment.TENSOR)


def write(path, model, metadata=None):
    path.write_bytes(tensorfile.serialize(model, metadata))
    return str(path)


def test_assignment():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 6):
        for _ in range(15):
            cost = rng.integers(-4, 9, (n, n)).astype(float)
            found = assign(cost)
            assert sorted(found) == list(range(n))
            assert cost[np.arange(n), found].sum() == min((sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))), default=0)
    planted = np.ones((10, 10))
    planted[np.arange(10), np.roll(np.arange(10), 2)] = 0
    assert assign(planted).tolist() == np.roll(np.arange(10), 2).tolist()
    with pytest.raises(ValueError):
        assign(np.ones((2, 3)))


def test_cost_matrix():
    rng = np.random.default_rng(2)
    base, target = rng.normal(size=(5, 7)), rng.normal(size=(5, 7))
    b, t = rng.normal(size=5), rng.normal(size=5)
    total, primary = alignment.cost_matrix(base, target, [b], [t])
    for k in range(5):
        for j in range(5):
            cosine = target[k] @ base[j] / np.linalg.norm(target[k]) / np.linalg.norm(base[j])
            assert primary[k, j] == pytest.approx(1 - cosine, abs=1e-5)
            gap = (t[:, None] - b[None]) ** 2
            assert total[k, j] == pytest.approx(1 - cosine + 0.5 * gap[k, j] / gap.max(), abs=1e-5)


def test_alignment_is_lossless(spark):
    base = mlp()
    target = shuffled(base, noise=5e-4)
    entries, perms, facts = alignment.align_and_diff(frame(spark, base), frame(spark, target))
    entries = entries.persist()
    stats = alignment.statistics(entries, facts)
    assert stats["is_alignable"] and stats["mean_confidence"] > 0.7 and stats["num_permutation_groups"] == 2
    back = {r["name"]: bytes(r["data"]) for r in alignment.restored(entries, frame(spark, base), perms).collect()}
    assert back == {n: d for n, (_, _, d) in target.items()}
    exact = alignment.align_and_diff(frame(spark, base), frame(spark, shuffled(base)))
    assert alignment.statistics(exact[0], exact[2])["residual_ratio"] < 0.2


def test_changed_types_and_shapes_are_stored_whole(spark):
    base = mlp()
    target = dict(base)
    target["fc1.bias"] = ("I16", [32], bytes(64))
    target["fc2.bias"] = ("F16", [16], bytes(32))
    target["new"] = ("F32", [], bytes(4))
    entries = alignment.deltas(frame(spark, base), frame(spark, target), {})
    assert {r["name"] for r in entries.where("not is_delta").collect()} == {"fc1.bias", "fc2.bias", "new"}


def test_rebasin_and_interpolation(spark):
    base = mlp(dtype="F32")
    target = {n: ("F32", s, encode(decode(d, "F16", s), "F32")) for n, (_, s, d) in shuffled(base).items()}
    moved, perms = alignment.rebasin(frame(spark, base), frame(spark, target))
    moved = moved.persist()
    for r in moved.collect():
        assert np.allclose(decode(bytes(r["data"]), "F32", r["shape"]), decode(base[r["name"]][2], "F32", r["shape"]), atol=2e-3)
    other = mlp(7, dtype="F32")
    del other["fc3.bias"]
    mixed = {r["name"]: bytes(r["data"]) for r in alignment.interpolate(frame(spark, base), frame(spark, other), 0.5).collect()}
    for n, (_, s, d) in base.items():
        a = decode(d, "F32", s)
        want = 0.5 * a + 0.5 * decode(other[n][2], "F32", s) if n in other else a
        assert np.allclose(decode(mixed[n], "F32", s), want, atol=1e-6)


def test_stated_groups(spark):
    base = mlp()
    group = Group("g", 32, [("fc1.weight", 0)], ["fc1.bias"], [("fc2.weight", 1)])
    import json

    _, perms, facts = alignment.align_and_diff(frame(spark, base), frame(spark, shuffled(base)), {"permutation_groups": [json.loads(group.to_json())]})
    assert [f["group_id"] for f in facts] == ["g"] and set(perms) == {"fc1.weight", "fc1.bias", "fc2.weight"}


def test_files(spark, tmp_path):
    model = mlp() | {"half": ("BF16", [2], b"\x80\x3f\x00\xc0"), "none": ("F32", [0], b"")}
    path = write(tmp_path / "m.tensors", model, {"k": "v"})
    at, header = tensorfile.read_header(path)
    assert header["__metadata__"] == {"k": "v"} and list(tensorfile.tensor_entries(header)) == sorted(model)
    assert tensorfile.load_tensor(path, "half") == ("BF16", [2], b"\x80\x3f\x00\xc0")
    with pytest.raises(KeyError):
        tensorfile.load_tensor(path, "absent")
    for bad, error in ((b"123", ValueError), (7, TypeError)):
        with pytest.raises(error):
            tensorfile.parse_header(bad)
    rows = tensorfile.read_tensors(spark, f"file://{path}")
    assert {r["name"]: (r["dtype"], r["shape"], bytes(r["data"])) for r in rows.collect()} == model
    tensorfile.register(spark)
    source = spark.read.format("tensorfile").load(path)
    assert {r["name"]: bytes(r["data"]) for r in source.collect()} == {n: d for n, (_, _, d) in model.items()}
    one = source.where(F.col("name") == "half")
    assert one.rdd.getNumPartitions() == 1 and bytes(one.first()["data"]) == b"\x80\x3f\x00\xc0"
    tensorfile.write_tensors(rows, str(tmp_path / "copy"), {"k": "v"})
    assert (tmp_path / "copy").read_bytes() == (tmp_path / "m.tensors").read_bytes()


def test_repository(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.init()
    assert repo.head() == ("main", None) and repo.verify()["is_valid"]
    base = mlp()
    first_path = write(tmp_path / "a", base, {"z": "1", "a": "2"})
    second_path = write(tmp_path / "b", shuffled(base, noise=5e-4))
    first = repo.commit(first_path, "first")
    second = repo.commit(second_path, "second")
    assert second.statistics["num_deltas"] == 6
    for commit, path in ((first, first_path), (second, second_path)):
        repo.materialize(commit.commit_id, str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes() == open(path, "rb").read()
    whole = open(second_path, "rb").read()
    file = repo.open(second.commit_id)
    file.seek(100)
    assert file.read(3000) == whole[100:3100]
    assert [r["message"] for r in repo.log().collect()] == ["second", "first"]
    report = repo.verify()
    assert report["is_valid"] and report["missing"] == [] and report["tampered"] == []
    assert repo.recover() == {"n_aborted": 0, "n_completed": 0, "n_unreadable": 0, "n_temporary": 0}

    remote = Repository(spark, f"file://{tmp_path}/other")
    remote.init()
    assert remote.pull(repo) == remote.objects.hashes().count() and remote.pull(repo) == 0
    assert remote.verify()["is_valid"]

    repo.branch("side")
    edited = dict(shuffled(base, noise=5e-4))
    edited["fc1.bias"] = ("F16", [32], bytes(64))
    repo.commit(write(tmp_path / "c", edited), "edit", base="main")
    repo.checkout("side")
    added = dict(shuffled(base, noise=5e-4)) | {"new": ("F32", [1], b"abcd")}
    repo.commit(write(tmp_path / "d", added), "add", base="side")
    status, merged = repo.merge("main")
    assert status == "Merged" and repo.log().count() == 5
    tensors = {r["name"]: bytes(r["data"]) for r in repo.tensors(merged).collect()}
    assert tensors["new"] == b"abcd" and tensors["fc1.bias"] == bytes(64) and tensors["fc2.weight"] == added["fc2.weight"][2]
    assert repo.merge("main")[0] == "Already-up-to-date"
    repo.checkout("main")
    assert repo.merge("side") == ("Fast-forward", merged)
    assert repo.branches() == ["main", "side"]
    with pytest.raises(ValueError):
        repo.checkout("nowhere")
    assert repo.push(remote) > 0 and remote.branch_commit("main") == merged


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    run = lambda *a: main(["-r", f"file://{tmp_path}/repo", *a], spark)
    base = mlp()
    first = write(tmp_path / "a", base)
    assert run("init") == 0 and run("commit", first, "-m", "one") == 0
    commit = capsys.readouterr().out.split()[0]
    assert run("branch", "side") == 0 and run("branch") == 0
    assert capsys.readouterr().out.split() == ["*", "main", "side"]
    assert run("log") == 0 and "one" in capsys.readouterr().out
    assert run("verify") == 0 and run("ls") == 0
    assert f"{len(open(first, 'rb').read())} model" in capsys.readouterr().out
    assert run("checkout", commit, "-o", str(tmp_path / "out")) == 0
    assert (tmp_path / "out").read_bytes() == open(first, "rb").read()
    (tmp_path / "c.json").write_text('{"d_in": 1}')
    from palimpsest.operators.topology import read_config

    assert read_config(spark, f"file://{tmp_path}/c.json") == {"d_in": 1} and read_config(spark, f"file://{tmp_path}/none") == {}


def test_rebasin_command(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    base = mlp()
    repo.rebasin(write(tmp_path / "a", base), write(tmp_path / "b", shuffled(base)), str(tmp_path / "mix"), 0.5)
    assert tensorfile.read_header(str(tmp_path / "mix"))[1]["__metadata__"] == {"rebasin": "true", "alpha": "0.5"}
    for n, (t, s, d) in base.items():
        assert np.allclose(decode(tensorfile.load_tensor(str(tmp_path / "mix"), n)[2], t, s).astype(float), decode(d, t, s).astype(float), atol=2e-3)
