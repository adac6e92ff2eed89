"""Near duplicates, repeated passages and embeddings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, embeddings, minhash, substring, words
from palimpsest.llm.staging import Staging

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text, k):
    held = (text or "").encode().translate(LOWER).split()
    return {tuple(held[i : i + k]) for i in range(len(held) - k + 1)} if len(held) >= k else ({tuple(held)} if held else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies(seed=5):
    """Chains of edits, exact copies, groups around the threshold and unlike texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 160))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 6)):
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), "solo", "SOLO", "", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates(spark, odd):
    rows = near_copies()
    for docs, rows, k in ((spark.createDataFrame(rows, "doc_id long, text string"), rows, 4), (odd, [tuple(r)[:2] for r in odd.select("doc_id", "text").collect()], 5)):
        sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
        ids = sorted(sets)
        links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = roots(ids, links)
        out = minhash.near_duplicates(docs, k, 80).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_nothing(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_blocks_of_repeated_rows(spark):
    """Rows of one id and text that fill several blocks: each block has its own name, and the link is found."""
    text = {1: " ".join(f"w{i}" for i in range(40)), 2: " ".join(f"w{i}" for i in range(42))}
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "grp long, doc_id long, root long")
    texts = spark.createDataFrame([(i, t) for i, t in text.items()] * (2 * minhash.BLOCK), "doc_id long, text string")
    staging = Staging(spark, "test")
    links = minhash.links_between(members, texts, 4, 80, staging).collect()
    blocks = staging.read("blocks")
    assert blocks.count() == blocks.select("block").distinct().count() == 4
    assert {frozenset(r) for r in links} == {frozenset((1, 2))} and len(links) == 4


def plain_super_min_hash(elements, places):
    """The definition: every element visits all places in the order of its permutation."""
    out = np.full(places, np.iinfo(np.uint64).max, dtype=np.uint64)
    for e in elements:
        one = np.array([e], dtype=np.uint64)
        perm = list(range(places))
        for j in range(places):
            draw = int(words.mixed(one ^ np.uint64(0x6A09E667F3BCC909) if j == 0 else one + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0])
            k = j + ((draw >> 32) * (places - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(int(out[perm[j]]), j << 32 | draw & 0xFFFFFFFF)
    return out


def test_super_min_hash_stops_early_without_loss():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 7, 40, 300)]
    bounds = np.cumsum([0, *map(len, sets)])
    found = minhash.super_min_hash(np.concatenate(sets), bounds, 32)
    for row, elements in zip(found, sets):
        assert np.array_equal(row, plain_super_min_hash(elements, 32))


def test_super_min_hash_estimates():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (80, 10, 10))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        s = minhash.super_min_hash(np.concatenate([x, y]), np.array([0, 90, 180]))
        errors.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), Staging(spark, "test"), "c")
    want = roots({n for link in links for n in link}, links)
    assert {r["node"]: r["root"] for r in found.collect()} == {n: r for n, r in want.items() if n != r}


def cut_by_hand(rows, window):
    order = sorted(rows, key=lambda r: r[0])
    starts = {}
    out = []
    for key, text in order:
        held = (text or "").encode().split()
        gone = [False] * len(held)
        for i in range(len(held) - window + 1):
            run = tuple(held[i : i + window])
            if starts.setdefault(run, (key, i)) < (key, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(held, gone) if not g)
        out.append((key, len(held), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=11):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice(" \n\t").join(parts))
    return list(enumerate([*texts, "a b " * 40, "a", "", None, texts[5]]))


@pytest.mark.parametrize("window", [5, 20])
def test_substrings(spark, window):
    rows = passages()
    cut = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), window)
    assert sorted(map(tuple, cut.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect())) == cut_by_hand(rows, window)


def test_substrings_of_odd_rows(spark, odd, empty):
    out = substring.cut_repeats(odd, 4)
    assert out.columns == [c for c in odd.columns if c != "cut"] + ["cut"]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["cut"]["n_words"], r["cut"]["n_removed"]) for r in out.collect()))
    rows = {(1 << 62 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd.collect()}
    want = sorted([(k == 1 << 62, 0 if k == 1 << 62 else k, n, m) for k, n, m, _ in cut_by_hand(rows, 4)] + [(False, 3, 1, 0)])
    assert got == want
    assert substring.cut_repeats(empty, 20).count() == 0
    untouched = [r for r in out.collect() if r["cut"]["n_removed"] == 0]
    assert all(r["cut"]["kept_text"] == r["text"] for r in untouched)


def test_word_hashes():
    texts = ["Ab\x0bcd  ef\x1cg", "", None, "x" * 5000, "AB cd"]
    w = words.Words(pa.array(texts), lower=True)
    assert [w.word(i) for i in range(len(w.starts))] == [b"Ab", b"cd", b"ef\x1cg", b"x" * 5000, b"AB", b"cd"]
    assert w.hashes[0] == w.hashes[4] and w.hashes[1] == w.hashes[5] and len(set(w.hashes.tolist())) == 4


def vectors_by_hand(rows, least):
    good = [(k, np.array(v, dtype=float)) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {}, []
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links.append((a, b))
                n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return n, roots({k for k, _ in rows if k is not None}, links)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 40)
    rng = np.random.default_rng(6)
    rows = []
    for centre in rng.normal(size=(40, 8)):
        rows += [(centre + rng.normal(size=8) * s).tolist() for s in rng.uniform(0, 0.5, 6)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 8, None, [], [float("nan")] * 8, [None, *[1.0] * 7], [1.0, 2.0], [2.0, 4.0]]
    rows = [*enumerate(rows), (None, rows[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    n, want = vectors_by_hand(rows, 0.9)
    out = embeddings.near_vectors(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(r["vec_id"], 0), want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    clash = df.withColumns({c: F.lit(c) for c in ("v", "h1", "h2", "rep", "mult", "home", "near", "cell", "salt", "links", "node", "root", "label")})
    assert sorted(map(str, embeddings.near_vectors(clash).collect())) == sorted(map(str, out))
    assert embeddings.recall(embeddings.near_vectors(df, margin=0.3), df.where("vec_id is not null")) >= 0.9
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_extreme_size(spark):
    rows = [[1e200, 1e200], [1e200, 1.1e200], [1e200, -1e200], [1e-200, 1e-200], [3e-320, 3e-320], [1e-200, -1e-200], [1.0, 1.0]]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert out == {0: (4, 0), 1: (4, 0), 3: (4, 0), 4: (4, 0), 6: (4, 0), 2: (1, 2), 5: (1, 2)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_without_structure_are_staged_once(spark, monkeypatch, kind):
    """Also a group of near copies, that is larger than a block, and small blocks and tiles."""
    staged, write = {}, Staging.write

    def counting(self, df, name, *args, **kwargs):
        out = write(self, df, name, *args, **kwargs)
        if name == "blocks":
            staged[name] = out.agg(F.sum(F.octet_length("reps") / 8)).first()[0]
        return out

    monkeypatch.setattr(Staging, "write", counting)
    monkeypatch.setattr(embeddings, "PER_CELL", 200)
    monkeypatch.setattr(embeddings, "BLOCK", 256)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 24)) * 0.3, x[7] + rng.normal(size=(400, 24)) * 0.05]).astype("<f4")
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    n, want = vectors_by_hand(rows, 0.9)
    out = embeddings.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (n.get(i, 0), want[i]) for i, _ in rows}
    assert staged["blocks"] == len(x)
