"""Token store, rank-array BPE, packing and attribution against the tokenizers library and brute force."""

import hashlib
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import attribution, bpe, packing, store, wordids


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aéÀß'.s1 \t\ń<|endoftx>", max_size=40)), max_size=6))
def test_words_give_the_librarys_ids(vocabulary, library, texts):
    for table in (wordids.library_table(vocabulary), bpe.ranked_table(vocabulary)):
        ids, bounds = wordids.encode_texts(pa.array(texts, pa.string()), table)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(library, t) for t in texts]


def test_scan_and_heap_agree(vocabulary, library):
    array = bpe.ranked_table(vocabulary).encode.array
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 90)))
        assert array._scan(array.parts(word)) == array._heap(array.parts(word)) == ids_of(library, word)


def test_bpe_digests(spark, odd, sample, vocabulary, library):
    for docs in (odd, sample):
        texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        want = set()
        for key, text in texts:
            ids = ids_of(library, text)
            want.add((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert set(map(tuple, bpe.round_trip_digests(docs, vocabulary).collect())) == want
    encoded = bpe.encode_documents(odd, vocabulary)
    assert {(r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, vocabulary).collect()} == {(k, library.decode(ids_of(library, t), skip_special_tokens=False)) for k, t in {(r["doc_id"], r["text"]) for r in odd.collect()}}


def test_store_round_trip(spark, odd, sample, vocabulary, library, tmp_path):
    for name, docs in (("odd", odd), ("sample", sample)):
        folder = f"file://{tmp_path}/{name}"
        store.write_store(docs, folder, vocabulary)
        rows = docs.select("doc_id", "text").collect()
        ids = sorted(((r["doc_id"], np.array([*ids_of(library, r["text"]), 1], dtype="<u4").tobytes()) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        read = store.read_documents(spark, folder).orderBy("part", "row").collect()
        assert [r["doc_id"] for r in read] == [k for k, _ in ids]
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in read) == sorted((str(k), len(b) // 4, zlib.crc32(b)) for k, b in ids)
        assert [r["start"] for r in read] == np.cumsum([0, *(r["n_tokens"] for r in read)])[:-1].tolist()
        whole = {(str(r["doc_id"]), np.frombuffer(r["ids"], dtype="<u2").astype("<u4").tobytes()) for r in store.reconstruct(spark, folder).collect()}
        assert whole == {(str(k), b) for k, b in ids}
        assert all(r["intact"] for r in store.verify_roots(spark, folder).collect())
        chunks = spark.read.schema(store.RAW).parquet(f"{folder}/objects").where("kind = 'chunk'")
        assert chunks.count() == chunks.select("key").distinct().count()


def test_store_finds_damage(spark, sample, vocabulary, tmp_path):
    folder = f"file://{tmp_path}/store"
    store.write_store(sample, folder, vocabulary)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    changed = [(r["part"], r["documents"], r["n_tokens"], bytearray(b"\x00" * 16)) for r in manifest]
    spark.createDataFrame(changed, "part int, documents long, n_tokens long, root binary").write.mode("overwrite").parquet(f"{folder}/manifest")
    assert not any(r["intact"] for r in store.verify_roots(spark, folder).collect())
    spark.createDataFrame([("chunk", bytearray(b"\x01" * 16), bytearray(b"\x05\x00"))], "kind string, key binary, body binary").write.mode("append").partitionBy("kind").parquet(f"{folder}/objects")
    with pytest.raises(Exception, match="does not match its digest"):
        store.read_documents(spark, folder).count()


def test_store_finds_lost_and_repeated_rows(spark, sample, vocabulary, tmp_path):
    whole = f"file://{tmp_path}/whole"
    store.write_store(sample, whole, vocabulary)
    recipes, manifest = (spark.read.parquet(f"{whole}/{x}") for x in ("recipes", "manifest"))
    part = manifest.first()["part"]
    here = f"part = {part}"
    first = recipes.where(f"{here} and row = 0")
    damaged = {
        "lost row": (recipes.where(f"not ({here} and row = 1)"), manifest),
        "repeated row": (recipes.unionAll(first), manifest),
        "moved row": (recipes.withColumn("start_in_part", F.expr(f"start_in_part + if({here} and row = 1, 1L, 0L)")), manifest),
        "lost part": (recipes.where(f"not ({here})"), manifest),
        "part not in the manifest": (recipes, manifest.where(f"not ({here})")),
        "repeated manifest row": (recipes, manifest.unionAll(manifest.where(here))),
    }
    for name, tables in damaged.items():
        folder = f"{tmp_path}/{name.replace(' ', '-')}"
        shutil.copytree(f"{tmp_path}/whole/objects", f"{folder}/objects")
        for table, kind in zip(tables, ("recipes", "manifest"), strict=True):
            table.write.parquet(f"file://{folder}/{kind}")
        with pytest.raises(ValueError, match=f"part {part} does not match"):
            store.read_documents(spark, f"file://{folder}").count()
    spark.createDataFrame([("chunk", bytearray(b"\x01" * 16), bytearray(b"\x05\x00"))], "kind string, key binary, body binary").write.mode("append").partitionBy("kind").parquet(f"{whole}/objects")
    with pytest.raises(Exception, match="chunk 0101.* does not match its digest"):
        store.read_documents(spark, whole).count()


def test_store_of_nothing(spark, empty, vocabulary, tmp_path):
    folder = f"file://{tmp_path}/none"
    store.write_store(empty, folder, vocabulary)
    assert store.read_documents(spark, folder).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 40000, 30000).astype(np.uint32)
    edges = [store.chunk_bounds(ids, np.array([0, len(ids)]))[0] for ids in (passage, np.concatenate([rng.integers(0, 40000, 777).astype(np.uint32), passage]))]
    assert all(store.LEAST <= b - a <= store.MOST for a, b in zip(edges[0][:-1], edges[0][1:-1]))
    assert len(set(edges[0]) & {e - 777 for e in edges[1]}) > 0.9 * len(edges[0])


@given(st.lists(st.binary(max_size=50), max_size=8))
@settings(deadline=None)
def test_joined_crc32(parts):
    assert store.joined_crc32([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def check_packing(pieces, capacity):
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist()
        assert sum(n for _, n in held) <= capacity
    return len(bins)


def test_packing(spark, odd, sample, empty, vocabulary, library):
    for docs, capacity in ((odd, 16), (sample, 4096)):
        out = packing.pack_documents(docs, vocabulary, capacity).collect()
        want = []
        for key, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
            ids = np.array([*ids_of(library, text), 1], dtype="<u4")
            want += [(str(key), k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
        bins = check_packing(out, capacity)
        assert bins <= -(-sum(w[3] for w in want) // capacity) * 1.02 + 1
    assert packing.pack_documents(empty, vocabulary).count() == 0
    placed = packing.pack_documents(sample, vocabulary)
    total = sum(len(r["ids"]) for r in packing.sequences(sample, placed, vocabulary).collect())
    assert total == sum(r["length"] for r in placed.collect())


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=12))
@settings(deadline=None, max_examples=60)
def test_minimum_bin_slack_places_all(histogram):
    rows, bins = packing.minimum_bin_slack(histogram, 40)
    assert bins >= -(-sum(k * v for k, v in histogram.items()) // 40)
    used = {}
    for length, first, _, times, _ in rows:
        assert used.get(length, 0) == first
        nxt = [r for r in rows if r[0] == length and r[1] > first]
        used[length] = min((r[1] for r in nxt), default=histogram[length])
    assert used == histogram


def test_fullest_is_optimal():
    counts = {7: 2, 5: 3, 4: 1}
    sums = {a * 7 + b * 5 + c * 4 for a in range(3) for b in range(4) for c in range(2)}
    for room in range(1, 40):
        taken = packing.fullest(room, [7, 5, 4], counts)
        assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in taken.items())


def test_attribution(spark, odd, sample, empty):
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    encoding, _ = attribution.byte_encoding(path, pattern)
    for docs in (odd, sample):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        for rule in ("start", "majority", "proportional"):
            rows = attribution.section_tokens(docs, path, pattern, rule).collect()
            for key, held in texts.items():
                own = [r for r in rows if r["doc_id"] == key]
                assert sum(r["n_tokens"] for r in own) == pytest.approx(sum(len(encoding.encode_ordinary(t)) for t in held))
                if len(held) == 1:
                    lines = held[0].splitlines(keepends=True) if set(held[0]).isdisjoint("\r\x0b\x0c\x1c\x1d\x1e\x85  ") else None
                    assert lines is None or [(r["start_char"], r["end_char"]) for r in sorted(own, key=lambda r: r["section"])] == ([(a, b) for a, b in zip(np.cumsum([0, *map(len, lines)]), np.cumsum([*map(len, lines)]))] or [(0, 0)])
    assert attribution.section_tokens(empty, path, pattern).count() == 0
    with pytest.raises(ValueError):
        attribution.section_tokens(empty, path, pattern, "other")


def test_attribution_of_crossing_tokens():
    ends, bounds = np.array([2, 6, 9]), np.array([0, 3, 5, 9])
    assert attribution.attributed(ends, bounds, "start")[0].tolist() == [2, 0, 1]
    assert attribution.attributed(ends, bounds, "majority")[0].tolist() == [1, 1, 1]
    assert attribution.attributed(ends, bounds, "proportional")[0].tolist() == [1.25, 0.5, 1.25]
    assert attribution.attributed(ends, bounds, "start")[1].tolist() == [1, 0, 0]
