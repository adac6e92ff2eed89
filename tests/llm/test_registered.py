"""The registered queries: one of each number, whole tables, and the contract's columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

COLUMNS = {
    1: {"doc_id", "start", "n_tokens", "ids_crc32"},
    2: {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    3: {"doc_id", "n_shingles", "component_id", "kept"},
    4: {"doc_id", "n_words", "n_removed", "kept_sha256"},
    5: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    6: {"vec_id", "n_links", "component_id", "kept"},
    7: {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    8: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    9: {"doc_id", "held_out", "lang_pred", "score"},
    10: {"doc_id", "section", "n_tokens"},
}
FOLDER = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.fixture(scope="module")
def results(spark):
    """The full results of all registered queries."""
    return {int(m[1]): query(spark, FOLDER).collect() for name, query in entry.queries().items() if (m := re.match(r"op(\d+)_", name))}


def test_columns_and_rows(spark, results):
    documents, vectors = table(spark, "documents").count(), table(spark, "embeddings").count()
    for number, columns in COLUMNS.items():
        assert columns <= set(results[number][0].asDict())
    assert {n: len(results[n]) for n in (1, 3, 4, 5, 7, 9)} == dict.fromkeys((1, 3, 4, 5, 7, 9), documents)
    assert len(results[6]) == vectors and len(results[2]) == table(spark, "conversations").select("conv_id").distinct().count() + 1


def test_ids_against_the_library(spark, results, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for k, t in texts.items()}
    start, starts = 0, {}
    for k in sorted(ids):
        starts[k], start = start, start + len(ids[k])
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in results[1]} == {(k, starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in ids.items()}
    assert {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in results[5]} == {(k, len(x) - 1, hashlib.sha256(library.decode(x[:-1].tolist(), skip_special_tokens=False).encode()).hexdigest()) for k, x in ids.items()}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in results[8]} == {(k, a // 4096, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, x in ids.items() for a in range(0, len(x), 4096)}
    assert max(r["offset"] + r["length"] for r in results[8]) <= 4096


def by_hand(texts, percent, size, words):
    """(sets, smallest id that each document reaches) over shingles of so many words."""
    sets = {}
    for k, t in texts.items():
        held = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[k] = {tuple(held[i : i + words]) for i in range(len(held) - words + 1)} or ({tuple(held)} if held else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {k: find(k) for k in keys}


def test_near_duplicates(spark, results):
    sets, roots = by_hand({r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}, 80, None, 4)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in results[3]} == {(k, len(sets[k]), c, k == c) for k, c in roots.items()}


def test_repeats(spark, results):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, "documents").collect())
    seen, want = {}, set()
    for k, t in rows:
        held = (t or "").encode().split()
        gone = [False] * len(held)
        for i in range(len(held) - 19):
            if seen.setdefault(b" ".join(held[i : i + 20]), (k, i)) != (k, i):
                gone[i : i + 20] = [True] * 20
        kept = b" ".join(w for w, g in zip(held, gone, strict=True) if not g)
        want.add((k, len(held), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in results[4]} == want


def test_vectors(spark, results):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert {r["vec_id"]: r["n_links"] for r in results[6]} == {k: int(n) for (k, _), n in zip(rows, links.sum(axis=1), strict=True)}


def plain_languages(labelled, texts):
    """Dictionaries of the commonest words, and the smallest compressed size, without Spark or shared code."""
    import zstandard

    words = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).strip()
    made = {}
    for lang in sorted({x for x, _ in labelled}):
        counts = Counter(w for t in {t for x, t in labelled if x == lang} for w in words(t).split())
        held, room = [], (32 << 10) - 1
        for w in sorted(counts, key=lambda w: (-counts[w], w)):
            if room <= 0:
                break
            if fitting := w.encode()[: max(0, room - 1)].decode(errors="ignore"):
                held.append(fitting)
            room -= len(w.encode()) + 1
        content = zstandard.ZstdCompressionDict((" " + " ".join(reversed(held)) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=7)
        made[lang] = zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = {}
    for k, t in texts.items():
        if not re.search(r"[^\W\d_]", t or ""):
            out[k] = "und"
            continue
        raw = (words(t) + " ").encode()
        raw *= max(1, -(-256 // len(raw)))
        blocks = [raw[i : i + (16 << 10)] for i in range(0, len(raw), 16 << 10)]
        out[k] = min(made, key=lambda x: (sum(len(made[x].compress(b)) for b in blocks), x))
    return out


def test_languages(spark, results):
    rows = table(spark, "documents").collect()
    apart = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    labelled = [(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None and not apart(r["doc_id"]) and re.search(r"[^\W\d_]", r["text"])]
    want = plain_languages(labelled, {r["doc_id"]: r["text"] for r in rows})
    assert {(r["doc_id"], r["held_out"], r["lang_pred"]) for r in results[9]} == {(k, apart(k), x) for k, x in want.items()}
    assert all(0 <= r["score"] <= 1 for r in results[9])


def plain_sections(encoding, text, rule):
    """Tokens of each line, a byte at a time."""
    raw = text.encode()
    line_of, line = [], 0
    for b in raw:
        line_of.append(line)
        line += b == 10
    counts = [0.0] * (max(line_of, default=0) + 1)
    at = 0
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        held = Counter(line_of[at : at + n])
        at += n
        if rule == "start":
            counts[min(held)] += 1
        elif rule == "majority":
            counts[min(held, key=lambda x: (-held[x], x))] += 1
        else:
            for x, k in held.items():
                counts[x] += k / n
    return counts


def test_sections(spark, results):
    import public_tokenizers as P

    from palimpsest.llm import attribution

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    encoding, _ = attribution.byte_encoding(path, pattern)
    found = {}
    for r in results[10]:
        found.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    for r in table(spark, "documents").collect():
        assert [n for _, n in sorted(found[r["doc_id"]].items())] == plain_sections(encoding, r["text"] or "", "majority")
    odd = ["a\n\nb", "\n\n\n\n", "x  \n \n\n\t\ny\n", "日\n本\n\n語", "\n", "a\n\n\n\n\n\n\n\n\nb \n\n c"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    crossed = 0
    for rule in ("start", "majority", "proportional"):
        rows = sorted(map(tuple, attribution.section_tokens(docs, path, pattern, rule).select("doc_id", "section", "n_tokens", "n_crossing").collect()))
        for k, text in enumerate(odd):
            assert [n for d, _, n, _ in rows if d == k] == pytest.approx(plain_sections(encoding, text, rule))
        crossed += sum(x for *_, x in rows)
    assert crossed > 0


def test_pipeline_runs_its_stages(spark, library):
    import corpus_pipeline as P

    docs = table(spark, "documents")
    out = P.run(spark, FOLDER).collect()
    rows = docs
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, FOLDER)
        assert rows.columns == P.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = {(k, a, len(ids[a : a + 4096])) for k, t in texts.items() for ids in [[*library.encode(t, add_special_tokens=False).ids, 1]] for a in range(0, len(ids), 4096)}
    assert {(r["doc_id"], r["start"], r["length"]) for r in out} == want


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, null ids, extra columns of clashing names, and no rows at all."""
    import corpus_pipeline as P

    known = table(spark, "documents").where("length(text) > 400").orderBy("doc_id").limit(12)
    schema = known.schema
    odd = spark.createDataFrame([(None, "a text of a few words without an id", None, None, None), (9001, None, None, None, None), (9002, "", "xx", "s", 0), (9003, " \n ", None, "s", 3), (9004, "12 34", None, None, 5)], schema)
    docs = known.unionAll(known.limit(3)).unionAll(odd).withColumns({c: F.lit(1) for c in ("language", "cut", "rank", "kept", "rep", "__row")})
    for _, stage in P.STAGES[:-1]:
        one = stage(spark, docs, FOLDER)
        assert one.columns == P.COLUMNS and one.count() <= docs.count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = {r["doc_id"] for r in P.language(spark, docs, FOLDER).collect()}
    assert kept.isdisjoint({9001, 9002, 9003, 9004})
    assert P.near_dedup(spark, docs, FOLDER).where("doc_id is null or doc_id > 9000").count() == odd.count()
    left = {r["doc_id"]: r["text"] for r in P.substring_dedup(spark, docs, FOLDER).where("doc_id is null or doc_id > 9000").collect()}
    assert left == {r["doc_id"]: r["text"] for r in odd.collect()}
    assert P.packing(spark, docs, FOLDER).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.packing(spark, docs.limit(0), FOLDER).count() == 0
