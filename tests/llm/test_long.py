"""A text of 20 MiB and one of two million spaces through every operator of texts, against brute force."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import attribution, bpe, chat, langid, matroska, minhash, packing, store, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    words = rng.choices(known, k=(20 << 20) * 2 // 13)
    words[-30:] = words[:30]  # a passage that stands again
    long = " ".join(words)
    assert len(long) >= 20 << 20
    return {1: long, 2: "a" + " " * 2_000_000 + "b", 3: " ".join(words[100:160])}


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('long')}/documents"
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def ids(texts, library):
    """Ids a word at a time: white space never joins this vocabulary's pieces."""
    held = {}
    of = lambda w: held.setdefault(w, library.encode(w, add_special_tokens=False).ids) if w not in held else held[w]
    return {k: np.fromiter((i for w in t.split() for i in of(w)), dtype="<u4") for k, t in texts.items()}


def test_store_and_packing(spark, docs, ids, vocabulary, tmp_path):
    with_end = {k: np.append(x, np.uint32(1)).astype("<u4") for k, x in ids.items()}
    store.write_store(docs, f"file://{tmp_path}/store", vocabulary)
    read = store.read_documents(spark, f"file://{tmp_path}/store").collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read} == {(k, len(x), zlib.crc32(x.tobytes())) for k, x in with_end.items()}
    placed = packing.pack_documents(docs, vocabulary).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in placed} == {(k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, x in with_end.items() for a in range(0, len(x), 4096)}


def test_bpe(docs, ids, vocabulary):
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.round_trip_digests(docs, vocabulary).collect()}
    assert found == {k: (len(x), hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest()) for k, x in ids.items()}


def test_chat(spark, texts):
    said = {1: texts[1] + '"\\\n<|im_end|>', 2: texts[2], 3: texts[3]}
    rows = [(k, json.dumps({"role": "assistant", "text": t})) for k, t in said.items()]
    rows += [(4, json.dumps({"messages": [{"role": "user", "content": t} for t in said.values()]})), (5, json.dumps({"role": "x", "text": said[1], "more": 1})), (6, '{"role": "x", "text": "' + "\\q" * (1 << 20) + '"}')]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    turns = chat.canonical_turns(records)
    out = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chat(turns))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["loss_sha256"]) for k, r in out.items() if k < 4} == {k: (1, len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in said.items()}
    assert out[4]["n_turns"] == 3 and out[4]["turns_sha256"] == hashlib.sha256("".join(f"user\n{t}\n" for t in said.values()).encode()).hexdigest()
    assert set(out) == {1, 2, 3, 4} and {r["conv_id"] for r in chat.unmatched(records).select("conv_id").collect()} == {5, 6}


def test_near_duplicates_and_substring(docs, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 4).collect()}
    sets = {}
    for k, t in texts.items():
        w = t.split()
        sets[k] = {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
    assert found == {k: (len(s), k, True) for k, s in sets.items()}

    starts, removed = {}, {k: set() for k in texts}
    for k, t in texts.items():
        raw = t.encode()
        at = [m.span() for m in WORD.finditer(raw)]
        for i in range(len(at) - 19):
            key = hash(raw[at[i][0] : at[i + 19][1]])  # one space between all words here
            if starts.setdefault(key, (k, i)) != (k, i):
                removed[k].update(range(i, i + 20))
    cut = {r["doc_id"]: (r["cut"]["n_words"], r["cut"]["n_removed"], r["cut"]["kept_sha256"]) for r in substring.cut_repeats(docs, 20).collect()}
    want = {}
    for k, t in texts.items():
        words = t.split()
        want[k] = (len(words), len(removed[k]), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in removed[k]).encode()).hexdigest())
    assert cut == want and cut[1][1] == 30 and cut[3][1] == 60


def test_media(docs, texts):
    found = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in matroska.media_digests(matroska.media_of_documents(docs)).collect()}
    padded = {k: t.encode() + b" " * (-len(t) % 192) for k, t in texts.items()}
    assert found == {k: (len(texts[k]), hashlib.sha256(p).hexdigest()) for k, p in padded.items()}


def test_language(spark, docs, texts):
    dictionaries = langid.fit_dictionaries(spark.createDataFrame([("aa", texts[1][:200_000]), ("bb", texts[1][:200_000][::-1].upper().translate({65: "x", 66: "y", 67: "z"}))], "lang string, text string"))
    found = {r["doc_id"]: r["language"]["lang"] for r in langid.predict(docs, dictionaries).collect()}
    assert found[1] == found[3] == "aa" and found[2] in ("aa", "bb")
    assert langid.fit_dictionaries(docs.withColumn("lang", F.lit("aa")))["aa"]


def test_attribution(docs, texts):
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    encoding, _ = attribution.byte_encoding(path, pattern)
    found = {r["doc_id"]: (r["section"], r["end_char"], r["n_tokens"]) for r in attribution.section_tokens(docs, path, pattern).collect()}
    want = {k: (0, len(t), float(len(encoding.encode_ordinary(t)))) for k, t in texts.items() if k != 2}
    spaces = len(encoding._encode_single_piece(" " * 1_999_999))
    assert found == want | {2: (0, len(texts[2]), float(2 + spaces))}


def test_attribution_of_white_space(monkeypatch):
    """Texts cut into pieces have the ids that the library gives them whole."""
    import public_tokenizers as P

    encoding, _ = attribution.byte_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(attribution, "LONG_RUN", 2)
    monkeypatch.setattr(attribution, "_long_run", attribution.regex.compile(r"\s"))
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "é", "1", "٣", "'s", "'", "!", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "日", "🙂", "ß", " ll"]) for _ in range(rng.randint(0, 20)))
        assert attribution.token_ids(encoding, P.PATTERN, text) == encoding.encode_ordinary(text)
