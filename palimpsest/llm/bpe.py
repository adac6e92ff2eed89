"""BPE encoding and decoding with a contiguous rank array.

A word is held as an array of part ids and, beside it, the rank of the merge of each part with the next one. The
lowest rank is found by a scan, its boundary is deleted, and the ranks of the two neighbours are looked up anew.
That is quadratic, so words over ``SHORT`` parts take their next merge from a heap instead; both give the merges
in order of rank and then of place.

Defined results: a null or empty text has no ids; decoding unknown ids leaves them out.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bound_arrow_batches, trimmed
from .wordids import Table, Vocabulary, _tables, encode_texts, listed, one_array, slices

#: Words of more parts than this use the heap.
SHORT = 64
NONE = 1 << 30


class RankArray:
    """Merges of one vocabulary."""

    def __init__(self, ids: dict[str, int], merges: list, suffix: str):
        self.ids, self.suffix = ids, suffix
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]

    def parts(self, letters: str) -> list[int]:
        symbols = [*letters[:-1], letters[-1] + self.suffix]
        return [self.ids[s] for s in symbols if s in self.ids]

    def encode(self, letters: str) -> list[int]:
        if not letters:
            return []
        parts = self.parts(letters)
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]


class RankedVocabulary(Vocabulary):
    """Words by the rank array; the vocabulary file gives merges, normal form and word rule."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.read(path)["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary without unknown token, prefix and byte fallback is needed")
        if self.tokenizer.decoder is not None:
            raise ValueError("decoding is by spaces between tokens, which holds for a file that names no decoder")
        self.array = RankArray(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.tokens = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def pieces(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return listed([self.array.encode(self.lettered(p)) for p in fresh.to_numpy(zero_copy_only=False)])

    def _plain_part(self, text: str) -> list[int]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [i for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for i in self.array.encode(piece)]

    def whole(self, word: str) -> list[int]:
        out, at = [], 0
        for mark in self.marks.finditer(word):
            out += self._plain_part(word[at : mark.start()]) if mark.start() > at else []
            out.append(self.special[mark.group()])
            at = mark.end()
        return out + (self._plain_part(word[at:]) if at < len(word) else [])

    def decode(self, ids) -> str:
        """The tokens with a space between, as the library does where a file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def ranked_table(path: str) -> Table:
    key = ("ranked", path)
    if key not in _tables:
        _tables[key] = Table(RankedVocabulary(path))
    return _tables[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        table = ranked_table(vocabulary)
        for batch in batches:
            texts = one_array(batch.column(1))
            for lo, hi in slices(texts):
                ids, bounds = encode_texts(texts.slice(lo, hi - lo), table)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from the rows that ``encode_documents`` returns; null ids give an empty text."""

    def run(batches):
        decode = ranked_table(vocabulary).encode.decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(trimmed(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids with a space between), decoded_sha256 (of the decoded text)."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        table = ranked_table(vocabulary)
        words = table.encode.tokens
        size = max(words, default=-1) + 1
        numerals = [b"%d" % i for i in range(size)]
        tokens = [words.get(i, "").encode() for i in range(size)]
        for batch in batches:
            texts = one_array(batch.column(1))
            for lo, hi in slices(texts):
                ids, bounds = encode_texts(texts.slice(lo, hi - lo), table)
                plain, edges = ids.tolist(), bounds.tolist()
                spelled = [hashlib.sha256(b" ".join(map(numerals.__getitem__, plain[a:b]))).hexdigest() for a, b in zip(edges, edges[1:])]
                decoded = [hashlib.sha256(b" ".join(map(tokens.__getitem__, plain[a:b]))).hexdigest() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
