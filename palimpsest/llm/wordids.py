"""Token ids of whole texts for the word-end BPE vocabulary, a distinct word at a time.

White space never joins the pieces of this kind of tokenizer, so a text's ids are the ids of its
white-space-separated words one after another. Arrow splits a batch and finds its distinct words; only
words not met before are encoded. A word of plain letters and signs, whose normal form and pieces are
beyond doubt, is split here and the BPE model of the tokenizers library encodes each piece not met
before. Any other word goes through the whole library call.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of ASCII and of the Latin-1 letters that are their own normal form, without an apostrophe.
PLAIN = "^[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: What stands alone or ends a run of letters in such a word, in lower case (fixed by the vocabulary's word rule).
BREAKS = "([0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+)"
#: Strings, and their bytes, that a worker remembers; beyond either it forgets those that it met only once.
REMEMBERED, REMEMBERED_BYTES = 150_000, 8 << 20
#: Bytes of text that are worked on at once, unless one text is longer.
SLICE_BYTES = 2 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def one_array(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


class Table:
    """The ids of strings met lately, end to end, with the place of each string.

    ``encode`` maps an array of distinct new strings to (their ids end to end, the number of each one's ids). Common
    strings stay; the many that stand only once don't fill a worker's memory.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._keep(pa.array([], pa.string()), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def _keep(self, known: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known, self.flat, self.lengths = known, flat, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.met = np.zeros(len(known), dtype=bool)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met)
        if 2 * len(kept) > REMEMBERED:
            kept = kept[:0]
        self._keep(self.known.take(pa.array(kept)), self._gathered(kept)[0], self.lengths[kept])

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.starts[numbers] - ends[:-1], sizes)
        where += np.arange(len(where))
        return self.flat[where], ends

    def __call__(self, distinct: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at ``places`` of ``distinct`` end to end, and where each one's ids start (one more at
        the end)."""
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self._forget()
        found = pc.index_in(distinct, value_set=self.known)
        fresh = distinct.filter(found.is_null())
        number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[number[number >= 0]] = True
        if len(fresh):
            ids, sizes = self.encode(fresh)
            met = self.met
            number[number < 0] = np.arange(len(self.known), len(self.known) + len(fresh))
            self._keep(pa.concat_arrays([self.known, fresh]), np.concatenate([self.flat, ids]), np.concatenate([self.lengths, sizes]))
            self.met[: len(met)] = met
        return self._gathered(number[places])


def listed(ids: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words at ASCII white space: each one's place among the distinct words, those, and the first word of each text
    (one more at the end). Null is empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(split.offsets).astype(np.int64)
    words = split.flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, bounds - bounds[0]


class Vocabulary:
    """Encodes distinct words: plain ones a piece at a time by ``pieces``, all others whole by ``whole``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        stated = self.read(path)
        # the short cut holds for this normalizer and word rule only
        self.short = (
            [n.get("type") for n in (stated.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and stated["model"].get("end_of_word_suffix") == "</w>"
            and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(stated.get("pre_tokenizer")).replace("\\\\", "\\")
        )
        self.letters = byte_alphabet()
        self.piece_table = Table(self.pieces)

    @staticmethod
    def read(path: str) -> dict:
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def lettered(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())

    def pieces(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        model = self.tokenizer.model
        return listed([[t.id for t in model.tokenize(self.lettered(p))] for p in fresh.to_numpy(zero_copy_only=False)])

    def whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __call__(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles: a collection would only walk them
        try:
            plain = pc.match_substring_regex(fresh, PLAIN) if self.short else pa.array([False] * len(fresh))
            for s in self.special:
                plain = pc.and_(plain, pc.invert(pc.match_substring(fresh, s)))
            mask = plain.to_numpy(zero_copy_only=False)
            spaced = pc.replace_substring_regex(pc.utf8_lower(fresh.filter(plain)), BREAKS, " \\1 ")
            places, distinct, bounds = split_words(pc.utf8_trim(spaced, " "))
            ids, ends = self.piece_table(distinct, places)
            others, counts = listed([self.whole(w) for w in fresh.filter(pc.invert(plain)).to_pylist()])
        finally:
            if collecting:
                gc.enable()
        sizes = np.zeros(len(fresh), dtype=np.int64)
        sizes[mask], sizes[~mask] = np.diff(ends[bounds]), counts
        if not len(counts):
            return ids, sizes
        out, by_plain = np.zeros(int(sizes.sum()), dtype=np.uint32), np.repeat(mask, sizes)
        out[by_plain], out[~by_plain] = ids, others
        return out, sizes


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterable[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def encode_texts(texts: pa.Array, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and the first id of each text (one more at the end)."""
    places, distinct, bounds = split_words(texts)
    ids, ends = table(distinct, places)
    return ids, ends[bounds]


_tables: dict[tuple, Table] = {}


def library_table(path: str) -> Table:
    """This worker's table for a vocabulary file; kept between tasks."""
    key = ("library", path)
    if key not in _tables:
        _tables[key] = Table(Vocabulary(path))
    return _tables[key]
