"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its commonest words. A text's letters are lower-cased and cut
into blocks of bounded size, all of which count; each is compressed with every dictionary, and the language with
the smallest sum is the prediction. The margin is how much larger the second smallest is, as a share of it; the
score maps it to 0 to 1. A text whose margin is under ``least_margin`` is rejected, as is one without letters.

The dictionaries are fitted on at most ``sample_rows`` distinct labelled texts a language, those of the smallest
hashes, however often each of them stands there; a language with fewer gives all of its texts.

Defined results: null, empty and letterless texts are ``und`` with score 0, and rejected; with no labelled row all
texts are ``und``; a single language wins every text with letters, with score 0; ties go to the language that
comes first in the alphabet, with score 0; equal texts get equal predictions; null ids are carried along.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import bound_arrow_batches, trimmed
from .wordids import one_array

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
#: Shorter texts are repeated up to this size: blocks that hardly shrink would be stored as they are, and tie.
LEAST_BYTES = 256
#: Bounds of the fitted sample, of a dictionary and of a compressed block; the compression level.
SAMPLE_ROWS, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 400, 32 << 10, 16 << 10, 7


def plain_words(text: str) -> str:
    """Lower-case letters with one space between words: what is compressed."""
    return OTHER.sub(" ", text.lower()).strip() + " "


def fit_dictionaries(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each value of ``lang`` in (lang, text): its commonest words in the sample, up to
    ``dictionary_bytes``, the commonest last, where zstandard reaches them cheapest; the word that no longer fits is
    cut to the room left.

    Words, not passages: a licence line that one language's sample happens to hold must not decide. The sampled texts
    are counted whole, in tasks; what reaches the driver is the words of the dictionaries.
    """
    bound_arrow_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").withColumn("key", F.xxhash64("text")).where(F.col("text").rlike(r"\p{L}"))
    hashes = rows.select("lang", "key").distinct()

    def below(bounds: dict[str, int]):
        near = F.lit(False)
        for lang, bound in bounds.items():
            near = near | ((F.col("lang") == lang) & (F.col("key") <= bound))
        return near

    # hashes below a bound that about twice the sample of distinct texts reaches, so what moves doesn't grow with the
    # table; fewer than the sample lie below it with a probability under 1e-15
    texts = hashes.groupBy("lang").count().collect()  # a row a language
    bounds = {lang: int(min(1.0, (2.0 * sample_rows + 50) / n) * (1 << 63)) * 2 - (1 << 63) - 1 for lang, n in texts}
    ranked = hashes.where(below(bounds)).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    bounds = dict(map(tuple, ranked.where(F.col("rank") <= sample_rows).groupBy("lang").agg(F.max("key")).collect()))
    sample = rows.where(below(bounds)).groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")

    def words(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, word) for word in plain_words(text).split())
            columns = [[lang for lang, _ in found], [word for _, word in found], list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counted = sample.mapInArrow(trimmed(words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    size = F.octet_length("word") + 1
    ends = counted.withColumn("end", F.sum(size).over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    taken: dict[str, list[str]] = {lang: [] for lang in bounds}
    for lang, word in ends.where(F.col("end") - size < dictionary_bytes).orderBy("lang", "end").select("lang", F.substring("word", 1, dictionary_bytes)).collect():
        taken[lang].append(word)
    out = {}
    for lang in sorted(taken):
        held, room = [], dictionary_bytes - 1
        for word in taken[lang]:
            if fitting := word.encode()[: max(0, room - 1)].decode(errors="ignore"):
                held.append(fitting)
            room -= len(word.encode()) + 1
        out[lang] = (" " + " ".join(reversed(held)) + " ").encode()
    return out


_compressors: dict[bytes, list] = {}


def compressors(dictionaries: dict[str, bytes]) -> list:
    """(language, compressor), by the alphabet; made once a worker."""
    import hashlib

    import zstandard

    key = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).digest()
    if key not in _compressors:
        _compressors.clear()
        made = []
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _compressors[key] = made
    return _compressors[key]


def classify(text: str | None, made: list) -> tuple[str, float]:
    """(language, margin)."""
    if not made or text is None or not LETTER.search(text):
        return UNDETERMINED, 0.0
    raw = plain_words(text).encode()
    raw *= max(1, -(-LEAST_BYTES // len(raw)))
    sizes = [sum(len(c.compress(raw[i : i + BLOCK_BYTES])) for i in range(0, len(raw), BLOCK_BYTES)) for _, c in made]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
    return made[best][0], (second - sizes[best]) / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.0, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and struct ``language``: lang, score (0 to 1), rejected. An input column of that name gives
    way to the result."""
    bound_arrow_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "language"))
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by languages times dictionary_bytes
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    text_at = docs.columns.index(text_col)

    def run(batches):
        made = compressors(held.value)
        for batch in batches:
            out = []
            for text in one_array(batch.column(0)).field(text_at).to_pylist():
                lang, margin = classify(text, made)
                out.append({"lang": lang, "score": min(1.0, 4 * margin), "rejected": lang == UNDETERMINED or margin < least_margin})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "language"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, language struct<lang: string, score: double, rejected: boolean>"
    return rows.mapInArrow(trimmed(run), schema).select("row.*", "language")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
