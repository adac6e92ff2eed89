"""Offset-mapped token counts.

A document is encoded once as a whole with a byte-level vocabulary; the lengths of its tokens give each token's
span. Spans are joined to the document's sections by their bounds, and a token that crosses a boundary goes by
one of three rules:

``start``         to the section in which it starts;
``majority``      to the section that holds most of its bytes, the earlier one on a tie;
``proportional``  to every section it touches, by its share of the token's bytes (counts are then fractions).

Under each rule the sections' counts add up to the document's tokens. Sections are lines, each with the line feed
that ends it. Spans in characters are those of the text; a token that holds only part of a character counts
by its bytes.

Defined results: a null or empty text has one empty section without tokens; a text that ends in a line feed has
no empty section behind it; rows of one id are documents of their own; a null id is carried along; very long texts
and runs of white space are encoded whole like any others; other columns are left out and may have any name; no rows
give no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bound_arrow_batches, trimmed
from .wordids import one_array, slices

SECTIONS = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
_encodings: dict[tuple[str, str], tuple] = {}
#: A text with a longer run of white space is cut into pieces here: the library's matcher recurses over such a run.
LONG_RUN = 4096
_long_run = regex.compile(rf"\s{{{LONG_RUN}}}")


def byte_encoding(ranks_path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, and the bytes of each id's token."""
    key = (ranks_path, pattern)
    if key not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[key] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _encodings[key]


def token_ids(encoding, pattern: str, text: str) -> list[int]:
    """The ids of a whole text, whatever it holds."""
    if len(text) < LONG_RUN or not _long_run.search(text):
        return encoding.encode_ordinary(text)
    return [i for piece in regex.finditer(pattern, text) for i in encoding._encode_single_piece(piece.group())]


def attributed(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens go on into a later one.

    ``ends``: the end of each token, the first one starting at 0; ``bounds``: the sections' bounds, first and last included.
    """
    n = len(bounds) - 1
    if not len(ends):
        return np.zeros(n), np.zeros(n, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(float)
    crossing = np.bincount(first[~inside], minlength=n)
    for t in np.flatnonzero(~inside).tolist():
        touched = np.arange(first[t], last[t] + 1)
        share = np.minimum(bounds[touched + 1], ends[t]) - np.maximum(bounds[touched], starts[t])
        if rule == "start":
            counts[touched[0]] += 1
        elif rule == "majority":
            counts[touched[np.argmax(share)]] += 1
        else:
            counts[touched] += share / share.sum()
    return counts, crossing


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section of each document: its span in characters, its tokens under ``rule``, the tokens that
    start in it and end in a later one, and the document's tokens."""
    if rule not in ("start", "majority", "proportional"):
        raise ValueError(f"unknown rule {rule!r}")
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        encoding, sizes = byte_encoding(ranks_path, pattern)
        for batch in batches:
            texts = one_array(batch.column(1))
            for lo, hi in slices(texts):
                keys, columns = batch.column(0).slice(lo, hi - lo), []
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                    ids = np.array(token_ids(encoding, pattern, text or ""), dtype=np.int64)
                    bounds = np.flatnonzero(raw == 10) + 1
                    bounds = np.concatenate([[0], bounds, [len(raw)] if not len(bounds) or bounds[-1] < len(raw) else []]).astype(np.int64)
                    counts, crossing = attributed(np.cumsum(sizes[ids]), bounds, rule)
                    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                    n = len(counts)
                    columns.append((np.full(n, i), np.arange(n), characters[:-1], characters[1:], counts, crossing, np.full(n, len(ids))))
                if columns:
                    of, section, a, b, counts, crossing, total = (np.concatenate(x) for x in zip(*columns, strict=True))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(section, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), SECTIONS)
