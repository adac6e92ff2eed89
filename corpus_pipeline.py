"""The corpus pipeline: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``.

Defined results of every stage: other columns go, whatever their names; nulls in columns that it doesn't read are carried along;
no rows give no rows; a text of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.langid import fit_dictionaries, predict
from palimpsest.llm.minhash import near_duplicates
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import CAPACITY, END_ID, vocabulary_path
from palimpsest.llm.staging import Staging
from palimpsest.llm.substring import cut_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected where the two best languages differ by less than this share: ties, in effect.
LEAST_MARGIN = 0.002
#: Words of a passage that may stand only once.
PASSAGE = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those whose language stays open, go; ``lang`` becomes the predicted language.

    So null and empty texts go, and without any labelled row all texts do. Rows are judged one by one: equal rows stay or
    go together, and a null id is carried along.
    """
    dictionaries = fit_dictionaries(docs.select("lang", "text"))
    found = predict(docs.select(*COLUMNS), dictionaries, LEAST_MARGIN)
    return found.where("not language.rejected").withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, the smallest id.

    Rows go by id alone: where one id stands on rows of different texts, they are linked as one document, and if one of them is a
    near copy of a smaller id, all of them go, unique ones too. Equal rows of one id stay together. Rows without an id, and
    texts without words, have no near duplicates and stay.
    """
    gone = near_duplicates(docs, words_per_shingle=5, percent=80).where("not kept").select("doc_id")
    gone = Staging(spark, "pipeline").write(gone.distinct(), "near")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a repeated passage of 50 words or more the first copy stays; documents that it leaves without words go.

    Texts that had no words to begin with stay as they are. Rows without an id come last; equal rows of one id tie and
    keep their words.
    """
    cut = cut_repeats(docs.select(*COLUMNS), window=PASSAGE)
    left = cut.where("cut.n_removed = 0 or cut.n_removed < cut.n_words")
    changed = F.col("cut.n_removed") > 0
    text = F.when(changed, F.col("cut.kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("cut.kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: a row per piece with its sequence and offset.

    A null or empty text is the end id alone; equal rows are packed each; a null id is carried along.
    """
    return pack_documents(docs, vocabulary_path(), CAPACITY, END_ID)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages rest on compression, signatures and token ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
