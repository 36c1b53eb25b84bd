"""Five corpus stages, each over what the one before kept.

Every function takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Each is one operator of the corpus package with its query's parameters.

Defined cases: null text and text without letters go in the first stage; a text that line
dedup empties goes, an empty one never comes so far; rows without an id are judged by
their text alone (languages, benchmark) and are never copies of others; rows that share an
id are judged one by one by texts and as one document by the two dedup stages, so of
repeated rows either all stay or all go; the smallest id of a group of copies stays, which
leaves no ties; an empty table gives no rows. Columns beyond those of ``documents`` are not
carried on, whatever their names; ``n_chars`` is counted anew where lines were cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import language_id
from quantloom.llm.common import Scratch, bounded_batches, table
from quantloom.llm.decontam import decontaminate
from quantloom.llm.line_dedup import dedup_lines
from quantloom.llm.near_copies import keep_one
from quantloom.llm.queries import tokenizer_path
from quantloom.llm.sentencepiece import encode_column

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found: null text, or no letters.

    Without a labelled document there is no network, and every document with letters stays.
    """
    bounded_batches(spark)
    model = language_id.train(docs)
    if model is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    seen = language_id.predict(docs.select(*COLUMNS), model)
    return seen.where(F.col("language.lang_pred") != language_id.UND).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of lines that stand at an earlier place; a document cut to nothing goes."""
    bounded_batches(spark)
    d = dedup_lines(docs.select(*COLUMNS), Scratch(spark, "pipeline-lines"), runs=True)
    kept = d.select("doc_id", F.col("lines.text").alias("text"), "lang", "source", F.when(F.col("lines.n_chunks_removed") > 0, F.length("lines.text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), F.col("lines.n_chunks_removed").alias("__n"))
    return kept.where((F.col("__n") == 0) | (F.length("text") > 0)).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a Jaccard similarity of 0.8 on five words."""
    bounded_batches(spark)
    return keep_one(docs.select(*COLUMNS), Scratch(spark, "pipeline-simhash"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    bounded_batches(spark)
    kept = docs.select(*COLUMNS).withColumn("kept_text", F.col("text"))
    found = decontaminate(kept, table(spark, sf_dir, "benchmark"))
    return found.where("found.n_hit = 0").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", "n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and as ``text`` what decoding them gives back."""
    bounded_batches(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    d = encode_column(docs.select(*COLUMNS), path, decoded_col="decoded")
    return d.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", F.size(F.coalesce("token_ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece", encode_pieces),
]
#: Fingerprints, trained weights and content-defined chunks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
