"""A corpus from raw documents to token ids: toxic ones go, one of each near-duplicate group stays, repeated
passages are cut, sources are mixed to their weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.jaccard_forest import one_of_each
from kindred.llm.long_repeats import without_repeats
from kindred.llm.mixing import mixed_documents
from kindred.llm.pieces import PieceModel, with_pieces
from kindred.llm.tables import table
from kindred.llm.toxicity import REJECT, fit, score_toxicity, teaches
from kindred.ship import ship
from kindred.storage import forget, scratch, sized, staged


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the rejecting score, in all their columns.

    A null text counts as empty and has a score like any other; a null key is scored, but never learnt from.
    Repeated rows are judged alike and all stay or go. Columns may have any names. No documents give none; without
    labels of both kinds the score is one share for all, and a share of REJECT or more rejects all.
    """
    ship(spark)
    model = fit(docs, table(spark, sf_dir, "labels"), teaches())
    own = "_" * max(map(len, docs.columns)) + "toxicity"  # no name of docs
    return sized(score_toxicity(docs, model, out=own).where(F.col(own) < REJECT).drop(own), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 or more hold together: the one with the smallest key.

    Null, empty and blank texts link with nothing and stay; rows with a null key stay. Of repeated rows one stays.
    Long texts are whole, columns may have any names, no documents give none.
    """
    ship(spark)
    return one_of_each(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 words that occur twice, all copies alike.

    Texts that lose nothing stay as they are, null and empty ones too; those that lose every word go. Null keys and
    repeated rows (copies of each other) are documents like any others. Columns may have any names, no documents give none.
    """
    ship(spark)
    return without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes the blocks that their words lie in.

    Documents without words go; a null source is one, the last; null keys and repeated rows are documents like any
    others. Columns may have any names, no documents give none.
    """
    ship(spark)
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of what they decode to.

    A null text counts as empty: begin and end alone. Null keys and repeated rows each give a row; other columns are
    left out; no documents give none.
    """
    ship(spark)
    import public_tokenizers

    out = with_pieces(docs, PieceModel.load(public_tokenizers.path("piece_bpe_32k.model")))
    out = sized(out, docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("near_duplicates", near_duplicates), ("long_repeats", long_repeats), ("mixing", mixed), ("token_ids", token_ids)]

#: A fitted classifier is not SQL; run() is tested on a small corpus against plain Python (planted toxic texts, all else computed).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. What a stage writes on its way is deleted when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = staged(stage(spark, before, sf_dir), name, by=before)
            keep.append(docs)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
