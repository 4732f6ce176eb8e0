"""Training-data pipeline over ``documents``: quality, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.  ``run``
writes the rows of a stage to the shared folder and reads them back as the next one's documents.

Both filters take their limit from rows that their model has not seen: they aim at losing one in a thousand of the good rows
at most, quality rejects below one half otherwise, and language ID where it catches 95 % of letter-scrambled text.

Defined cases: an empty table gives no rows at any stage; NULL texts have no letters and are rejected by language ID; rows
without an id and repeated rows are documents of their own but for near-dedup, which keeps one row of an id; other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake.llm import langid, mixing, neardup, packing, quality
from platelake.sources.workspace import stored

# Tokenizer ids have no SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees, limit = quality.train_with_limit(docs, labels, F.lit(True))
    return docs.filter(quality.scored(trees, F.col("text")) >= limit)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted by a model fitted on their own language marks."""
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs.select("text", F.struct(*docs.columns).alias("_row")), model)
    return found.filter("accepted").select("_row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return neardup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs)


STAGES = [("quality classifier", good_quality), ("language ID", known_language),
          ("MinHash near-dedup", without_near_copies), ("mixing sources", mixed_sources), ("packing", packed_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
