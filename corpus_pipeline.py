"""From raw documents to token shards: language, near duplicates, contamination, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads
it back for the next one. All stages but the last return the columns of documents, and further columns that docs has, under
whatever names. All stages take an empty table (and give none, or an empty store) and very long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import decontaminate, language_id, mixing, ngram_join, token_io
from skeinwork.llm.common import columns, fresh_dir, own_name, prepared, table
from skeinwork.llm.queries import byte_bpe_path

#: Below this share of the code-length posterior no language is called.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose language the model doesn't call.

    Null and empty texts have no letter and go. Rows without a lang or a doc_id are judged as all others; repeated rows each
    by the same rule. If no row has a lang, no language is known and all go."""
    prepared(spark)
    label, sure = own_name(docs, "language"), own_name(docs, "sure")
    named = language_id.predict(docs, language_id.train(docs), label, sure)
    return named.where((F.col(label) != language_id.UNKNOWN) & (F.col(sure) >= LEAST_SCORE)).select(*columns(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share eight tenths of their five-word shingles, over links, the smallest doc_id stays.

    Texts without words (null ones, too) link with nothing and stay. All rows of the doc_id that stays do, also where it is
    repeated; rows without a doc_id can't be named by it and stay."""
    prepared(spark)
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold benchmark windows over a twentieth of their words or more.

    Texts without words are clean. Each row goes or stays by its own text, whatever its doc_id."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature, within as many tokens as there are: rows repeat or go as the weights have it.

    A null source is the source named ''. Rows equal in doc_id, source and text come and go together. Texts without words
    come with each epoch of their source that reaches them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, laid in the mixture's order; a row per document of the mixture.

    Null and empty texts are just the end id; rows without a doc_id are written but can't be looked up."""
    prepared(spark)
    rows, keys = mixing.laid(docs)
    return token_io.tokenize(rows, byte_bpe_path(), order="place", keys=keys)


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixture),
    ("token_ids", tokens),
]

#: The language model, the token ids and the components of links have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
