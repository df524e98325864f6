"""A training corpus from ``documents``: toxic documents go, one of each group of near-duplicates stays, repeated passages
are cut out, contaminated documents go, and what is left is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, simhash, suffixes, toxicity
from tessera.llm.common import written

#: SQL can express neither the fitted model, nor the fingerprints, the tokenizer and the packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows whose P(grade >= 1) is a half or more go.

    Every row is judged by its own text, repeated rows alike; null and empty texts have no toxic word and stay. An empty
    table gives an empty one; columns beyond id and text are carried along, whatever their names.
    """
    return toxicity.without_toxic(docs, toxicity.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, on shingles of five words: the row with the smallest id of each group stays.

    Of repeated rows, and of ties by id, one stays; a null id comes last; all null and empty texts are one group. An empty
    table gives an empty one; other columns are carried along, whatever their names.
    """
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: bytes of repeated strings of 200 bytes go; every row stays, if need be with an empty text.

    A null text becomes an empty one; rows that repeat a text lose it if it has 200 bytes; null and repeated ids make no
    difference. ``n_chars``, where there is such a column, is counted anew; other columns are carried along, whatever their
    names. An empty table gives an empty one.
    """
    found = suffixes.without_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows with ten consecutive words of a benchmark item go.

    Null and empty texts stay; repeated rows are judged alike; an empty table gives an empty one, and an empty benchmark
    lets all rows stay. Other columns are carried along, whatever their names.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is its end id alone; null and repeated ids keep their rows; an empty table gives no piece; other
    columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
