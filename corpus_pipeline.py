"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage gets what its predecessor kept and, but for the last, returns the columns of documents it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tidewake.llm.common import boxed, stored, table, unboxed
from tidewake.sources.staging import drop_staged

#: Part of all tokens that the mix takes, and how often it may take a row.
MIX_FRACTION, MIX_EPOCHS = 0.9, 1


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, trained on the labelled rows of docs: rows go whose text is null, has no letter or isn't surely in a learned language.

    A text is judged by the part of its n-grams that the learned texts know, against a fence worked out for each label from
    its own texts (language_id.fences), so that labels of few rows keep theirs.  Where a sure prediction on a text long
    enough contradicts the label, or there is no label, it becomes the row's lang; the mix goes by it.  Texts in several
    learned languages stay.  Without any label nothing can be told: rows with a letter stay as they are.  Repeated rows share
    their fate, ids (null ones too) only choose the sample for training, other columns of any name come through, and an
    empty table stays empty."""
    model = language_id.learned(docs)
    if model is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    told = language_id.identify(boxed(docs), model).where(language_id.surely(F.col("text"), model))
    lang = F.col("row.lang")
    telling = (F.length("text") >= language_id.TELLING) & (F.col("score") >= language_id.SURE)
    better = lang.isNull() | ((lang != F.col("lang_pred")) & telling)
    out = told.withColumn("row", F.col("row").withField("lang", F.when(better, F.col("lang_pred")).otherwise(lang)))
    return unboxed(out, docs.columns)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component of linked rows the row of the least doc_id stays; of rows equal in id and text one stays.

    Null and empty texts link with nothing; null ids come after all others.  Other columns of any name come through; an empty
    table stays empty.  Long texts are whole sets."""
    return jaccard_join.one_of_each(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows with a copy of a benchmark item go.

    Null and empty texts have none; repeated rows share their fate, whatever their ids; texts of any length are searched
    whole; other columns of any name come through.  Empty tables: no rows, or nothing to find."""
    told = decontamination.find_copies(boxed(docs), table(spark, sf_dir, "benchmark"))
    return unboxed(told.where(F.size("found") == 0), docs.columns)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the rows that the mix takes, at most once each.

    Null labels are a label of their own; null texts have no tokens and follow the rows before them; rows equal in id (null
    too) have equal places, by tokens then.  Other columns of any name come through; an empty table stays empty."""
    return mixing.production(docs, MIX_EPOCHS, MIX_FRACTION).select("row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: all rows with their shard and place in it.

    Columns size, text_crc32, law, shard, slot and grown_shard of docs are replaced.  Null texts have size 1; rows of one id
    (null too) lie in one shard; an empty table gives no rows."""
    return sharding.shard(docs, sharding.tree_of(8), sharding.tree_of(9))


STAGES = [
    ("language ID", by_language),
    ("n-gram Jaccard join", by_similarity),
    ("benchmark decontamination", by_benchmark),
    ("mixing sources to target weights", by_mixture),
    ("sharding", into_shards),
]

#: SQL can express neither the trained model nor the hashes and alignments; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if i:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
