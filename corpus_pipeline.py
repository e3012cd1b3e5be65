"""The corpus pipeline: documents to packed sequences in five stages.

Near-dedup and mixing decide on row keys. While the table of decisions is small,
measured, it is broadcast and documents stay where they are; beyond that one row
of each key is shuffled once.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and rereads it as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm import langid_ftrl, mixing, packing, quality_iforest, simhash_dedup
from siftgrid.llm.common import cut, free_name, small, table

#: A prediction below this is no language; four languages at even odds have 0.25.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; a null text, one without a letter and an undecided one go.

    Rows without a language teach nothing; without any learning rows all go. Repeated rows share their verdict.
    """
    model = langid_ftrl.train(docs.where(~langid_ftrl.held_out()))
    found = langid_ftrl.predict(docs, model)
    sure = (found["lang_pred"] != langid_ftrl.UNDECIDED) & (found["score"] >= LEAST_SCORE)
    return docs.where(sure)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forest keep stay.

    A null or empty text has under 50 words and goes; repeated rows share their verdict; an empty table stays empty.
    """
    name = free_name(docs, "stats")
    known = cut(docs.withColumn(name, quality_iforest.measured()))
    forest, limit = quality_iforest.fitted(known.select("doc_id", f"{name}.*"), table(spark, sf_dir, "labels"))
    kept = ~quality_iforest.base_failed(name) & (quality_iforest.anomaly(forest, spark, name) < limit)
    return known.where(kept).select(*docs.columns)


ROW_KEY = ("row_a_", "row_b_")


def with_row_key(docs: DataFrame) -> DataFrame:
    """ROW_KEY, 128 bits of hash of the whole row with nulls told from values, and the row as a struct; rows with equal keys are equal and stand for each other."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = [x for c in columns for x in (c.isNull(), c)]
    return docs.select(*(F.xxhash64(F.lit(name), *parts).alias(name) for name in ROW_KEY), F.struct(*columns).alias("row"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of smallest id, a null id last, then of smallest row key.

    Rows decide, not ids: different texts under one id, or under none, are not one document. Null and
    wordless texts are near copies of each other. Of repeated rows one stays; an empty table stays empty.
    """
    keyed = with_row_key(docs)
    stays = F.expr(" and ".join(f"{k} = first.{k}" for k in ROW_KEY))
    found = simhash_dedup.group(keyed.select(*ROW_KEY, "row.doc_id", "row.text"), row_key=ROW_KEY)
    ids = cut(found.groupBy(*ROW_KEY).agg(F.max(stays).alias("stays"), F.count("*").alias("n")))
    if not small(ids, F.lit(16)):
        # Rows of a key are equal, so one of them is all that is moved; the join then finds them in place.
        return keyed.dropDuplicates([*ROW_KEY]).join(ids.where("stays").select(*ROW_KEY), [*ROW_KEY], "left_semi").select("row.*")
    gone, twice = F.broadcast(ids.where(~F.col("stays")).select(*ROW_KEY)), F.broadcast(ids.where("stays and n > 1").select(*ROW_KEY))
    left = keyed.join(gone, [*ROW_KEY], "left_anti")
    once = left.join(twice, [*ROW_KEY], "left_anti")
    repeated = left.join(twice, [*ROW_KEY], "left_semi").dropDuplicates([*ROW_KEY])
    return once.unionByName(repeated).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; one that it takes no copy of goes. Equal rows give the sum of their copies.

    Null and wordless texts take no words and stay once, or go with a source that has no words; a null source is
    a source of its own; an empty table stays empty.
    """
    keyed = with_row_key(docs)
    mixed = mixing.mix(keyed.select(*ROW_KEY, "row.doc_id", "row.source", "row.text"), row_key=ROW_KEY)
    taken = cut(mixed.groupBy(*ROW_KEY).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")).where("copies > 0"))
    if small(taken, F.lit(20)):
        single, several = F.broadcast(taken.where("n = 1").drop("n")), F.broadcast(taken.where("n > 1").drop("n"))
        once = keyed.join(single, [*ROW_KEY])
        repeated = keyed.join(several.select(*ROW_KEY), [*ROW_KEY], "left_semi").dropDuplicates([*ROW_KEY]).join(several, [*ROW_KEY])
        found = once.unionByName(repeated)
    else:
        found = keyed.dropDuplicates([*ROW_KEY]).join(taken.drop("n"), [*ROW_KEY])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids; a null or empty text is its end id, repeated rows are packed each, an empty table gives none."""
    return packing.with_digest(packing.pack(docs))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: The stages fit models and cut texts by a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
