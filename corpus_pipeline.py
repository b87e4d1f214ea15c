"""From raw documents to a training mix: five stages, each of which takes what the one before kept.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes its result as Parquet to the shared folder and reads
it again for the next. All stages but the last return the columns of ``documents``; so does the last, with a document
as often as the mix takes it.

Defined cases are those of the operators. Further: documents without text are scored like any other; a document whose
lines are all removed goes, one that was empty before stays; rows that repeat the id a group keeps all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, lines, mixing, quality
from tessella.llm.common import cut, free_names, quoted, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")), keep=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that an earlier document holds."""
    held, removed = free_names(docs, 4)[2:]
    done = lines.deduplicate(docs, counts=(held, removed)).where((F.col(removed) < F.col(held)) | (F.col(held) == 0))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*map(quoted, docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by near copies, the one of smallest id."""
    gone = jaccard.groups(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(cut(gone, "near-copies", docs), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(cut(gone, "contaminated", docs), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first two stages have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
