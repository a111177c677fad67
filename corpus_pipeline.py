"""The corpus pipeline: from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet to the shared folder and reads them again as the
next stage's documents. All stages but the last return the columns they got.

- toxicity: documents whose probability of being toxic, by the labels of the
  training folds, is 0.3 or more go.
- near_duplicates: of each component of near duplicates (five-word shingles,
  similarity 0.75) the document of the smallest id stays.
- decontamination: documents in which a benchmark window of ten words occurs go.
- mixing: sources are mixed to target weights; the rows come in training order,
  a document as often as the mix takes it, the last partial time if over half
  of it is taken.
- token_files: the rows are tokenised and written as flat binary files, in the
  order in which they lie in the Parquet files read: the training order. Rows
  that come from elsewhere are written in ascending doc_id. Returns doc_id,
  start, n_tokens, ids_crc32, read back from the files.

Defined cases: null and empty texts aren't toxic, have no copies and no
benchmark windows, and are taken no words by the mix, so they go there; rows
without an id pass all stages but are never copies of another; repeated rows
of an id are one document after near_duplicates; an empty table passes as an
empty table, and so does one without labels or benchmark items; columns beyond
doc_id, text and source pass untouched, whatever their names.

SQL can't express the first stage (a trained model), so ORACLE_SQL is None and
the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.llm.decontamination import decontaminated
from veritrove.llm.jaccard_join import deduplicated
from veritrove.llm.mixing import curriculum
from veritrove.llm.queries import word_vocabulary
from veritrove.llm.shared import stored, table
from veritrove.llm.tokens import token_files
from veritrove.llm.toxicity import fit, remainder, toxicity

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2))
    return toxicity(docs, model).where(F.col("found.score") < TOXIC_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum(docs)


def reading_order(docs: DataFrame) -> list[Column] | None:
    """Columns by which rows read from Parquet files stand as they were written; None for other rows."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(file, row)
    except AnalysisException:
        return None
    return [F.regexp_extract(file, "part-(\\d+)", 1).try_cast("int"), file, row]


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, word_vocabulary(), order=reading_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL: str | None = None
