"""A training corpus from raw documents, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``. Its result is written as Parquet and reread as
the next stage's documents; all but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects go.
2. near_dedup: of each group of near-duplicates, the document of least id stays.
3. substring_dedup: word windows that an earlier document has are cut out.
4. mix: sources are brought to their target weights; documents are dropped or repeated.
5. pack: documents become token pieces in sequences of 4096; a row for each piece, with its token ids.

Stages drop the scratch tables of the stage before, whose result has been written by then.

Rows decide for themselves: one of two rows with the same doc_id may go while the other, with another text, stays.

- Nulls: a null text is an empty one. Rows without doc_id are near-duplicates of nothing; in stage 3 they come
  last, so earlier documents cut them; a null source is a source of its own.
- Blank texts have no windows and no words: 1 scores them, 2 and 3 let them pass, 4 keeps them once, 5 packs
  one end token for each.
- Rows equal in doc_id and text are one document to 2 (one stays) and to 4 (written as often as the mixture takes
  them together); 3 cuts them alike. What 4 repeats, 5 packs with a ``row`` of its own.
- Ties: 2 keeps the least text hash among rows of one doc_id; 4 and 5 order by seeded hashes.
- Very long texts are scored, compared, cut and tokenised whole; 5 cuts them into pieces of 4096 tokens.
- An empty table gives empty tables all along. Other columns, whatever their names, stay until 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.llm import minhash, mixing, packing, substrings
from lodespar.llm import quality as classifier
from lodespar.llm._shared import documents, forget, new_path, scoped
from lodespar.llm.catalogue import WEIGHTS, tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scoped("stage-quality"):
        return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forget(spark, "stage-quality")
    with scoped("stage-near"):
        return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forget(spark, "stage-near")
    with scoped("stage-substring"):
        return _measured(substrings.remove_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forget(spark, "stage-substring")
    with scoped("stage-mix"):
        return mixing.mix_documents(docs, WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forget(spark, "stage-mix")
    with scoped("stage-pack"):
        return packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=True))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]

#: The classifier is no SQL; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
