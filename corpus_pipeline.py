"""A cleaning pipeline over ``documents``: each stage is one operator of ``tonelake.llm`` and its decisions take effect.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; run()
writes each as Parquet in the folder that driver and executors share and hands the next one the reread table. All but
the last return the columns of ``documents``.

In every stage a null text counts as empty, and a null id is an id like others, only that near-duplicates keep a row with
an id first. All but the last keep further columns as they are, whatever their names. What a stage does with rows that
repeat is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import decontaminate, linededup, shingles, toxicity, wfst
from tonelake.llm.common import keyed, same, small, table
from tonelake.sources.shared import materialize

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the classifier learns from the labels of the documents at hand. Repeated rows stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    score = "".join(["score", *docs.columns])  # no column has this name
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.7).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts; documents of which nothing is left go. Rows that repeat id and text stay, cut
    alike; a text of which nothing was cut stays as it is, null or empty ones included."""
    cut = linededup.dedup_lines(docs, carry=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    whole = F.col("n_removed") == 0
    new = {"text": F.when(whole, F.col("row.text")).otherwise(F.col("text")), "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return cut.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles similar by 0.8 or more stays, the one with the smallest doc_id.
    SimHash fingerprints within two bits give the first links, each checked on the whole sets; what they leave apart is completed by a prefix join.
    Texts without words are one group, and so are repeated rows."""
    return shingles.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values in its slots, go, each with the rows that repeat it."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "rid").distinct()
    found = small(materialize(found, "contaminated"))
    rows = keyed(docs, "doc_id", "text", carry=True).drop("text").alias("a")
    return rows.join(found.alias("b"), same("doc_id", "rid"), "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text, one row per row."""
    return wfst.round_trip(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
