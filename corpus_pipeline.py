"""Documents to packed training sequences: a chain of stages, each stored for the next.

Toxic documents go; of each group of near-duplicates (SimHash) the document with the least
id stays; documents with a benchmark passage go; personal data is replaced in the texts;
what is left is packed into sequences, whose token ids the result holds. All stages but the
last return the columns of ``documents``.

Defined cases: of rows of a group that share the least id, and of a group of rows without
id, one stays, by fingerprint and hash of the text; rows without id go through all stages;
a null text is an empty one, which no stage but the near-duplicates drops (all empty texts
are one group) and which is packed as its end id alone; a text of any length is judged,
searched and packed whole, in pieces of at most one sequence; an empty table makes empty
stages; further columns of ``documents``, with whatever names, pass through the stages that
filter, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.llm import decontamination, packing, pii, queries, simhash, tokens, toxicity
from deckflow.llm.common import table
from deckflow.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = simhash.first_rows(docs, shingle=4, distance=4).withColumnRenamed("key", "first_key")
    same = docs["doc_id"].eqNullSafe(first["first_id"]) & (F.xxhash64(docs["text"]) == first["first_key"])
    stay = docs.join(first, same, "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    length_col = "n_chars" if "n_chars" in docs.columns else None
    return pii.redact(docs, pii.train(docs), length_col=length_col)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(materialize(packing.pieces(docs, tokens.word_bpe(), keep_ids=True), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
