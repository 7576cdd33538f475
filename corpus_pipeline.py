"""The training-data pipeline: each stage reads what its predecessor wrote. Part of the subpackage quern.llm.

toxicity (documents that score 0.5 or more go), SimHash near-dedup (texts whose
five-word shingles have a similarity of 0.8 or more; the smallest doc_id of each component stays), substring dedup
(repeated spans of 13 words or more are cut; emptied documents go), mixing (documents as often as the mix takes them), BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, common, mixing, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, learned from the labels of sf_dir.

    Null and empty texts score as texts without hits and stay. Repeated rows all stay or all go; null ids, ties and other columns change
    nothing; texts of any length are scored whole. Without labels, and on an empty table, nothing goes.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a similarity of 0.8 or more: that of the smallest id.

    Texts without words, null ones too, are one component. Of repeated rows one stays. Rows without an id stay only where their
    component has no id at all. Texts of any length count whole; other columns pass through. An empty table stays empty.
    """
    return simhash.representatives(docs, grouped=simhash.similar_components)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words of 13-word runs that also stand in a document of a smaller id; n_chars follows the text.

    Documents that lose all words go; null texts and texts without words stay. Rows with a null id neither lose nor take words, rows of one
    id take none from each other. Texts of any length count whole. An empty table stays empty.
    """
    kept = substring.dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, none more than three times.

    A null source is a source. Null texts have size 0. Ties and repeated rows are decided by digests and numbers, as `mixing.mix`
    says; null ids count like others. Texts of any length are whole. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of the text that these decode to.

    Null and empty texts have no tokens. Null ids and repeated rows give a row each; texts of any length are encoded whole. An empty
    table gives an empty result.
    """
    import public_tokenizers

    return bpe.document_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_spans),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Toxicity scores and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; a stage's table goes once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last, docs = docs, common.shared_table(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        common.discard(last)
    return docs
