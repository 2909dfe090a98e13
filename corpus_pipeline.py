"""The training-data pipeline: quality rules, classifier, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.llm import near_copies, packing, pii, quality_classifier, quality_rules
from skycat.llm.common import quoted, table, tokenizer_file, written


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the clean policy: all rules but the one against short documents.

    Each row is judged by its own text, whatever its doc_id, and keeps all its columns.
    Null, empty and word-free texts fail no rule and stay; long texts are judged whole;
    repeated rows all stay or all go; no rows give no rows.
    """
    return quality_rules.ledger(docs.select("text", F.struct(*map(quoted, docs.columns)).alias("document"))).where(quality_rules.CLEAN.keeps()).select("document.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.3 and more).

    The rules leave few bad documents, so the classifier is fitted on the labelled rows of
    the whole documents table, outside the held-out fold; statistics, not texts, meet the
    labels.  Each row is judged by its own text, so doc_id may be null or repeat; null text
    is scored as empty text; without labels of both classes all rows share one score; extra
    columns stay; no rows give no rows.
    """
    stats = quality_classifier.statistics(table(spark, sf_dir, "documents"))
    model = quality_classifier.fit_on_labels(stats, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.text_score(F.col("text"), model) >= 0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-copy group: the one with the smallest doc_id.

    Groups link texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more; SimHash names the first pairs, an exact join finds those beyond its 3 bits.  Rows
    go by a written key: of repeated rows one stays, and of a group without any doc_id one
    row stays too.  Null, empty and word-free texts form one group.  Extra columns stay,
    whatever their names; no rows give no rows.
    """
    return near_copies.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with surrogates for personal data, and n_chars of the new text.

    Null and repeated doc_ids stay, null text stays null (so does its n_chars), empty and
    very long texts are rewritten whole, equal texts alike; other columns stay; no rows give
    no rows.
    """
    out = pii.replace_personal_data(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in a sequence.

    Each row is packed, whatever its doc_id; null and empty texts give the end id alone;
    texts beyond 2,048 tokens give several pieces; no rows give no rows.
    """
    pieces = packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json"), ids=False, keep=False)
    return packing.pack(written(pieces, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rule_stage), ("quality_classifier", classifier_stage), ("simhash_near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Classifier scores, fingerprints and tokens are not SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
