"""The document pipeline: each stage takes the rows its predecessor kept, and its decisions take effect."""

from brisktill.llm import linededup, packing, quality, secrets, simhash
from brisktill.sources.staging import staged


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines whose template an earlier document has go, and so do documents left without a word by that."""
    return linededup.drop_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=3, max_distance=2)


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced in the texts."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """Pieces of training sequences along the curve."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# Fingerprints and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over `documents`; every stage's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
