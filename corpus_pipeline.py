"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a
DataFrame; run() writes each one's result as Parquet and gives it to the next.

Defined results: only the columns of `documents` are read, so others, whatever their names, are left behind;
a null or empty text is not toxic, is nobody's copy, and is packed as an end token alone; rows with a null
id all stay; rows that share an id are one document, which stays or goes with all its texts,
each of them once (with the least lang, source and n_chars); empty tables give empty tables; without labels
nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import decontaminate, neardup, packing, secrets, toxicity
from rillmark.llm.cluster import Scratch
from rillmark.session import lean, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ready(spark: SparkSession) -> None:
    """Workers know this package, and stages don't hold the memory of those before them."""
    ship(spark)
    lean(spark)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    _ready(spark)
    weights = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs.select(*COLUMNS), weights)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near-duplicates (five words, 0.8), each of its texts once; rows without an id stay."""
    _ready(spark)
    docs = docs.select(*COLUMNS)
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    once = named.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return once.union(docs.where("doc_id is null")).select(*COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut from the texts; n_chars follows."""
    _ready(spark)
    cut = decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; n_chars follows."""
    _ready(spark)
    return secrets.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    _ready(spark)
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", one_of_each_group),
    ("decontamination", benchmark_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_paths(scratch.paths[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
