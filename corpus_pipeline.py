"""A corpus from raw documents to token counts, in five stages over the documents table.

Each stage takes all that the one before it kept; run() writes every stage's rows as Parquet into the
shared folder and reads them again, so that a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.bpe import encode_decode
from codelattice.llm.frames import read, stored
from codelattice.llm.language_id import held_out, recognised, train
from codelattice.llm.minhash import without_near_duplicates
from codelattice.llm.mixing import mix
from codelattice.llm.registry import tokenizer_path
from codelattice.llm.suffix_dedup import repeated_passages, without_repeats


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of all languages reject, or that have no letter, go.

    Defined results: null texts go; without any labelled row every text with a letter stays; repeated rows stay as often
    as they come; other columns, whatever their names, are carried along; an empty table stays empty.
    """
    return recognised(docs, train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in five-word shingles by 0.8 or more stays.

    Defined results: of rows that agree in id and text one stays; an id with two texts is two documents; null and blank texts and
    rows without an id stay; other columns, whatever their names, are carried along; an empty table stays empty.
    """
    return without_near_duplicates(docs, k=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one place only.

    Defined results: rows without an id are left alone; null texts, blank ones and those that nothing is left of go; n_chars, if
    there is such a column, follows the new text, all others are carried along; an empty table stays empty.
    """
    return without_repeats(docs, repeated_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or doubled, so that the sources meet their targets.

    Defined results: a null text or one without a word has size 0 and goes with the rate of its source; a null source is a source
    of its own; repeated rows count each; other columns, whatever their names, are carried along; an empty table stays empty.
    """
    copies = mix(docs, carry=True).select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy.

    Defined results: a null text is empty and has no token; each row gives one row; other columns go; an empty table gives an empty one.
    """
    return encode_decode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language", recognise_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL can't express the language models and the minimisers; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
