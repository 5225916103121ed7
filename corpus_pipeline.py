"""The corpus pipeline: language ID, near-duplicate removal, mixing, tokenization.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the next stage's rows. Every stage but the last returns
the columns of ``documents``. :func:`run` writes each stage to the shared folder as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import common
from iolens.llm.language_id import UNKNOWN, fit, identify
from iolens.llm.mixing import ANCHOR, WEIGHTS, label_domain, mix_rates
from iolens.llm.neardup import near_duplicates
from iolens.llm.queries import held_out
from iolens.llm.sentencepieces import encode_texts

#: The stage's near duplicates: texts whose word shingles have a similarity of 0.8 or more.
STAGE_LINK_NUM = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rejected are texts with less than this share of letters in scripts of the learned languages,
LEAST_KNOWN = 0.5
#: and those whose letters are on average by so much (natural logarithm) less likely than letters of training rows.
#: No document of sf0.1 and check_s is below -9.1; letters drawn at random are at -19 and less.
LEAST_FIT = -12.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_known: float = LEAST_KNOWN, least_fit: float = LEAST_FIT) -> DataFrame:
    """Documents with a language; ``lang`` becomes the prediction. Rejected are null texts, texts without a letter and texts that no language fits (see LEAST_KNOWN and LEAST_FIT; 0 and
    minus infinity reject none of these). A text in several learned languages fits, however many they are. Repeated rows stay.
    """
    got = identify(docs, fit(docs.where(~held_out())), {c: F.col(c) for c in COLUMNS}, with_fit=True)
    kept = got.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least_known) & (F.col("fit") >= least_fit))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str, link_num: int = STAGE_LINK_NUM) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, and of repeated rows with equal id and text one row.

    Rows without an id take part under a stand-in made of their text, larger than any id, so that a copy with an id is kept before them; they come out without an id again. Different
    texts of one id count as one document: they stay or go together. Null, empty and wordless texts are no copies of each other; of equal ones without an id one row stays.
    """
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    docs = docs.select(*COLUMNS).withColumn("__id", F.coalesce("doc_id", stand_in))
    found = near_duplicates(docs.select("__id", "text"), id_col="__id", link_num=link_num)
    gone = found.where(~F.col("kept")).select("__id").distinct()
    often = found.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id")
    kept = docs.join(gone, "__id", "left_anti")
    # repeated rows are few or copies: one of each is gathered before anything is shuffled
    once = kept.join(often, "__id", "left_anti")
    first = kept.join(often, "__id", "left_semi").groupBy("__id", F.xxhash64("text").alias("h")).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.select(*COLUMNS).unionByName(first)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: a rate below one may drop it, one above may repeat it.

    Null, empty and wordless texts have no tokens; they go by the labels' shares like any text that says nothing. Without labels, or of an empty table, all stay.
    """
    rated = mix_rates(docs, common.table(spark, sf_dir, "labels"), label_domain(), WEIGHTS, anchor=ANCHOR, keep=tuple(COLUMNS))
    taken = rated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digest and number, and the decoded text's digest, of every document. Null and empty texts have no token and the digests of nothing; repeated rows stay."""
    return encode_texts(docs, common.tokenizer_file("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("minhash_neardup", near_duplicate_removal),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: Neither a trained classifier nor MinHash, projected gradients or a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not given:
            common.discard(before)  # the next stage's table is durable
    return STAGES[-1][1](spark, docs, sf_dir)
