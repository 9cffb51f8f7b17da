"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing; each stage written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, neardup, packing, pii, quality
from tidewater.llm._spark import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels outside the held-out fold.

    Null and empty texts are scored like others (all statistics zero). Rows of a null id and repeated rows are each judged;
    equal texts alike. Without labels every score is 0.5 and nothing stays. Columns beyond those of documents are left out here,
    whatever their names; an empty table stays empty. Texts are held one at a time.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out("doc_id", 4, 2))
    scored = quality.score(docs, quality.train(docs, labels), keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group at a likeness of five-word shingles of 0.8 or more.

    Texts without words (null, empty, blank) all stay. A repeated row and a copy of a null id are copies: one row stays, that of
    an id before that of none. An empty table stays empty. Long texts take 8 bytes a word in memory.
    """
    return neardup.deduplicate(docs).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data replaced by its kind.

    A null text stays null and an empty one empty; rows of a null id and repeated rows are each masked; an empty table stays
    empty. Texts are held whole, their windows some thousands at a time.
    """
    found = pii.find(docs, mask=True, keep=("lang", "source"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.char_length("masked").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each source, as documents; words taken twice are in a second row of their document.

    Null and empty texts hold no words and are left out; a null source is a source of its own; rows of a null id and repeated
    rows are documents each; an empty table stays empty. A text is held whole, as a list of its words.
    """
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens.

    A null or empty text is its closing id alone; rows of a null id and repeated rows are packed each; an empty table gives no
    rows. A text and its ids are held whole.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}-{name.split()[0]}")
    return docs
