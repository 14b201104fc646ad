"""The corpus pipeline: toxicity filter, line dedup, near-dedup, mixing and BPE coding of ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, extra ones included, whatever
their names. An empty table goes through every stage and stays empty. Rows without an id go through all of them: they are
never held out, take nothing from others, and stay in near_dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm import bpe, lines, mixing, similar, toxicity
from foldcast.llm.common import Workspace, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart`` and all others in one, so that none of them clashes with a column that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, (F.struct(*rest) if rest else F.lit(None)).alias("row"))


def _unpacked(packed: DataFrame, docs: DataFrame, *apart: str) -> DataFrame:
    return packed.select(*[F.col(c) if c in apart else F.col(f"row.`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the machine is fitted on the labels that are not held out.

    A null text is scored as an empty one, a very long one whole; equal texts get equal scores, and repeated rows go or stay
    together. Without labels of both kinds nothing is learned and no document goes unless most labels are toxic.
    """
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs, "text"), machine).filter("predicted = 0"), docs, "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text. No document goes.

    A null text stays null, with a null n_chars; texts of under three lines stay. Repeated rows of one id and text are one
    document and keep the same lines each; of equal windows in several documents the smallest id keeps its lines.
    """
    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts with a five-word shingle similarity of 0.8 or more.

    Pairs come from SimHash bit blocks with pivot tables and, most of them, from MinHash band buckets, as few links are in
    reach of the blocks; all pass the fingerprints' distance and are verified on the shingles. Of repeated rows of one id
    and text one stays; texts with one id but different words are judged by their own words, and of a tie between them the
    smaller hash of the text stays. Null texts and texts without words are copies of each other.
    """
    return similar.keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate and their id's hash say, in a global shuffle.

    A null source is a source of its own; null and empty texts count no characters; repeated rows are drawn alike.
    """
    return _unpacked(mixing.mix(_packed(docs, "doc_id", "source", "text")), docs, "doc_id", "source", "text")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text that the ids decode to; a row for each row, no ids for a null or empty text."""
    out = bpe.encode(docs, TOKENIZER)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A fitted machine and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    ws, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = ws.save(out, name)
        ws.release()
        if i:
            ws.drop(STAGES[i - 1][0])
    raise AssertionError


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
