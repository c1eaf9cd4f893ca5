"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillgrid.llm import line_dedup, minhash_dedup, mixing, pieces, quality_rules, scratch

ORACLE_SQL = None  # suffix arrays, signatures and pieces are beyond SQL; tests/llm compares with brute force
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BATCH = 500  # rows of whole texts that go to a Python worker at once, at most
_scratch: dict[tuple, list] = {}  # by session and folder: the tables of the last stage that was begun, until the one after it begins


def _bounded(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH rows: a batch of texts is in memory several times, in the JVM and in Python, for each running task. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0"))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def _staged(number: int, stage: Callable[[DataFrame], DataFrame], docs: DataFrame, sf_dir: str) -> DataFrame:
    """stage(docs). A stage's rows have been written by the time that the next one of its folder begins; its own tables go then."""
    key = docs.sparkSession.sparkContext.applicationId, sf_dir, number
    _bounded(docs.sparkSession)
    scratch.release(_scratch.pop((*key[:2], number - 1), []))
    with scratch.scope() as held:
        out = stage(docs)
    _scratch[key] = held
    return out


def _lines(docs: DataFrame) -> DataFrame:
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def _encoded(docs: DataFrame) -> DataFrame:
    return pieces.encode(docs, pieces.Vocabulary.load(PIECES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and wordless texts go; rows with a null id or source stay by their text; repeated rows are judged alike; no rows give none."""
    return _staged(0, quality_rules.keep_good, docs, sf_dir)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines; n_chars follows the text. Null texts stay null, a null source counts as one site, repeated rows lose the same lines; no rows give none."""
    return _staged(1, _lines, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Documents without words are linked with nothing and stay; repeated rows of an id stay or go together, rows with a null id stay; no rows give none."""
    return _staged(2, minhash_dedup.keep_one, docs, sf_dir)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, dealt to shards. Null and wordless texts add no words to any target, a null source is one of its own, repeated rows count each; no rows give none."""
    return _staged(3, mixing.mix, docs, sf_dir)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document of the mix, a row for each time that it is taken. Null and empty texts have no piece; no rows give none."""
    return _staged(4, _encoded, docs, sf_dir)


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and reread, and its own tables deleted."""
    _bounded(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in (("quality", quality_rules.keep_good), ("lines", _lines), ("near", minhash_dedup.keep_one), ("mixture", mixing.mix)):
        with scratch.scope() as held:
            rows = stage(docs)
        with scratch.scope() as kept:
            docs = scratch.written(rows, name)
        scratch.release([*held, *before])
        before = kept
    return _encoded(docs)
