"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Language identification drops documents in no learned language; the n-gram Jaccard join keeps one
document of each group of near copies; decontamination drops documents that contain a benchmark
item; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.decontaminate import contaminated
from twinsieve.llm.langid import UNKNOWN, fit, identify
from twinsieve.llm.packing import DIGESTS, digest_pieces, pack_documents
from twinsieve.llm.setjoin import jaccard_components
from twinsieve.llm.tokens import tokenizer_path
from twinsieve.shared import remove, work_dir

#: A document is rejected where no language holds so much of its bytes' probability.
MIN_LANGUAGE_SCORE = 0.4
#: Near copies: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

_NO_ID = -(1 << 63)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns of free names, by which rows of the same id but another text are told apart, and their names."""
    key = _free(docs, "_id", "_hash")
    values = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumns(dict(zip(key, values, strict=True))), key


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _has_words(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: not those without text or letters, nor those that no language fits.

    Null languages, sources and ids decide nothing; null and empty texts go; texts of any length are read whole; each of
    repeated rows is judged by itself; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    pred, score = _free(docs, "lang_pred", "score")
    found = identify(docs, fit(docs), docs.columns, pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, of these the one of least text hash.

    Null ids come last; documents without words (null, empty, white space) are in no group and all stay; of rows equal in id and
    text one stays; texts of any length are compared whole; an empty table gives an empty one; other columns pass through,
    whatever their names.
    """
    groups = jaccard_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("group_id is not null")
    groups = groups.select("group_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("i"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("h"))
    rows, key = _row_key(docs)
    kept = groups.groupBy("group_id").agg(F.min(F.struct("none", "i", "h")).alias("k")).select(F.col("k.i").alias(key[0]), F.col("k.h").alias(key[1]))
    first = rows.where(_has_words("text")).join(kept, key, "left_semi").dropDuplicates(key)
    return first.unionByName(rows.where(~_has_words("text"))).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; null ids are ids like others; texts of any length are searched whole; repeated rows
    stay or go together; an empty table, or an empty benchmark, changes nothing; other columns pass through, whatever their names.
    """
    rows, key = _row_key(docs)
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), extra=key)
    return rows.join(found.select(*key).distinct(), key, "left_anti").select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, as ``pack_documents`` has them: no other columns.

    A null or empty text is its end id alone; null ids stay null; a very long text has many pieces; repeated rows are packed
    each; an empty table gives none.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048, project=digest_pieces, schema=DIGESTS)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can't express the stages; tests hold run() to a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
