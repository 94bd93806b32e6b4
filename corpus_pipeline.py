"""A training-data pipeline over the documents table: each stage takes the documents that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents, in their order; extra columns are kept, and columns that a stage computes are taken out again.
Empty tables, null texts and repeated rows pass through every stage as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locavec.llm import decontam, jaccard, langid, packing, quality
from locavec.llm.common import remainder, table
from locavec.session import cut_lineage

#: Columns that stages add and take out again.
_ADDED = ("__lang", "__near", "__score", "__good")
_ROW, _MAYBE = "__row_number", "__maybe"
#: Bytes of a batch of rows on its way to a Python worker. Spark's own bound is 10 000 rows, of any length.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` in a session that bounds its batches; a bound that the session has already stays."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; profiles are learned from the ``lang`` of the documents themselves."""
    judged = langid.identify(docs, langid.learn(docs.where(remainder("doc_id", 4) != 2)), out=_ADDED[:2])
    return judged.where(langid.accepted(*_ADDED[:2])).select(*docs.columns)


@small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text").where(remainder("doc_id", 3) != 1).join(labels, "doc_id"))
    return quality.score(docs, model, out=_ADDED[2:]).where(F.col(_ADDED[3]) == 1).select(*docs.columns)


@small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows the one with the smallest doc_id (null last), the first such row; rows equal in doc_id and text count once.

    Rows are told apart by a written row number, so that neither a repeated nor a null doc_id ties rows together. Rows with a null
    doc_id and a text without words are no repetitions.
    """
    rows = cut_lineage(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    sizes, groups = jaccard.join(rows.select(_ROW, "text"), key=_ROW)
    groups = cut_lineage(groups.join(rows.select(_ROW, "doc_id"), _ROW), "groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(_ROW).alias("row"))
    first = groups.groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.row").alias(_ROW))
    # equal texts with words are linked; what is left are repetitions of texts without any
    empty = sizes.where("n_shingles = 0").select(_ROW)
    blank = rows.select(_ROW, "doc_id", "text").where("doc_id IS NOT NULL")
    blank = jaccard.marked(blank, empty, _MAYBE, _ROW).where(_MAYBE).drop(_MAYBE).join(empty, _ROW, "left_semi")  # other texts are not shuffled
    once = blank.groupBy("doc_id", "text").agg(F.min(_ROW).alias(_ROW)).select(_ROW)
    drop = groups.select(_ROW).join(first, _ROW, "left_anti").union(blank.select(_ROW).join(once, _ROW, "left_anti"))
    drop = cut_lineage(drop, "dropped")
    # only texts that may have to go are shuffled
    seen = jaccard.marked(rows, drop, _MAYBE, _ROW)
    return seen.where(~F.col(_MAYBE)).select(*docs.columns).union(seen.where(_MAYBE).join(drop, _ROW, "left_anti").select(*docs.columns))


@small_batches
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Columns are numbered on the way: none then has a name that ``find`` replaces, and each text goes to the Python workers once.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = decontam.find(docs.toDF(*names), table(spark, sf_dir, "benchmark"), text=names[docs.columns.index("text")])
    return found.where(F.size("hits") == 0).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of 2048 tokens."""
    out = packing.pack(docs.select("doc_id", "text"), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed),
]
#: Learned models and a tokenizer have no SQL counterpart; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
