"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet in the shared folder and read again as the next one's docs,
so a lost executor never costs more than a stage.

1. quality: documents that the factorisation machine rejects go.
2. near-dedup: of each near-duplicate class the document with the least id stays
   (rows that share an id are one document).
3. suffix-dedup: bytes in a 100-byte string that also starts earlier are cut out
   of the text, with any character that a cut would split; n_chars is counted anew.
4. decontamination: documents contaminated by the benchmark go.
5. packing: the texts become sequences of at most 1024 tokens.

Null texts count as empty, null ids are kept, an empty table passes all stages.
SQL cannot express a trained classifier or a byte-pair encoding, so there is no
ORACLE_SQL; tests compare the stages with brute force on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit.llm.dart_minhash import near_duplicates
from churnkit.llm.fm_classifier import classify
from churnkit.llm.shared import row_id, staged
from churnkit.llm.suffix_dedup import remove_repeats
from churnkit.llm.swap_packing import pack_documents
from churnkit.llm.winnow_decontam import contamination

QUALITY_THRESHOLD = 0.7
TOKENIZER = "byte_bpe_50k.json"


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and the members of ``extra`` as the columns of ``docs``, in its order."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("extra")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify(docs, labels, QUALITY_THRESHOLD, carry=_rest(docs) or ["doc_id"])
    return _unpacked(judged.where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_duplicates(docs, threshold=0.8)
    first = classes.where(F.col("did") == F.col("class_id")).select("did").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_id("doc_id", "text").alias("did"))
    nth = F.row_number().over(Window.partitionBy("did").orderBy(F.col("row")["text"]))
    return keyed.join(first, "did").withColumn("nth", nth).where("nth = 1").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = remove_repeats(docs, span=100, carry=_rest(docs) or ["doc_id"], as_text=True)
    out = _unpacked(kept.withColumnRenamed("kept", "text"), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return judged.where(~F.col("contaminated")).select("extra.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near-dedup", near_dedup), ("suffix-dedup", suffix_dedup),
          ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
