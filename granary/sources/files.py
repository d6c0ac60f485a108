"""Raw texts, question sets and staged tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA = "id string, type string, question string, gold_chunk_ids array<string>, gold_answer_points array<string>"


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text) of the .txt files of a folder."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processor document."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join("\t" if t.tag == f"{space}tab" else t.text or "" for t in p.iter() if t.tag in (f"{space}t", f"{space}tab")) for p in root.iter(f"{space}p")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines))


def docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    @F.udf("string")
    def read(content):
        return docx_text(bytes(content))

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), read("content").alias("text"))


def qa(spark: SparkSession, path: str) -> DataFrame:
    """A question set of JSON lines; blank lines are skipped."""
    return spark.read.schema(QA).json(path)


def write_stage(df: DataFrame, path: str) -> None:
    """Write a stage's table; Spark's _SUCCESS marks it complete."""
    df.write.mode("overwrite").parquet(path)


def stage_complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    if not stage_complete(spark, path):
        raise RuntimeError(f"{path} isn't complete")
    return spark.read.parquet(path)
