"""Sources and sinks beside parquet tables, and model adapters that are missing here."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "id string, text string, entities array<struct<entity_type:string,start:int,end:int,text:string>>"
ERROR_COLUMNS = ("record_id", "entity_type", "text", "start", "end", "score")
#: Producers of page results and the library that each needs (fixed values); their rows say ``skipped`` without it.
PRODUCERS = {"native_pymupdf": "fitz", "native_pdfplumber": "pdfplumber", "ocr_tesseract_baseline": "pytesseract", "opencv_tesseract": "cv2", "easyocr_baseline": "easyocr", "doctr_baseline": "doctr", "paddleocr_baseline": "paddleocr", "trocr_printed": "transformers", "trocr_handwritten": "transformers", "camelot_lattice": "camelot", "camelot_stream": "camelot", "tabula_lattice": "tabula", "tabula_stream": "tabula", "img2table_tesseract": "img2table", "paddle_structure": "paddleocr", "docling": "docling", "deepdoc_baseline": "deepdoc", "layout_parser": "layoutparser", "claude_vision": "anthropic", "openai_vision": "openai", "gemini_vision": "google.genai", "visual_codes": "cv2"}


def gold_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Annotated records, one JSON object a line; blank and damaged lines are skipped."""
    return spark.read.schema(GOLD).option("mode", "DROPMALFORMED").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    """Lines with anything on them."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).count()


def run_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per saved state file (one JSON object each) with ``path``, the file it came from."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.input_file_name())


def list_documents(spark: SparkSession, folders: dict[str, str], glob: str = "*.pdf") -> DataFrame:
    """(document_id, filename, source, size_bytes, modified) of the files under named folders; contents aren't read."""
    out = None
    for source, path in folders.items():
        name = F.element_at(F.split("path", "/"), -1)
        one = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        one = one.select(F.concat(F.lit(source + ":"), name).alias("document_id"), name.alias("filename"), F.lit(source).alias("source"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folders given")
    return out


def write_predictions(spans: DataFrame, path: str, key: str = "record_id") -> None:
    """One JSON object a record with all its predictions."""
    spans.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "entity_type", "score"))).alias("predictions")).write.mode("overwrite").json(path)


def write_errors(rows: DataFrame, path: str) -> None:
    """CSV with the fixed columns and a header; missing columns and values are empty."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    rows.select(*(cell(c).alias(c) for c in ERROR_COLUMNS)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_results(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Stage events only ever grow."""
    rows.write.mode("append").parquet(path)


def write_mapping(mapping: DataFrame, path: str, key: str) -> None:
    """Stand-ins with their originals encrypted; without a key of 16, 24 or 32 bytes nothing is written."""
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("a mapping is only kept encrypted: give a key of 16, 24 or 32 bytes")
    mapping.select("entity_type", "mock", F.base64(F.aes_encrypt(F.col("original"), F.lit(key))).alias("original")).write.mode("overwrite").parquet(path)


def read_mapping(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("original", F.aes_decrypt(F.unbase64("original"), F.lit(key)).cast("string"))


def unavailable(pages: DataFrame, name: str, library: str, key: str = "page_row_id") -> DataFrame:
    """One row per page for a producer or detector whose library is missing: status ``skipped`` and the reason."""
    return pages.select(key, F.lit(name).alias("producer"), F.lit("skipped").alias("status"), F.lit(f"dependency missing: {library}").alias("reason"))


def producer_rows(pages: DataFrame, key: str = "page_row_id", producers: dict[str, str] | None = None) -> DataFrame:
    """What every producer would do on every page: ``ready``, or ``skipped`` with the missing library."""
    known = producers or PRODUCERS

    def here(library: str) -> bool:
        try:
            return importlib.util.find_spec(library) is not None
        except ModuleNotFoundError:
            return False

    rows = [F.struct(F.lit(p).alias("producer"), F.lit("ready" if here(lib) else "skipped").alias("status"), F.lit("" if here(lib) else f"dependency missing: {lib}").alias("reason")) for p, lib in known.items()]
    return pages.select(key, F.inline(F.array(*rows)))
