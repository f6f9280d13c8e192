"""Sources that need outside libraries or services: interfaces that say clearly what is missing."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.patterns import OCR_LANGUAGES, UPLOAD_GLOB

EXTRACTED = "path string, page_num long, elem_idx long, elem_type string, content string, x0 double, y0 double, x1 double, y1 double, confidence double"


class MissingLibrary(RuntimeError):
    """The library behind a source isn't installed."""


def need(library: str) -> object:
    """Import a library, or say which source lacks it."""
    try:
        return importlib.import_module(library)
    except ImportError as error:
        raise MissingLibrary(f"this source needs the Python library {library!r}, which is not installed") from error


def binary_files(spark: SparkSession, folder: str, pattern: str = UPLOAD_GLOB) -> DataFrame:
    """Uploads as (path, modificationTime, length, content, document_id, file_hash), one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("document_id", F.substring(F.sha2("content", 256), 1, 16)).withColumn("file_hash", F.md5("content"))


def check_request(dpi: int, lang: str) -> None:
    """The limits of a conversion request."""
    if not 150 <= dpi <= 600:
        raise ValueError("DPI must be between 150 and 600")
    if lang not in OCR_LANGUAGES:
        raise ValueError(f"language must be one of {', '.join(OCR_LANGUAGES)}")


def extract(files: DataFrame, make: Callable[[], Callable[[str, bytes], list[dict]]]) -> DataFrame:
    """Run an extractor over files: `make` loads its model once per task and returns a function of (path, content) to element rows.

    A file that fails yields one row of type `error` with the reason rather than ending the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        names = [x.split()[0] for x in EXTRACTED.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += extractor(path, content)
                except Exception as error:  # noqa: BLE001  the page stays, marked as failed
                    rows.append({"path": path, "page_num": 0, "elem_idx": 0, "elem_type": "error", "content": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def digital_extractor() -> Callable[[str, bytes], list[dict]]:
    """Text blocks of digital PDFs by PyMuPDF."""
    fitz = need("fitz")

    def run(path: str, content: bytes) -> list[dict]:
        out = []
        for number, page in enumerate(fitz.open(stream=content, filetype="pdf"), 1):
            for k, (x0, y0, x1, y1, text, *_) in enumerate(page.get_text("blocks")):
                out.append({"path": path, "page_num": number, "elem_idx": k, "elem_type": "text", "content": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "confidence": 1.0})
        return out

    return run


def ocr_extractor() -> Callable[[str, bytes], list[dict]]:
    """Lines of page images by RapidOCR."""
    engine = need("rapidocr_onnxruntime").RapidOCR()

    def run(path: str, content: bytes) -> list[dict]:
        found, _ = engine(content)
        out = []
        for k, (box, text, score) in enumerate(found or []):
            xs, ys = [p[0] for p in box], [p[1] for p in box]
            out.append({"path": path, "page_num": 1, "elem_idx": k, "elem_type": "text", "content": text, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "confidence": float(score)})
        return out

    return run


def with_retries(call: Callable[[], object], tries: int = 5, first_wait: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call a service inside a task: waits double from first_wait, and the last error is raised."""
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if attempt == tries - 1:
                raise
            sleep(first_wait * 2**attempt)
    raise ValueError("tries must be at least 1")


def model_request(model: str, images: list[str], prompt: str, max_tokens: int = 16_000) -> str:
    """The JSON body of one vision call for all pages, given as base64 PNGs."""
    parts = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/png;base64,{x}"}} for x in images)]
    return json.dumps({"model": model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": parts}]})


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State files as rows; a corrupt file gives nulls and its text in _corrupt_record instead of an error."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def model_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A saved catalogue of models (a JSON list) with costs as numbers; what is no number is null."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.withColumn("input_price", F.expr("try_cast(input_cost AS DOUBLE)")).withColumn("output_price", F.expr("try_cast(output_cost AS DOUBLE)"))
