"""Old office formats by way of a converter."""

from __future__ import annotations

import io
import os
import subprocess
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# What an old format becomes and a member its archive must have.
TARGETS = {"doc": ("docx", "word/document.xml"), "xls": ("xlsx", "xl/workbook.xml"), "ppt": ("pptx", "ppt/presentation.xml")}
SECONDS = 180


def valid(content: bytes, target: str) -> bool:
    """Whether a converter's output is an archive with the format's main part."""
    member = next(m for t, m in TARGETS.values() if t == target)
    try:
        return bool(content) and member in zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return False


def office_converter(program: str = "soffice", seconds: int = SECONDS) -> Callable[[bytes, str, str], bytes]:
    """Convert with an office program on the executor: (content, from, to) -> content."""

    def run(content: bytes, old: str, new: str) -> bytes:
        with tempfile.TemporaryDirectory() as folder:  # this task's own scratch, gone when it ends
            path = os.path.join(folder, f"in.{old}")
            with open(path, "wb") as f:
                f.write(content)
            subprocess.run([program, "--headless", "--convert-to", new, "--outdir", folder, path], check=True, timeout=seconds, capture_output=True)
            with open(os.path.join(folder, f"in.{new}"), "rb") as f:
                return f.read()

    return run


def converted(df: DataFrame, convert: Callable[[bytes, str, str], bytes] | None) -> DataFrame:
    """(path, content, original_format, converted_format, status, error, duration_ms) of (path, content): old formats converted, others as
    they are with a null status. Without a converter, or if it fails, content is null and the status failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                old = path.rpartition(".")[2].lower()
                if old not in TARGETS:
                    rows.append((path, raw, None, None, None, None, None))
                    continue
                new, begun = TARGETS[old][0], time.monotonic()
                out, error = None, "CONVERTER_NOT_AVAILABLE"
                if convert is not None:
                    try:
                        out = convert(raw, old, new)
                        error = None if valid(out, new) else "CONVERSION_OUTPUT_INVALID"
                    except Exception as e:  # a file that cannot be converted is a row
                        error = f"CONVERSION_FAILED: {type(e).__name__}"
                rows.append((path, None if error else out, old, new, "failed" if error else "success", error, int((time.monotonic() - begun) * 1000)))
            yield pd.DataFrame(rows, columns=["path", "content", "original_format", "converted_format", "status", "error", "duration_ms"]).astype({"duration_ms": "Int64"})

    return df.select("path", "content").mapInPandas(run, "path string, content binary, original_format string, converted_format string, status string, error string, duration_ms long")
