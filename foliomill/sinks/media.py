"""Media of archives as files beside their document's Markdown."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .markdown import write_new


def save(files: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """(path, name, local_path, error): copies the media that sources.documents() found in files (path, content) to
    {stem}_media/{name} in a folder that all executors share. Numbers stay as they are: a medium that cannot be copied leaves a
    gap and gives a row with its error. Nothing is overwritten."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw, media in zip(b["path"], b["content"], b["media"]):
                stem = os.path.splitext(path.rstrip("/").rpartition("/")[2])[0]
                archive = zipfile.ZipFile(io.BytesIO(raw))
                for m in media:
                    target = os.path.join(folder, f"{stem}_media", m["name"])
                    try:
                        write_new(target, archive.read(m["original"]))
                        rows.append((path, m["name"], target, None))
                    except (OSError, KeyError, zipfile.BadZipFile) as e:
                        rows.append((path, m["name"], None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "name", "local_path", "error"])

    found = documents.where("error IS NULL AND size(media) > 0").select("path", "media")
    return files.select("path", "content").join(found, "path").mapInPandas(run, "path string, name string, local_path string, error string")
