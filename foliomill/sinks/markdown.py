"""Markdown and JSON files of results, written whole or not at all and never over existing ones."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def write_new(path: str, data: bytes) -> None:
    """Write a file that must not exist: a temporary file beside it, synced, linked to its name, read back. A run of the same
    task that wrote the same bytes before counts as done."""
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == data:
                return
        raise FileExistsError(path)
    fd, temp = tempfile.mkstemp(prefix="." + os.path.basename(path)[:100] + ".", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, path)  # fails where the name has come to exist, which a rename would not
        except FileExistsError:
            with open(path, "rb") as f:
                if f.read() != data:
                    raise
        with open(path, "rb") as f:
            if f.read() != data:
                os.unlink(path)
                raise OSError(f"{path} does not hold what was written")
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def save(rows: DataFrame, folder: str) -> DataFrame:
    """(name, md_path, json_path, save_status, error): writes rows (name, markdown, json) as name.md and name.json into a folder that
    all executors share. If the second file fails the first is taken back. A failure is a row. Equal names: the first to be
    written stays, others fail unless their bytes are the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, md, js in zip(b["name"], b["markdown"], b["json"]):
                paths = [(os.path.join(folder, f"{name}.md"), md or "")] + ([(os.path.join(folder, f"{name}.json"), js)] if js is not None else [])
                done: list[str] = []
                try:
                    for path, text in paths:
                        fresh = not os.path.exists(path)
                        write_new(path, text.encode("utf-8", "surrogatepass"))
                        done += [path] * fresh
                    out.append((name, paths[0][0], paths[1][0] if len(paths) > 1 else None, "saved", None))
                except OSError as e:
                    for path in done:
                        os.unlink(path)
                    out.append((name, None, None, "failed", f"保存失败: {e}"))
            yield pd.DataFrame(out, columns=["name", "md_path", "json_path", "save_status", "error"])

    return rows.select("name", "markdown", "json").mapInPandas(run, "name string, md_path string, json_path string, save_status string, error string")
