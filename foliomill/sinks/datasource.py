"""A data source that writes rows as Markdown files in two phases: tasks write into a hidden folder beside the target, and only the
commit on the driver moves the files in. Nothing is overwritten; an abort leaves nothing behind. The driver gets every file's name, so
this is for batches that a folder can hold; ``markdown.save`` has no such step."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        mine = os.path.join(self.staging, uuid.uuid4().hex)  # each attempt of a task has its own
        os.makedirs(mine, exist_ok=True)
        files = []
        for row in iterator:
            path = os.path.join(mine, f"{row['name']}.md")
            if os.path.exists(path):
                raise FileExistsError(f"two rows are named {row['name']}")
            with open(path, "w", encoding="utf-8", errors="replace") as f:
                f.write(row["markdown"] or "")
            files.append(path)
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        targets = [os.path.join(self.folder, os.path.basename(f)) for f in files]
        taken = [t for t in targets if os.path.exists(t)] or sorted({t for t in targets if targets.count(t) > 1} if len(set(targets)) < len(targets) else ())
        if taken:
            shutil.rmtree(self.staging, ignore_errors=True)
            raise FileExistsError(f"{len(taken)} files exist or are named twice, such as {taken[0]}")
        done = []
        try:
            for f, t in zip(files, targets):
                os.link(f, t)
                done.append(t)
        except OSError:
            for t in done:
                os.unlink(t)
            raise
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class MarkdownFiles(DataSource):
    """df.write.format('markdown_files').mode('append').option('path', folder).save() for rows (name, markdown)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "name string, markdown string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are never overwritten")
        os.makedirs(self.options["path"], exist_ok=True)
        return MarkdownWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownFiles)
