"""A Python data source that writes documents as files, all of a job or none.

Every task stages its files beside their final names; the job's commit renames them, its abort removes them, so that a
failed job leaves the bundle from before.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cuelake.session import mounted


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class BundleWriter(DataSourceWriter):
    """Rows are (path, content): a path relative to the folder, and the text to put there."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> Staged:
        staged: list[tuple[str, str]] = []
        root = mounted(self.folder).resolve()
        try:
            for row in iterator:
                target = (root / row.path).resolve()
                if root not in target.parents:
                    raise ValueError(f"{row.path} leads out of the folder")
                target.parent.mkdir(parents=True, exist_ok=True)
                temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}.tmp")
                staged.append((str(temporary), str(target)))
                with temporary.open("w", encoding="utf-8", newline="") as f:
                    f.write(row.content)
                    f.flush()
                    os.fsync(f.fileno())
        except BaseException:
            self._remove(staged)
            raise
        return Staged(staged)

    @staticmethod
    def _remove(staged: list[tuple[str, str]]) -> None:
        for temporary, _ in staged:
            Path(temporary).unlink(missing_ok=True)

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for temporary, target in m.files if m else ():
                os.replace(temporary, target)

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m:
                self._remove(m.files)


class Bundles(DataSource):
    """``df.write.format("bundles").option("path", folder).mode("append").save()``; the folder must be shared by all."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> BundleWriter:  # noqa: ANN001
        return BundleWriter(self.options["path"])
