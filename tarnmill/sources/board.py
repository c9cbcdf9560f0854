"""A board of postings as a Spark data source, for batch and stream: one partition per keyword and page.

    spark.dataSource.register(BoardSource)
    spark.read.format("board").option("fetch", "package.module:function").option("keywords", '["ai"]').option("pages", 3).load()

``fetch(keyword, page, options)`` yields mappings lazily, in the tasks; ``check(options)``, if named, runs before a
scan and returns why there can be none, or nothing; ``latest(options)`` tells a stream how many pages there are.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELDS = ("title", "company", "url", "location", "posted", "description")
ROWS_PER_BATCH = 1_000
_ARROW = pa.schema([("keyword", pa.string()), ("page", pa.int32()), ("seq", pa.int64()), *((f, pa.string()) for f in FIELDS), ("problem", pa.string())])


@dataclass
class Part(InputPartition):
    keyword: str
    page: int


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _fetched(part: Part, options: dict) -> Iterator[tuple]:
    """The rows of a part; one that fails gives what came before, then a row that names the problem."""
    seq = 0
    try:
        for found in _named(options["fetch"])(part.keyword, part.page, options):
            yield (part.keyword, part.page, seq, *(found.get(f) for f in FIELDS), None)
            seq += 1
    except Exception as e:  # the source is foreign code: a page of it must not end the scan
        yield (part.keyword, part.page, seq, *(None for _ in FIELDS), f"{type(e).__name__}: {e}")


class _Pages:
    """What batch and stream share: the options, and reading of a part in batches of bounded size."""

    def __init__(self, options: dict):
        self.options = options
        self.keywords = json.loads(options["keywords"])

    def parts(self, start: int, end: int) -> list[Part]:
        return [Part(k, page) for k in self.keywords for page in range(start, end)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows = _fetched(partition, self.options)
        while some := list(islice(rows, ROWS_PER_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(0, int(self.options.get("pages", 1)))


class _Stream(_Pages, DataSourceStreamReader):
    """Offsets count pages; a page that has been read isn't read again, but after a failure before its commit."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": int(_named(self.options["latest"])(self.options))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        pass


class BoardSource(DataSource):
    """``keyword, page, seq, title, company, url, location, posted, description, problem``.

    A row with ``problem`` stands for the rest of a page that failed. A scan doesn't start if no
    keyword is named, if the board asks for a session (``login`` is true) and none is given (``session``), or if the check finds a reason.
    """

    @classmethod
    def name(cls) -> str:
        return "board"

    def schema(self) -> str:
        return "keyword string, page int, seq long, " + ", ".join(f"{f} string" for f in FIELDS) + ", problem string"

    def _ready(self) -> dict:
        options = dict(self.options)
        if not options.get("fetch") or not json.loads(options.get("keywords") or "[]"):
            raise ValueError("a board needs the options fetch and keywords")
        if str(options.get("login", "")).lower() == "true" and not options.get("session"):
            raise ValueError("this board needs a session")
        if options.get("check") and (reason := _named(options["check"])(options)):
            raise ValueError(f"board not available: {reason}")
        return options

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._ready())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._ready())


def stored_pages(keyword: str, page: int, options: dict) -> Iterator[dict]:
    """A ``fetch`` that reads pages kept as Parquet under ``folder``, as ``keyword=<keyword>/page=<page>``; one that isn't there is empty."""
    from pyarrow import dataset, fs

    files, root = fs.FileSystem.from_uri(options["folder"])
    folder = f"{root}/keyword={keyword}/page={page}"
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return
    for batch in dataset.dataset(folder, filesystem=files, format="parquet").to_batches(batch_size=ROWS_PER_BATCH):
        yield from batch.to_pylist()
