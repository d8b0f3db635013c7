"""A resumable source of archived pages, chained by their resumption tokens.

A page is an XML file of records. All but the last name, in a resumption token,
the page that follows. The source replays an archive of such pages in order of
their paths: its offset is the last page read with the token that it states, so
a query that stops after page k goes on at page k + 1, with pages that came in
the meantime. A micro-batch reads its pages in parallel, one a task while they
are few and up to ``PAGES_A_TASK`` where they are many, and the records of a
page one after the other. The driver opens pages only for their tokens, each
once and several at a time.

Files are opened through Arrow's file systems, by plain path or URI, in
whatever store driver and executors share. Nothing is fetched over a network
of providers: an archive that grows is the stream.

Defined results: an empty folder gives no rows and waits; deleted records are
left out here, as their header says, and so are pages' other contents; a page
after one without a token is an error, as it would belong to another harvest;
so is an archive whose page no longer states the token that the offset has.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages that a task reads, at most, and tasks up to which each reads one.
PAGES_A_TASK, TASKS = 64, 64
#: Pages that the driver opens at a time for their tokens.
OPENED = 16
TOKEN = re.compile(rb"<(?:\w+:)?resumptionToken[^>]*>([^<]*)</")


def _opened(path: str) -> tuple:
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def pages_of(path: str) -> list[str]:
    """The files below a folder in order, without those that are hidden or being written."""
    from pyarrow import fs

    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    inside = (x.path[len(root.rstrip("/")) :] for x in found if x.type == fs.FileType.File and x.size)
    return [root.rstrip("/") + x for x in sorted(inside) if not re.search(r"/[._]", x)]


def read_page(path: str, inside: str) -> bytes:
    """The bytes of a page of the archive ``path``, gzipped or not."""
    store, _ = _opened(path)
    with store.open_input_stream(inside, compression=None) as held:
        content = held.read()
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def token_of(page: bytes) -> str:
    """The resumption token that a page states; empty if it is the last."""
    found = TOKEN.search(page)
    return found[1].decode().strip() if found else ""


def records_of(page: bytes) -> Iterator[str]:
    """The XML of each record that is not deleted."""
    from io import BytesIO
    from xml.etree import ElementTree as ET

    for _, element in ET.iterparse(BytesIO(page)):
        if element.tag.rpartition("}")[2] != "record":
            continue
        header = next((x for x in element if x.tag.rpartition("}")[2] == "header"), None)
        if header is None or header.get("status") != "deleted":
            for x in element.iter():  # names without their spaces, as the schema has them
                x.tag = x.tag.rpartition("}")[2]
            yield ET.tostring(element, encoding="unicode")
        element.clear()


@dataclass
class Page(InputPartition):
    """A page, by its number from 1, and those that follow it in the same task."""

    number: int
    inside: str
    more: tuple[str, ...] = ()


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.tokens: list[str] = []

    def initialOffset(self) -> dict:
        return {"page": 0, "token": ""}

    def _told(self, number: int, pages: Sequence[str]) -> str:
        """The token of a page; those of pages before it are known then, too."""
        known = len(self.tokens)
        if known < number:
            with ThreadPoolExecutor(OPENED) as pool:
                self.tokens += pool.map(lambda inside: token_of(read_page(self.path, inside)), pages[known:number])
            for k in range(max(known, 1), number):
                if not self.tokens[k - 1]:
                    raise ValueError(f"page {k} of {self.path} is the last of its harvest, but others follow")
        return self.tokens[number - 1] if number else ""

    def latestOffset(self) -> dict:
        pages = pages_of(self.path)
        return {"page": len(pages), "token": self._told(len(pages), pages)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pages = pages_of(self.path)
        if len(pages) < end["page"] or self._told(start["page"], pages) != start["token"]:
            raise ValueError(f"{self.path} is not the archive of which {start['page']} pages were read")
        each = min(PAGES_A_TASK, -(-(end["page"] - start["page"]) // TASKS))
        return [Page(k + 1, pages[k], tuple(pages[k + 1 : min(k + each, end["page"])])) for k in range(start["page"], end["page"], each or 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for number, inside in enumerate((partition.inside, *partition.more), partition.number):
            for place, record in enumerate(records_of(read_page(self.path, inside))):
                yield number, place, record


class PageSource(DataSource):
    """``spark.readStream.format("archived_pages").load(folder)``: page, place (from 0, among those kept), record."""

    @classmethod
    def name(cls) -> str:
        return "archived_pages"

    def schema(self) -> str:
        return "page int, place int, record string"

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive's pages, page after page."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("archived_pages").load(path)
