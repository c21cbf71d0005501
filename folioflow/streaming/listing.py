"""A folder's listing as a stream with a cursor: pages in the order of their keys, and a batch ends after the page in which enough was found.

The offset is the cursor, the last key that was listed, so a stream that is started anew goes on behind it and no
key is told twice. Listing is what a driver does in any case; a batch holds a bounded number of pages.
"""

from __future__ import annotations

import bisect
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..sources.reader import listed

SCHEMA = "key string, length bigint, modified_us bigint"
#: Objects of a page, and how many a batch wants.
PAGE, MOST = 250, 500
#: Seconds for which a folder's listing serves the pages of one run: else each batch would list the whole folder.
KEPT = 60


class Listing(DataSource):
    """Options: path (a folder), pageSize, most (files of a batch; it ends after the page in which they are reached), olderThan (microseconds since 1970: only files modified before count, all are told)."""

    @classmethod
    def name(cls) -> str:
        return "document_listing"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> Cursor:
        older = self.options.get("olderThan")
        return Cursor(self.options["path"], int(self.options.get("pageSize", PAGE)), int(self.options.get("most", MOST)), None if older is None else int(older))


class Cursor(SimpleDataSourceStreamReader):
    def __init__(self, path: str, page: int, most: int, older: int | None):
        self.path, self.page, self.most, self.older = path, page, most, older
        self.found: list[tuple[str, int, int]] = []
        self.until = 0.0

    def behind(self, after: str) -> int:
        """Where in the folder's listing what lies behind a cursor begins; it is listed anew when the listing is old or used up."""
        place = lambda: bisect.bisect_right(self.found, after, key=lambda f: f[0])
        at = place()
        if at == len(self.found) or time.monotonic() > self.until:
            base = self.path.rstrip("/") + "/"
            self.found = sorted((f.path.removeprefix(base), f.length, f.modified) for f in listed(self.path))
            self.until = time.monotonic() + KEPT
            at = place()
        return at

    def initialOffset(self) -> dict:
        return {"after": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next pages, up to the one in which the wanted number is reached, and the cursor behind them."""
        begin = end = self.behind(start["after"])
        counted = 0
        while end < len(self.found) and counted < self.most:
            page = self.found[end : end + self.page]
            counted += sum(self.older is None or f[2] < self.older for f in page)
            end += len(page)
        return iter(self.found[begin:end]), {"after": self.found[end - 1][0] if end > begin else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch once more, after a failure."""
        return iter([f for f in self.found[self.behind(start["after"]) :] if f[0] <= end["after"]])

    def commit(self, end: dict) -> None:
        """Nothing is kept but the cursor, which is in the stream's checkpoint."""


def listing_stream(spark: SparkSession, folder: str, page: int = PAGE, most: int = MOST, older_than: int | None = None) -> DataFrame:
    """key, length, modified_us of the files below folder, page by page."""
    spark.dataSource.register(Listing)
    stream = spark.readStream.format("document_listing").option("pageSize", page).option("most", most)
    return (stream if older_than is None else stream.option("olderThan", older_than)).load(folder)
