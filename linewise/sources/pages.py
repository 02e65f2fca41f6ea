"""Pages of files as a data source: `spark.dataSource.register(PageItems)`, then `spark.read.format("page_items").option("parser", ...).load(paths)`.

Work is planned by file and range of pages, so a file of many pages is read by many tasks. What a page holds is a parser's matter: an object with `pages(file)`, how many there
are, and `items(file, first, last)`, the (page, seq, str, x, y, width) of pages first to last; `file` is open and can be searched. A parser is named `module:object`
and may wrap any library; the one here reads tables of tab-separated items.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import clean

SCHEMA = "path string, work string, page int, seq int, str string, x double, y double, width double"
#: The height that makes a new line, points of a blank, the most blanks, and what a candidate for a heading is.
NEW_LINE, BLANK_POINTS, MOST_BLANKS, LEFT, SHORTEST, LONGEST = 2.0, 7, 40, 130, 5, 75
NO_CANDIDATE = r"^(FADE|CUT TO|DISSOLVE|MATCH CUT|OMITTED|THE END|CONTINUED|CONT'D|MORE\b)"


class TabbedItems:
    """Pages as lines `page, seq, x, y, width, text`, tab-separated and in order of page; other lines are left out."""

    def _rows(self, file) -> Iterator[tuple]:
        for line in file.read().decode("utf-8", "replace").split("\n"):
            parts = line.rstrip("\r").split("\t", 5)
            if len(parts) == 6:
                try:
                    yield int(parts[0]), int(parts[1]), parts[5], *map(float, parts[2:5])
                except ValueError:
                    continue

    def pages(self, file) -> int:
        return max((r[0] for r in self._rows(file)), default=0)

    def items(self, file, first: int, last: int) -> Iterator[tuple]:
        return (r for r in self._rows(file) if first <= r[0] <= last)


TABBED = TabbedItems()


class Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class PageItems(DataSource):
    """Options: path (a file or a folder of files, several by commas), parser (`module:object`), pages_a_task."""

    @classmethod
    def name(cls) -> str:
        return "page_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.parser = options.get("parser", f"{__name__}:TABBED")
        self.step = max(1, int(options.get("pages_a_task", "50")))

    def _parser(self):
        module, _, name = self.parser.partition(":")
        return getattr(importlib.import_module(module), name)

    @staticmethod
    def _opened(path: str):
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return fs, at

    def _files(self) -> list[str]:
        import pyarrow.fs as pafs

        found = []
        for path in self.paths:
            fs, at = self._opened(path)
            prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                found += [prefix + f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
            else:
                found.append(path)
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        """A task for each so many pages of a file; only the numbers of pages are asked for here."""
        parser, out = self._parser(), []
        for path in self._files():
            fs, at = self._opened(path)
            with fs.open_input_file(at) as file:
                pages = parser.pages(file)
            out += [Pages(path, a, min(pages, a + self.step - 1)) for a in range(1, pages + 1, self.step)]
        return out or [Pages("", 1, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        work = re.sub(r"\.[A-Za-z]+$", "", partition.path.rstrip("/").rpartition("/")[2])
        fs, at = self._opened(partition.path)
        with fs.open_input_file(at) as file:
            for page, seq, text, x, y, width in self._parser().items(file, partition.first, partition.last):
                yield partition.path, work, page, seq, text, x, y, width


class LineComposer:
    """A table function: the items of a page in order to its lines (work, page, line_no, x, text).

    A line ends where the height changes by over two points, if it has any text yet; it stands where its first text, or a blank before that, stands furthest left.
    """

    def __init__(self):
        self.at, self.text, self.x, self.last, self.line = None, "", None, None, 0

    def _ended(self) -> Iterator[tuple]:
        if self.text.strip():
            yield *self.at, self.line, self.x, self.text
            self.line += 1
        self.text, self.x = "", None

    def eval(self, item) -> Iterator[tuple]:
        self.at = item.work, item.page
        if self.last is not None and item.y is not None and abs(item.y - self.last) > NEW_LINE and self.text.strip():
            yield from self._ended()
        if not self.text.strip() and item.x is not None:
            self.x = item.x if self.x is None else min(self.x, item.x)
        self.text += item.str or ""
        self.last = item.y

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()


def composed_lines(items: DataFrame) -> DataFrame:
    """(work, page, line_no, x, text): the lines of each page; pages are composed apart from each other."""
    kind = items.schema["work"].dataType.simpleString()
    compose = F.udtf(LineComposer, returnType=f"work {kind}, page int, line_no int, x double, text string")
    lines = compose(items.select("work", "page", "seq", "str", "x", "y").asTable().partitionBy("work", "page").orderBy("seq"))
    return lines.withColumn("text", T.collapse_repeats(F.col("text")))


def reading(items: DataFrame) -> DataFrame:
    """(work, line_no, text, candidate): scripts as their authors see them: indented, without running headers, with the lines that may be headings marked.

    A header is what returns, numbers aside, within two lines of the edge on three pages or a fifth of them; only lines at the edges go. Seven points are a blank.
    """
    lines = composed_lines(items)
    headers = clean.edge_headers(lines).select("work", "key", F.lit(True).alias("header"))
    page = W.partitionBy("work", "page")
    rows = lines.withColumn("down", F.row_number().over(page.orderBy("line_no"))).withColumn("up", F.row_number().over(page.orderBy(F.desc("line_no"))))
    rows = rows.withColumn("left", F.min("x").over(W.partitionBy("work"))).withColumn("key", T.signature(F.col("text"))).join(headers, ["work", "key"], "left")
    rows = rows.filter(~(F.coalesce("header", F.lit(False)) & ((F.col("down") <= 2) | (F.col("up") <= 2))))
    t = T.trim(F.col("text"))
    blanks = F.greatest(F.lit(0), F.least(F.lit(MOST_BLANKS), T.round_half_up((F.col("x") - F.coalesce("left", F.lit(0.0))) / BLANK_POINTS))).cast("int")
    shaped = F.length(t).between(SHORTEST, LONGEST) & (T.latin(t) >= 3) & (T.upper_ratio(t) > 0.7) & ~T.has(t, NO_CANDIDATE, True) & ~t.endswith(":")
    number = F.row_number().over(W.partitionBy("work").orderBy("page", "line_no")) - 1
    return rows.select("work", number.alias("line_no"), F.concat(F.repeat(F.lit(" "), F.coalesce(blanks, F.lit(0))), t).alias("text"), F.coalesce((F.col("x") < LEFT) & shaped, F.lit(False)).alias("candidate"))


def joined_words(items: DataFrame) -> DataFrame:
    """(work, text): all items of a work in order, one blank apart."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "str"))), lambda x: x["str"])
    return items.groupBy("work").agg(F.array_join(ordered, " ").alias("text"))
