"""A data source over document files whose partitions are page ranges.

    spark.dataSource.register(document_source(MyHandler()))
    spark.read.format("document_pages").option("path", folder).option("pages_per_split", 50).load()

Each file goes to the first handler that takes its path. A handler says how many pages a
file of some size has, without reading it, and reads the pages of a range. The driver
only lists files; a range is read by its own bytes. Handlers that cannot count pages
without reading get one range a file. Up to ``tasks`` ranges are a partition each; more are
dealt, in order, into that many partitions of about the same work, or into more so that
none has much over ``TASK_BYTES``.

Ranges have ``pages_per_split`` pages and share ``overlap_pages`` with the one before,
whose text comes as ``overlap``. With option ``prune`` and
``spark.sql.python.filterPushdown.enabled`` filters on path, split and pages skip whole
partitions. ``mode`` says what becomes of a
range that cannot be read: PERMISSIVE gives its message in ``error``, DROPMALFORMED skips
it, FAILFAST ends the job.
"""

from __future__ import annotations

import fnmatch
import html
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "document_pages"
SCHEMA = "path string, split int, first_page int, last_page int, prev_split int, next_split int, overlap string, content string, error string"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
TASKS = 256
TASK_BYTES = 32 << 20
OPENED = 16 << 10  # bytes that could be read in the time it takes to open a file


class Handler:
    """Text of UTF-8, unreadable bytes dropped, in pages of about ``page_bytes`` bytes.

    A page ends with the first line that ends at or after its last byte, so that a range
    is found by seeking; a page may be empty where a line is longer than a page.
    """

    suffixes: tuple[str, ...] = ()  # of the paths it takes; none: all
    block = 1 << 20

    def __init__(self, page_bytes: int = 4096):
        self.page_bytes = page_bytes

    def can_handle(self, path: str) -> bool:
        return not self.suffixes or path.lower().endswith(self.suffixes)

    def pages(self, size: int) -> int | None:
        """Pages of a file of ``size`` bytes; None if only its content tells."""
        return max(1, -(-size // self.page_bytes))

    def read(self, file: BinaryIO, size: int, pages: list[tuple[int, int]]) -> list[str]:
        """Texts of ranges of pages, numbered from 0, ends exclusive."""
        starts = {}
        for k in sorted({k for r in pages for k in r}):
            starts[k] = self._start(file, size, k)
        out = []
        for first, end in pages:
            file.seek(starts[first])
            out.append(file.read(starts[end] - starts[first]).decode("utf-8", "ignore"))
        return out

    def _start(self, file: BinaryIO, size: int, page: int) -> int:
        at = page * self.page_bytes
        if not page or at >= size:
            return min(at, size)
        file.seek(at)
        while block := file.read(self.block):
            if (k := block.find(b"\n")) >= 0:
                return at + k + 1
            at += len(block)
        return size


class Whole(Handler):
    """Formats that are parsed as a whole; form feeds part pages."""

    def pages(self, size: int) -> int | None:
        return None

    def text(self, content: bytes) -> str:
        return content.decode("utf-8", "ignore")

    def texts(self, content: bytes) -> list[str]:
        """Pages of a file; empty results fall back to the bytes as text."""
        text = self.text(content)
        return (text if text.strip() else content.decode("utf-8", "ignore")).split("\f")


class ParsedJson(Whole):
    """main_content of a JSON object, else the text as it is."""

    suffixes = (".json",)

    def text(self, content: bytes) -> str:
        whole = content.decode("utf-8", "ignore")
        try:
            found = json.loads(whole)
        except ValueError:
            return whole
        return found["main_content"] if isinstance(found, dict) and isinstance(found.get("main_content"), str) else whole


class Markup(Whole):
    """Text of HTML and XML: no tags, scripts or styles, a line a block."""

    suffixes = (".html", ".htm", ".xml", ".xhtml")

    def text(self, content: bytes) -> str:
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", content.decode("utf-8", "ignore"))
        lines = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</?(?:p|div|br|li|h[1-6]|tr|section|article)\b[^>]*>", "\n", bare))).split("\n")
        return "\n\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


DEFAULTS: tuple[Handler, ...] = (ParsedJson(), Markup(), Handler())


@dataclass
class Range:
    """Pages of a file; ``last`` is None where the file has to be read to count them."""

    path: str
    size: int
    handler: int
    split: int
    first: int
    last: int | None
    links: tuple[int | None, int | None] = (None, None)
    shared: int = 0


@dataclass
class Dealt(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]

    def __post_init__(self):
        super().__init__(None)


def dealt(found: list[tuple[Range, int]], tasks: int) -> list[Dealt]:
    """Ranges with their bytes as partitions, in order."""
    if len(found) <= tasks:
        return [Dealt([r]) for r, _ in found]
    work = sum(n + OPENED for _, n in found)
    most, out, at = max(tasks, -(-work // TASK_BYTES)), {}, 0
    for r, n in found:
        out.setdefault(at * most // work, []).append(r)
        at += n + OPENED
    return [Dealt(x) for x in out.values()]


def ranges(pages: int, per_split: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over pages from 0, ends exclusive: each begins ``overlap`` pages before the end of the one before."""
    out, at = [], 0
    while True:
        end = min(at + per_split, pages)
        out.append((at, end))
        if end == pages:
            return out
        at = end - overlap


def listed(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """Files below a path or of a glob, hidden ones left out, with their sizes, in order of paths."""
    system, where = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)
    found = system.get_file_info(where) if not re.search(r"[*?\[]", where) else None
    if found is not None and found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found is not None and found.type == fs.FileType.File:
        return system, [(where, found.size)]
    root = re.split(r"[*?\[]", where)[0].rpartition("/")[0] if found is None else where
    inner = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    seen = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
    return system, sorted((f.path, f.size) for f in inner if seen(f.path) and (found is not None or fnmatch.fnmatch(f.path, where)))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], handlers: tuple[Handler, ...]):
        self.path, self.mode = options["path"], options.get("mode", MODES[0]).upper()
        self.per_split, self.overlap = int(options.get("pages_per_split", 200)), int(options.get("overlap_pages", 1))
        if not 0 <= self.overlap < self.per_split or self.mode not in MODES:
            raise ValueError(f"need 0 <= overlap_pages < pages_per_split and a mode of {MODES}")
        self.tasks = max(1, int(options.get("tasks", TASKS)))
        self.handlers, self.filters = handlers, []

    def _kept(self, r: Range) -> bool:
        own = {"path": r.path} | ({} if r.last is None else {"split": r.split, "first_page": r.first + 1, "last_page": r.last})
        tests = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        return all(tests[type(f)](own[f.attribute[0]], f.value) for f in self.filters if f.attribute[0] in own)

    def _planned(self, path: str, size: int, handler: int, pages: int) -> Iterator[Range]:
        windows = ranges(pages, self.per_split, self.overlap)
        for k, (first, last) in enumerate(windows, 1):
            yield Range(path, size, handler, k, first, last, (k - 1 if k > 1 else None, k + 1 if k < len(windows) else None), min(self.overlap, last - first) if k > 1 else 0)

    def partitions(self) -> list[Dealt]:
        out = []
        for path, size in listed(self.path)[1]:
            handler = next(k for k, h in enumerate(self.handlers) if h.can_handle(path))
            pages = self.handlers[handler].pages(size)
            own = [Range(path, size, handler, 1, 0, None)] if pages is None else list(self._planned(path, size, handler, pages))
            out += [(r, size // len(own)) for r in own if self._kept(r)]
        return dealt(out, self.tasks) or [Dealt([])]

    def read(self, partition: Dealt) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.path)[0] if re.match(r"[a-z0-9+]+:/", self.path) else fs.LocalFileSystem()
        for r in partition.ranges:
            yield from self._read(system, r)

    def _read(self, system: fs.FileSystem, partition: Range) -> Iterator[tuple]:
        handler = self.handlers[partition.handler]
        try:
            with system.open_input_file(partition.path) as file:
                if partition.last is None:
                    texts = handler.texts(file.read())
                    parts = [(r, "".join(texts[r.first : r.first + r.shared]), "".join(texts[r.first + r.shared : r.last])) for r in self._planned(partition.path, partition.size, partition.handler, len(texts))]
                else:
                    r = partition
                    middle = r.first + r.shared
                    parts = [(r, *handler.read(file, r.size, [(r.first, middle), (middle, r.last)]))]
        except Exception as e:  # a handler's or a file's failure concerns its own range only
            if self.mode == "FAILFAST":
                raise
            if self.mode == "PERMISSIVE":
                yield (partition.path, partition.split, partition.first + 1, partition.last, *partition.links, None, None, f"{type(e).__name__}: {e}")
            return
        for r, shared, own in parts:
            yield (r.path, r.split, r.first + 1, r.last, *r.links, shared if r.shared else None, own, None)


class PruningReader(PagesReader):
    """A reader that takes filters on what a partition's description tells; Spark asks for a setting before it calls one."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what a partition's description tells skip partitions, and are left to Spark too."""
        self.filters = [f for f in filters if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in ("path", "split", "first_page", "last_page")]
        yield from filters


def document_source(*handlers: Handler, name: str = FORMAT) -> type[DataSource]:
    """A data source class with these handlers before the default ones."""
    known = (*handlers, *DEFAULTS)

    class DocumentPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            page = self.options.get("page_bytes")
            own = tuple(type(h)(int(page)) if page and type(h) is Handler else h for h in known)
            return (PruningReader if self.options.get("prune") == "true" else PagesReader)(dict(self.options), own)

    return DocumentPages


def page_texts(content: bytes, page_bytes: int = 4096) -> list[str]:
    """Pages of some bytes as ``Handler`` cuts them."""
    h, file = Handler(page_bytes), io.BytesIO(content)
    return h.read(file, len(content), [(k, k + 1) for k in range(h.pages(len(content)))])
