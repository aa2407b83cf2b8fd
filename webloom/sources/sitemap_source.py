"""Sitemaps as a data source of Spark: one call reads an index with all the sitemaps below it, one or more files a task."""

from __future__ import annotations

import gzip
import posixpath
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import ship

NAME = "webloom_sitemap"

SCHEMA = (
    "url string, lastmod string, changefreq string, priority double, language string, allowed_language boolean, images array<struct<loc:string,caption:string,title:string>>, "
    "news array<struct<publication:string,publication_date:string,title:string>>, sitemap string, sitemap_lastmod string, sitemap_no int, position int"
)

#: Path prefixes of two letters that are no other language.
HOME_LANGUAGES = frozenset(("en", "us"))

#: Rows that a reader hands over at once, bytes of files that are planned as one partition, and threads that look into files while planning.
BATCH, PARTITION_BYTES, THREADS = 4096, 8 << 20, 16


def language(url: str) -> str | None:
    """The first part of an address' path, where that has two characters."""
    first = next((p for p in urlsplit(url).path.split("/") if p), "")
    return first if len(first) == 2 else None


def _local(tag: object) -> str:
    """An element's name without its namespace."""
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _child(element: ET.Element, name: str) -> str | None:
    """Text of the first child of that name, without blanks around it; None where there is none."""
    for child in element:
        if _local(child.tag) == name:
            return (child.text or "").strip() or None
    return None


class _Files:
    """Files of any store that Arrow reaches (local, hdfs, s3, gs)."""

    def __init__(self) -> None:
        self.stores: dict[str, pafs.FileSystem] = {}

    def _at(self, path: str) -> tuple[pafs.FileSystem, str]:
        if "://" not in path and not path.startswith("file:"):
            return self.stores.setdefault("", pafs.LocalFileSystem()), path
        if path.startswith("file:"):
            return self.stores.setdefault("", pafs.LocalFileSystem()), "/" + path.removeprefix("file:").lstrip("/")
        parts = urlsplit(path)
        key = f"{parts.scheme}://{parts.netloc}"
        if key not in self.stores:
            self.stores[key] = pafs.FileSystem.from_uri(path)[0]
        return self.stores[key], pafs.FileSystem.from_uri(path)[1]

    def open(self, path: str):
        """The file's content as a stream, unpacked where it is packed."""
        store, at = self._at(path)
        stream = store.open_input_file(at)
        packed = stream.read(2) == b"\x1f\x8b"
        stream.seek(0)
        return gzip.GzipFile(fileobj=stream) if packed else stream

    def size(self, path: str) -> int | None:
        """Bytes of a file; None where there is none."""
        store, at = self._at(path)
        info = store.get_file_info(at)
        return info.size if info.type == pafs.FileType.File else None

    def listed(self, path: str) -> list[str]:
        """The files of a folder in code-point order, or the file itself. Names that start with a dot or an underscore are Spark's own."""
        store, at = self._at(path)
        if store.get_file_info(at).type != pafs.FileType.Directory:
            return [path]
        found = store.get_file_info(pafs.FileSelector(at, recursive=True))
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def entries(stream, kind: str) -> Iterator[ET.Element]:
    """Elements ``url`` or ``sitemap`` of a document, each freed once the next is asked for, so memory does not grow with the file."""
    root = None
    for event, element in ET.iterparse(stream, ("start", "end")):
        if root is None:
            root = element
        elif event == "end" and _local(element.tag) == kind:
            yield element
            root.clear()


def root_name(stream) -> str:
    """Name of a document's first element; empty where it is no XML."""
    try:
        for _, element in ET.iterparse(stream, ("start",)):
            return _local(element.tag)
    except (ET.ParseError, EOFError, OSError):
        pass
    return ""


@dataclass
class SitemapFile:
    """A file to read: where it is, the address it goes by, and what its index says of it."""

    path: str
    url: str
    lastmod: str | None
    number: int


@dataclass
class SitemapPartition(InputPartition):
    """The files of one task."""

    files: list[SitemapFile]


class SitemapReader(DataSourceReader):
    """Plans the files below the given ones, and reads them."""

    def __init__(self, options: dict[str, str], schema: T.StructType | None = None) -> None:
        self.schema = schema
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        if not self.paths:
            raise ValueError("a sitemap source needs a path")
        self.root = options.get("root", "").rstrip("/")
        self.missing = options.get("missing", "error")
        self.malformed = options.get("malformed", "error")
        if {self.missing, self.malformed} - {"error", "skip"}:
            raise ValueError("missing and malformed are 'error' or 'skip'")
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        named = options.get("languages", "all")
        self.languages = named if named in ("all", "home") else {x.strip() for x in named.split(",")}
        self.since, self.before, self.prefix = (options.get(x, "") for x in ("modifiedsince", "modifiedbefore", "prefix"))

    def keeps(self, row: dict) -> bool:
        """Whether an entry is one of those asked for; without a date it is in no span of dates."""
        date = row["lastmod"] or ""
        return (
            (self.languages == "all" or (row["allowed_language"] if self.languages == "home" else row["language"] in self.languages))
            and (not self.since or date >= self.since)
            and (not self.before or "" < date < self.before)
            and row["url"].startswith(self.prefix)
        )

    def stored(self, url: str, index: str) -> str:
        """Where the file of an address is: web addresses below ``root`` by host and path, or beside the index that names them; other addresses are
        places themselves, relative ones from the index."""
        parts = urlsplit(url)
        if parts.scheme in ("http", "https"):
            return f"{self.root}/{parts.netloc}{parts.path}" if self.root else posixpath.join(posixpath.dirname(index), posixpath.basename(parts.path))
        return url if parts.scheme or url.startswith("/") else posixpath.join(posixpath.dirname(index), url)

    def partitions(self) -> list[SitemapPartition]:
        """All sitemaps that the given files lead to, in the order in which an index names them, each once however often and in whatever circle it is named.
        Only the heads of files and the whole of indexes are read here; files of one level are looked into side by side."""
        files = _Files()
        pool = ThreadPoolExecutor(THREADS)

        def look(file: tuple[str, str, str | None]) -> tuple[int | None, list[tuple[str, str, str | None]] | None]:
            path, url, _ = file
            size = files.size(path)
            if size is None:
                if self.missing == "skip":
                    return None, None
                raise FileNotFoundError(f"no sitemap at {path} ({url})")
            with files.open(path) as stream:
                kind = root_name(stream)
            if kind != "sitemapindex":
                return size, None
            with files.open(path) as stream:
                named = [(_child(e, "loc"), _child(e, "lastmod")) for e in entries(stream, "sitemap")]
            return size, [(self.stored(loc, path), loc, date) for loc, date in named if loc]

        top = [(p, p, None) for given in self.paths for p in files.listed(given)]
        below: dict[str, list | None] = {}
        sizes: dict[str, int | None] = {}
        level = list({p: (p, u, d) for p, u, d in reversed(top)}.values())[::-1]
        while level:
            for file, (size, named) in zip(level, pool.map(look, level), strict=True):
                sizes[file[0]], below[file[0]] = size, named
            level = list({f[0]: f for file in level for f in below[file[0]] or () if f[0] not in below}.values())
        pool.shutdown()

        out: list[SitemapPartition] = []
        seen: set[str] = set()
        stack, held, number = top[::-1], self.bytes, 0
        while stack:
            path, url, date = stack.pop()
            if path in seen:
                continue
            seen.add(path)
            if below[path] is not None:
                stack += below[path][::-1]
            elif sizes[path] is not None:
                if held + sizes[path] > self.bytes or not out:
                    out.append(SitemapPartition([]))
                    held = 0
                out[-1].files.append(SitemapFile(path, url, date, number))
                held += sizes[path]
                number += 1
        return out

    def read(self, partition: SitemapPartition) -> Iterator[pa.RecordBatch]:
        """Entries of the partition's files that have a location and pass the filters."""
        schema, files = to_arrow_schema(self.schema), _Files()
        rows: list[dict] = []
        for file in partition.files:
            with files.open(file.path) as stream:
                try:
                    for position, element in enumerate(entries(stream, "url")):
                        row = self.row(element, file, position)
                        if row is not None and self.keeps(row):
                            rows.append(row)
                        if len(rows) >= BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except (ET.ParseError, EOFError, gzip.BadGzipFile) as e:
                    if self.malformed == "error":
                        raise ValueError(f"{file.path} is no sitemap: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def row(element: ET.Element, file: SitemapFile, position: int) -> dict | None:
        """One entry; None without a location. A priority that is no number is null."""
        url = _child(element, "loc")
        if not url:
            return None
        try:
            priority = float(_child(element, "priority") or "")
        except ValueError:
            priority = None
        images = [{n: _child(e, n) for n in ("loc", "caption", "title")} for e in element if _local(e.tag) == "image"]
        news = []
        for e in element:
            if _local(e.tag) == "news":
                publication = next((_child(c, "name") for c in e if _local(c.tag) == "publication"), None)
                news.append({"publication": publication, "publication_date": _child(e, "publication_date"), "title": _child(e, "title")})
        lang = language(url)
        return {
            "url": url, "lastmod": _child(element, "lastmod"), "changefreq": _child(element, "changefreq"), "priority": priority, "language": lang, "allowed_language": lang is None or lang in HOME_LANGUAGES,
            "images": images or None, "news": news or None, "sitemap": file.url, "sitemap_lastmod": file.lastmod, "sitemap_no": file.number, "position": position,
        }


class SitemapSource(DataSource):
    """``spark.read.format("webloom_sitemap").load(path)``: the entries of the sitemaps at ``path`` (files or folders, several with commas between) and of all that their indexes name, packed
    or not. Options: ``root`` (folder with a host's files under its name, for web addresses in indexes; without it they are looked for beside their index),
    ``missing`` and ``malformed`` ("error" or "skip"; of a malformed file the entries before the fault stay), ``partitionBytes``; and what is tested before a row is made:
    ``languages`` ("all", "home", or those of two letters with commas between), ``modifiedSince`` and ``modifiedBefore`` (compared as text with an entry's lastmod),
    ``prefix`` of the address. They are options, not pushed filters, as Spark 4.1 keeps what a Python reader took from one query for the next on the same DataFrame."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> SitemapReader:
        return SitemapReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    ship(spark).dataSource.register(SitemapSource)


def sitemap_tree(spark: SparkSession, path: str, all_languages: bool = False, limit: int = -1, **options: str) -> DataFrame:
    """(url, lastmod, changefreq, priority, images, news, sitemap) of all entries below ``path``, without those of other languages unless ``all_languages``; with a positive ``limit`` the
    first that many, in the order of indexes and entries. Entries named twice come twice, as in the files."""
    register(spark)
    rows = spark.read.format(NAME).options(**{"languages": "all" if all_languages else "home"} | options).load(path)
    if limit > 0:
        rows = rows.orderBy("sitemap_no", "position").limit(limit)
    return rows.select("url", "lastmod", "changefreq", "priority", "images", "news", "sitemap")
