"""Source trees and archives as frames. Hidden files count, which Spark's own file readers leave out.

The driver only lists: names, folders and sizes are columns of their own, and filters on them are applied to the list, so a
file that nobody asks for is never opened. Executors, which must see the same folder or archive, read tasks of about BYTES. A
folder that can't be listed or a file that can't be read fails the scan: a gate must not pass because of what it hasn't seen.

A file of more than ``split`` bytes is read in pieces, one a task, if ``split`` is given. A piece holds whole lines, and in front
and behind HALO lines of its neighbours, which are context only: ``own_from`` and ``own_to`` tell what is its own. Pieces are cut
where no match of personal data can reach over the line break, so all pieces together have the matches of the whole.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import stat
import subprocess
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path, PurePosixPath
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith,
)

from riskweave.functions import rules
from riskweave.functions.urls import UnsafeGitUrlError, blocked, checked_git_url

SCHEMA = "path string, name string, suffix string, bytes long, wanted boolean, piece int, pieces int, own_from long, own_to long, halo_breaks long, own_breaks long, text string"
MOST_ZIP_BYTES, MOST_PLAIN_BYTES, MOST_ENTRIES, CLONE_SECONDS = 200 << 20, 500 << 20, 20_000, 60
SPLIT, HALO = 64 << 20, rules.LINES_AROUND
WHOLE = -1  # piece of the row that has all of a file that is read in pieces too


class UnsafeZipError(ValueError):
    """An archive that must not be read."""


class IngestError(RuntimeError):
    """A source that couldn't be fetched."""


def needs_whole(path: str) -> bool:
    """Whether an extractor reads this file as a whole: code, configuration, manifests."""
    parts = path.split("/")
    name, suffix = parts[-1], suffix_of(parts[-1])
    folders = set(parts)
    manifest = ".git" not in folders and (name.endswith(".py") or name in ("pyproject.toml", "setup.py", "Pipfile") or re.fullmatch(r"requirements.*\.txt", name))
    code = name.endswith(".py") and not folders & set(rules.PY_IGNORED) or suffix in rules.JS_SUFFIXES and not folders & set(rules.JS_IGNORED)
    return bool(manifest or code or name in rules.CONFIG_NAMES)


def is_wanted(path: str) -> bool:
    """Whether any extractor of a scan reads this file."""
    parts = path.split("/")
    text = (suffix_of(parts[-1]) in rules.TEXT_SUFFIXES or parts[-1] in rules.TEXT_NAMES) and not set(parts) & set(rules.TEXT_IGNORED)
    return text or needs_whole(path)


def suffix_of(name: str) -> str:
    at = name.rfind(".")
    return name[at:] if 0 <= at < len(name) - 1 else ""


def _row(path: str, size: int) -> dict:
    name = path.rsplit("/", 1)[-1]
    return {"path": path, "name": name, "suffix": suffix_of(name), "bytes": size, "wanted": is_wanted(path)}


_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
_LISTED = ("path", "name", "suffix", "bytes", "wanted")


def listed_test(f: Filter):
    """A test of a listed file (a dict) that says what the filter says, or None if the filter is about anything else."""
    if isinstance(f, Not):
        inner = listed_test(f.child)
        return None if inner is None else lambda row: not inner(row)
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in _LISTED:
        return None
    if isinstance(f, IsNotNull):
        return lambda row: True
    if type(f) not in _TESTS:
        return None
    return lambda row, test=_TESTS[type(f)], column=f.attribute[0], value=f.value: test(row[column], value)


class Some(InputPartition):
    """Files of a task: (listed row, range of a file or None for all of it)."""

    def __init__(self, files: list[tuple[dict, int | None]]):
        self.files = files


def _safe(before: bytes, after: bytes) -> bool:
    """Whether no match can reach over the line break between: those that may hold white space need a digit or a bracket on both
    sides of it."""
    before = before.removesuffix(b"\r")[-1:]
    return (before < b"\x80" and before not in tuple(b"%c" % c for c in b"0123456789)")) or (after < b"\x80" and after not in tuple(b"%c" % c for c in b"0123456789("))


def cut(f: BinaryIO, size: int, at: int, step: int = 1 << 20) -> int:
    """The first place from ``at`` on where the file may be cut: behind a line break, or its end. It depends on the file and
    ``at`` alone, so neighbours agree on it."""
    if at <= 0:
        return 0
    begin = max(0, at - 3)
    while begin < size:
        f.seek(begin)
        block = f.read(step + 4)
        found = block.find(b"\n", max(0, at - 1 - begin))
        while 0 <= found < len(block) - 1 or found >= 0 and begin + len(block) >= size:
            if _safe(block[max(0, found - 2) : found], block[found + 1 : found + 2]):
                return min(size, begin + found + 1)
            found = block.find(b"\n", found + 1)
        begin += step
        at = max(at, begin + 3)
    return size


def _lines_back(f: BinaryIO, at: int, lines: int, step: int = 1 << 14) -> int:
    """Where the ``lines`` lines before a line's begin start, or 0."""
    end, seen = at, 0
    while end > 0:
        begin = max(0, end - step)
        f.seek(begin)
        block = f.read(end - begin)
        found = len(block)
        while (found := block.rfind(b"\n", 0, found)) >= 0:
            seen += 1
            if seen > lines:  # the first one found ends the line before ``at``
                return begin + found + 1
        end = begin
    return 0


def _lines_on(f: BinaryIO, at: int, lines: int) -> int:
    f.seek(at)
    for _ in range(lines):
        if not f.readline():
            break
    return f.tell()


def decoded(data: bytes) -> str:
    """Invalid bytes go; line ends become \\n."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def piece_of(f: BinaryIO, size: int, split: int, k: int) -> tuple | None:
    """own_from, own_to, halo_breaks, own_breaks and text of piece k, or None if all of it belongs to the piece before."""
    begin, end = cut(f, size, k * split), cut(f, size, (k + 1) * split)
    if begin >= end:
        return None
    first, last = _lines_back(f, begin, HALO), _lines_on(f, end, HALO)
    f.seek(first)
    data = f.read(last - first)
    before, own, after = (decoded(x) for x in (data[: begin - first], data[begin - first : end - first], data[end - first :]))
    return len(before), len(before) + len(own), before.count("\n"), own.count("\n"), before + own + after


class TreeReader(DataSourceReader):
    FILES, BYTES = 512, 32 << 20

    def __init__(self, options: dict):
        self.root, self.most, self.split = options["path"], int(options.get("maxbytes", "0")), int(options.get("split", "0"))
        self.skipped = set(filter(None, options.get("skip", ".git").split(",")))
        self.tests = [lambda row: row["wanted"]] if options.get("wanted", "false") == "true" else []

    def listed(self) -> Iterator[dict]:
        def fail(error: OSError) -> None:
            raise error

        for folder, folders, names in os.walk(self.root, onerror=fail):
            folders[:] = sorted(f for f in folders if f not in self.skipped)
            for full in (os.path.join(folder, n) for n in sorted(names)):
                if os.path.isfile(full):
                    yield _row(PurePosixPath(os.path.relpath(full, self.root)).as_posix(), os.path.getsize(full))

    def partitions(self) -> list[Some]:
        held, size, out = [], 0, []
        for row in self.listed():
            if self.most and row["bytes"] > self.most or not all(test(row) for test in self.tests):
                continue
            if self.split and row["bytes"] > self.split:
                out += [Some([(row, k)]) for k in self.tasks(row)]
                continue
            held.append((row, None))
            size += row["bytes"]
            if len(held) == self.FILES or size > self.BYTES:
                out.append(Some(held))
                held, size = [], 0
        return [*out, Some(held)] if held or not out else out

    def ranges(self, row: dict) -> list[int]:
        """The pieces of a large file, and WHOLE if an extractor needs that too."""
        return [*range(-(-row["bytes"] // self.split)), *[WHOLE] * needs_whole(row["path"])]

    def tasks(self, row: dict) -> list[int]:
        return self.ranges(row)

    def open(self, path: str) -> BinaryIO:
        return open(os.path.join(self.root, path), "rb")

    def read(self, partition: Some) -> Iterator[tuple]:
        for row, k in partition.files:
            with self.open(row["path"]) as f:
                yield from self.rows(row, f, k)

    def rows(self, row: dict, f: BinaryIO, k: int | None) -> Iterator[tuple]:
        listed = tuple(row[c] for c in _LISTED)
        if k is None or k == WHOLE:
            text = decoded(f.read())
            yield (*listed, *((0, 1) if k is None else (WHOLE, -(-row["bytes"] // self.split))), 0, len(text), 0, text.count("\n"), text)
        elif piece := piece_of(f, row["bytes"], self.split, k):
            yield (*listed, k, -(-row["bytes"] // self.split), *piece)


class ArchiveReader(TreeReader):
    """The entries of a zip as files. The limits are checked before anything is read; nothing is unpacked to a disk."""

    def listed(self) -> Iterator[dict]:
        for entry in checked_entries(Path(self.root)):
            parts = PurePosixPath(entry.filename).parts
            if not entry.is_dir() and not self.skipped & set(parts[:-1]):
                yield _row("/".join(parts), entry.file_size) | {"entry": entry.filename}

    def tasks(self, row: dict) -> list[int]:
        return [0]  # an entry can't be entered in the middle: one task makes all its pieces

    def read(self, partition: Some) -> Iterator[tuple]:
        with zipfile.ZipFile(self.root) as z:
            for row, k in partition.files:
                data = io.BytesIO(z.read(row["entry"]))
                for n in [None] if k is None else self.ranges(row):
                    data.seek(0)
                    yield from self.rows(row, data, n)


class PushDown:
    """Filters on what is listed are applied to the list. Spark calls this only where spark.sql.python.filterPushdown.enabled is
    set, and takes readers that have it for an error where it isn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = listed_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


class PushedTreeReader(PushDown, TreeReader):
    pass


class PushedArchiveReader(PushDown, ArchiveReader):
    pass


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        pushed = options.get("pushdown", "false") == "true"
        if os.path.isfile(options["path"]):
            return (PushedArchiveReader if pushed else ArchiveReader)(options)
        return (PushedTreeReader if pushed else TreeReader)(options)


def named(files: DataFrame) -> DataFrame:
    """Adds each path's name and parts to (path, text)."""
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.split("path", "/").alias("parts"), "text")


def read_files(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """All columns of SCHEMA. Options: wanted (leave out what no extractor reads), maxbytes, split, skip."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("srctree").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else value)
    return reader.load(str(root))


def read_tree(spark: SparkSession, root: str, most_bytes: int = 0, wanted: bool = False) -> DataFrame:
    """path, name, parts and text of the files of a folder or an archive."""
    return named(read_files(spark, root, maxbytes=most_bytes, wanted=wanted))


def read_pieces(spark: SparkSession, root: str, split: int = SPLIT) -> DataFrame:
    """The wanted files with ``parts``, large ones in pieces, and as a whole too if an extractor needs that."""
    return read_files(spark, root, wanted=True, split=split).drop("suffix", "bytes", "wanted").withColumn("parts", F.split("path", "/"))


def whole_files(files: DataFrame) -> DataFrame:
    """The rows that hold a file as a whole."""
    return files.where(f"pieces = 1 OR piece = {WHOLE}") if "piece" in files.columns else files


def checked_entries(archive: Path) -> list[zipfile.ZipInfo]:
    """The entries of an archive that stays within the limits and holds no unsafe one."""
    if archive.stat().st_size > MOST_ZIP_BYTES:
        raise UnsafeZipError("the archive is too large")
    try:
        with zipfile.ZipFile(archive) as z:
            entries = z.infolist()
    except zipfile.BadZipFile as e:
        raise UnsafeZipError("this is no archive") from e
    if len(entries) > MOST_ENTRIES:
        raise UnsafeZipError("too many entries")
    if sum(e.file_size for e in entries) > MOST_PLAIN_BYTES:
        raise UnsafeZipError("its content is too large")
    for e in entries:
        mode = stat.S_IFMT(e.external_attr >> 16)
        if e.filename.startswith(("/", "\\")) or ".." in PurePosixPath(e.filename.replace("\\", "/")).parts or mode not in (0, stat.S_IFREG, stat.S_IFDIR):
            raise UnsafeZipError(f"unsafe entry {e.filename!r}")
    return entries


def unpack(archive: Path, target: Path) -> Path:
    """Unpack a zip that stays within the limits and within the target."""
    entries = checked_entries(archive)
    if target.exists():
        shutil.rmtree(target)
    target.mkdir(parents=True)
    root = target.resolve()
    with zipfile.ZipFile(archive) as z:
        for e in entries:
            if not (root / e.filename).resolve().is_relative_to(root):
                raise UnsafeZipError(f"unsafe entry {e.filename!r}")
            z.extract(e, target)
    return target


def clone(url: str, target: Path, token: str | None = None, allowed: set[str] | None = None) -> Path:
    """A shallow clone over https from a host whose addresses are all public."""
    import ipaddress
    import socket
    from urllib.parse import urlsplit

    url = checked_git_url(url, allowed)
    host = urlsplit(url).hostname
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, 443)}
    except OSError as e:
        raise IngestError(f"{host} has no address") from e
    if any(blocked(ipaddress.ip_address(a.split("%")[0])) for a in found):
        raise UnsafeGitUrlError("private addresses are not taken")
    full = url.replace("https://", f"https://{token}@", 1) if token else url
    env = {"PATH": os.environ.get("PATH", ""), "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_ALLOW_PROTOCOL": "https", "HOME": str(target.parent)}
    try:
        subprocess.run(["git", "clone", "--depth", "1", "--", full, str(target)], check=True, capture_output=True, timeout=CLONE_SECONDS, env=env)
    except (subprocess.SubprocessError, OSError) as e:
        raise IngestError("the clone failed") from e
    return target


def resolve(source: str, work: Path) -> Path:
    """A folder or an archive, which is read as it is, for a path or an address; a clone goes to ``work``."""
    path = Path(source)
    if path.is_dir():
        return path
    if path.suffix.lower() == ".zip" and path.exists():
        checked_entries(path)
        return path
    if "://" in source or source.startswith(("git@", "ext::")):
        return clone(source, work / "git")
    raise FileNotFoundError(source)
