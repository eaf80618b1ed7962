"""Files of a scan that may be larger than the driver's memory: the portable artifact and the SARIF log.

Tasks write rows as lines of part files in the shared folder; the driver writes the heads and copies the parts behind them, in
order and a line at a time. An artifact has one row a line, so it is read in ranges of bytes, each a task's work, once the driver
has found where its lists begin and end.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.shared import shared_folder

RANGE = 32 << 20
TOLD = 64 << 20  # an artifact of another layout is parsed as a whole, if it is no larger


class ScanArtifactError(ValueError):
    """A file that is no scan artifact."""


def _lines(folder: Path) -> Iterator[str]:
    for part in sorted(folder.glob("part-*")):
        with open(part, encoding="utf-8", newline="\n") as f:
            for line in f:
                yield line.rstrip("\n")


def _append(out, lines: Iterator[str]) -> None:
    for k, line in enumerate(lines):
        out.write((",\n" if k else "\n") + line)


def write_lists(head: dict, body: dict, lists: dict[str, DataFrame], path: str) -> None:
    """``head`` with ``scan``: ``body`` and the lists, a row a line."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    work = Path(shared_folder(next(iter(lists.values())).sparkSession))
    try:
        for name, frame in lists.items():
            frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.text(f"file://{work / name}")
        with open(path, "w", encoding="utf-8") as f:
            f.write(dump(head)[:-2] + ',\n"scan": ' + dump(body)[:-2])
            for name in lists:
                f.write(f',\n"{name}": [')
                _append(f, _lines(work / name))
                f.write("]")
            f.write("}}\n")
    finally:
        shutil.rmtree(work, ignore_errors=True)


def index_lists(path: str) -> tuple[dict, dict[str, tuple[int, int]]]:
    """The artifact without its lists, and where the rows of each list begin and end; a line at a time."""
    head, spans, name, begin = [], {}, None, 0
    with open(path, "rb") as f:
        at = 0
        for line in f:
            opened = line.startswith(b'"') and line.rstrip().endswith((b": [", b": []", b": [],", b": []}}"))
            if name and not line.startswith(b"{"):
                raise ScanArtifactError(f"{path} has another layout")
            if opened:
                name, begin = line[1 : line.index(b'"', 1)].decode(), at + len(line)
            elif not name:
                head.append(line)
                if at > TOLD and not spans:
                    raise ScanArtifactError(f"{path} has another layout, and is too large to be parsed as a whole")
            at += len(line)
            if name and line.rstrip().endswith((b"],", b"]", b"]}}")) and (opened or line.startswith(b"{")):
                spans[name] = (begin, max(begin, at - (len(line) - line.rindex(b"]"))))
                name = None
    text = b"".join(head).decode("utf-8").rstrip().removesuffix(",")
    try:
        return json.loads(text if not spans else text + "\n}}"), spans
    except ValueError as e:
        raise ScanArtifactError(f"{path} can't be read as JSON") from e


def read_list(spark: SparkSession, path: str, span: tuple[int, int], schema: str) -> DataFrame:
    """The rows of a list, in ranges of RANGE bytes; a row that isn't right fails the read."""
    begin, end = span
    ranges = [(a, min(a + RANGE, end)) for a in range(begin, end, RANGE)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True):
                rows: list[str] = []
                with open(path, "rb") as f:
                    f.seek(a)
                    if a > begin:  # the line that goes on here is the one before's
                        f.seek(a - 1)
                        f.readline()
                    while f.tell() < b and (line := f.readline()):
                        over = max(0, f.tell() - end)  # behind the list's last row
                        rows.append(line[: len(line) - over].decode("utf-8").rstrip().removesuffix(","))
                        if len(rows) == 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])

    frame = spark.createDataFrame(ranges, "a long, b long").repartition(max(1, len(ranges)), "a")
    lines = frame.mapInArrow(read, "line string").where("line != ''")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_sarif(log: dict, locations: DataFrame, path: str) -> None:
    """``log`` with the locations of its results, which stand in the results' order (``ord``); ``locations``: ord, uri, line and
    what orders them before that (branch)."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    work = Path(shared_folder(locations.sparkSession))
    spot = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    order = ["ord", "branch", "uri", "line"]
    rows = locations.repartitionByRange(*order).sortWithinPartitions(*order)
    run, dump = log["runs"][0], lambda x: json.dumps(x, ensure_ascii=False)
    try:
        rows.select("ord", F.to_json(spot).alias("value")).write.partitionBy("ord").text(f"file://{work / 'rows'}")
        with open(path, "w", encoding="utf-8") as f:
            rest = {k: v for k, v in log.items() if k != "runs"} | {"runs": [{k: v for k, v in run.items() if k != "results"}]}
            f.write(dump(rest)[:-3] + ', "results": [')
            for k, result in enumerate(run["results"]):
                shown = {key: v for key, v in result.items() if key not in ("ord", "locations")}
                f.write((",\n" if k else "\n") + dump(shown)[:-1] + ', "locations": [')
                _append(f, _lines(work / "rows" / f"ord={result['ord']}"))
                f.write("]}")
            f.write("]}]}\n")
    finally:
        shutil.rmtree(work, ignore_errors=True)
