"""A store of scores as a Spark data source: one set of rows per (model, modal, label, seed), which readers see whole or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SET = ["model", "modal", "label", "seed"]
SCHEMA = "model string, modal string, label string, seed int, id string, y int, s double"
PART_ROWS = 1_000_000
ARROW = pa.schema([("model", pa.string()), ("modal", pa.string()), ("label", pa.string()), ("seed", pa.int32()), ("id", pa.string()), ("y", pa.int32()), ("s", pa.float64())])


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


def listed(at: fs.FileSystem, folder: str, kind: fs.FileType) -> list[str]:
    return sorted(f.base_name for f in at.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == kind)


def versions(at: fs.FileSystem, root: str, folder: str) -> list[str]:
    """The lists of a set's files that were put in place whole, oldest first."""
    return [n for n in listed(at, f"{root}/sets/{folder}", fs.FileType.File) if n.endswith(".json")]


def newest(at: fs.FileSystem, root: str, folder: str) -> dict | None:
    names = versions(at, root, folder)
    if not names:
        return None
    with at.open_input_stream(f"{root}/sets/{folder}/{names[-1]}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: for each file its set and its number of rows."""

    files: list[tuple[tuple, str, int]]


@dataclass
class Part(InputPartition):
    """Files that one task reads: of PART_ROWS rows together, or one larger file."""

    files: list[str]


def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where rows of one set follow one another, as (start, length)."""
    n = batch.num_rows
    if n < 2:
        return [(0, n)] if n else []
    changed = None
    for c in SET:
        x = batch.column(c)
        step = pc.not_equal(x.slice(1), x.slice(0, n - 1))
        changed = step if changed is None else pc.or_(changed, step)
    cuts = [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist()), n]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Writer(DataSourceArrowWriter):
    """Tasks write files that no set names yet; the commit names them, set by set; an abort deletes those of the tasks that had ended. What tasks that are still at work
    then leave behind is never named, and goes with vacuum."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        at, root = place_of(self.path)
        at.create_dir(f"{root}/files", recursive=True)
        files, out, key, name, rows = [], None, None, None, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files.append((key, name, rows))
                out = None

        try:
            for batch in iterator:
                batch = pa.RecordBatch.from_arrays([batch.column(c).cast(ARROW.field(c).type) for c in ARROW.names], schema=ARROW)
                if any(batch.column(c).null_count for c in SET):
                    raise ValueError(f"a row without {', '.join(SET)}")
                for start, length in runs(batch):
                    part = batch.slice(start, length)
                    now = tuple(part.column(c)[0].as_py() for c in SET)
                    if out is None or now != key:
                        close()
                        key, name, rows = now, f"{uuid.uuid4().hex}.parquet", 0
                        out = pq.ParquetWriter(f"{root}/files/{name}", ARROW, filesystem=at)
                    out.write_batch(part)
                    rows += length
            close()
        except BaseException:
            if out is not None:
                out.close()
                files.append((key, name, rows))
            self.abort([Written(files)])
            raise
        return Written(files)

    def commit(self, messages):
        at, root = place_of(self.path)
        sets: dict[tuple, list] = {}
        for m in messages:
            for key, name, rows in m.files if m else ():
                sets.setdefault(key, []).append([name, rows])
        for key, files in sorted(sets.items()):
            folder = quote(json.dumps(key), safe="")
            before = versions(at, root, folder)
            held = [] if self.overwrite or not before else newest(at, root, folder)["files"]
            at.create_dir(f"{root}/sets/{folder}", recursive=True)
            draft = f"{root}/sets/{folder}/{uuid.uuid4().hex}.draft"
            with at.open_output_stream(draft) as f:
                f.write(json.dumps({"set": key, "files": held + files}).encode())
            number = int(before[-1].split(".")[0]) + 1 if before else 1
            at.move(draft, f"{root}/sets/{folder}/{number:012d}.json")

    def abort(self, messages):
        at, root = place_of(self.path)
        for m in messages:
            for _, name, _ in m.files if m else ():
                if at.get_file_info(f"{root}/files/{name}").type == fs.FileType.File:
                    at.delete_file(f"{root}/files/{name}")


class Reader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, str]):
        self.path, self.wanted = path, wanted

    def partitions(self):
        at, root = place_of(self.path)
        found = [newest(at, root, folder) for folder in listed(at, f"{root}/sets", fs.FileType.Directory)]
        found = [s for s in found if s and all(str(v) == self.wanted.get(c, str(v)) for c, v in zip(SET, s["set"], strict=True))]
        parts, held = [Part([])], 0
        for name, rows in (f for s in found for f in s["files"]):
            if parts[-1].files and held + rows > PART_ROWS:
                parts.append(Part([]))
                held = 0
            parts[-1].files.append(name)
            held += rows
        return parts

    def read(self, partition):
        at, root = place_of(self.path)
        for name in partition.files:
            with at.open_input_file(f"{root}/files/{name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class ScoreStore(DataSource):
    """Options: path, and for reading model, modal, label and seed, which choose sets before any file is opened."""

    @classmethod
    def name(cls):
        return "gridlark_scores"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], {c: self.options[c] for c in SET if c in self.options})

    def writer(self, schema, overwrite):
        if set(schema.names) != set(ARROW.names):
            raise ValueError(f"scores have the columns {', '.join(ARROW.names)}")
        return Writer(self.options["path"], overwrite)


def save(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Put rows (model, modal, label, seed, id, y, s) into the store at path, a folder that driver and executors share.

    overwrite replaces the sets that scores has rows of and leaves the others; append adds to them. Each set changes at once when all tasks have ended; if one fails,
    all stay as they were. Rows without a part of their set's name are an error, a table without rows changes nothing. Rows of a task are sorted by set, so that it has one file open at a time.
    """
    scores.sparkSession.dataSource.register(ScoreStore)
    scores.select(*ARROW.names).sortWithinPartitions(*SET).write.format(ScoreStore.name()).mode(mode).option("path", path).save()


def load(spark: SparkSession, path: str, **wanted: str | int) -> DataFrame:
    """The rows of all sets, or of those whose model, modal, label or seed are named. A store that isn't there has none."""
    if unknown := set(wanted) - set(SET):
        raise ValueError(f"sets have no {', '.join(sorted(unknown))}")
    spark.dataSource.register(ScoreStore)
    return spark.read.format(ScoreStore.name()).options(path=path, **wanted).load()


def vacuum(path: str) -> int:
    """Delete files and lists that no set's newest list names: replaced ones, and those that lost executors left. Only for a store that nobody reads or writes just then."""
    at, root = place_of(path)
    kept = set()
    for folder in listed(at, f"{root}/sets", fs.FileType.Directory):
        names = versions(at, root, folder)
        kept |= {name for name, _ in newest(at, root, folder)["files"]} if names else set()
        for old in set(listed(at, f"{root}/sets/{folder}", fs.FileType.File)) - set(names[-1:]):
            at.delete_file(f"{root}/sets/{folder}/{old}")
    gone = [n for n in listed(at, f"{root}/files", fs.FileType.File) if n not in kept]
    for name in gone:
        at.delete_file(f"{root}/files/{name}")
    return len(gone)
