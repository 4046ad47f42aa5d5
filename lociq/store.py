"""Tables that are written once and then read by all queries and later sessions: the atlas of a graph, in a shared folder.

A table lies under a key of its settings. Beside it a note says what it was made from: the signature of each input that
was read while it was made, and the version of each stored table. It is taken as it is while all of these still hold, so a
session finds what an earlier one has built, and a changed input rebuilds what depends on it and nothing else. What a
maker reads is recorded while it runs, as a build tool's dependency files do; nobody has to list it.

Other code is other settings: a new release of the library builds its own tables.

A version is a folder of its own that never changes. The note is written after the writer has committed, and moved into
place in one step: two sessions that build the same table both succeed, and the later note holds."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lociq import session
from lociq.session import scratch_dir



def _code() -> str:
    """A key of the library's own sources: tables that other code has made are not taken."""
    top = Path(__file__).parent
    files = sorted(p for p in top.rglob("*.py") if "llm" not in p.relative_to(top).parts)
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]


#: Layout and meaning of stored tables.
FORMAT = _code()

#: Seconds for which what was seen of an input is believed: a query that opens many tables looks at each input once.
RECHECK = 1.0

#: Notes by where they lie, as this application has read or written them.
_notes: dict[tuple[str, str], dict] = {}
#: Signatures of inputs, with the time at which they were seen.
_signed: dict[str, tuple[float, str]] = {}
#: Notes of the tables being made, innermost last.
_making: list[dict] = []


def forget() -> None:
    """Drops what this application has seen; the next use looks at the files again."""
    _notes.clear()
    _signed.clear()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_signature(spark: SparkSession, path: str) -> str:
    """A key of what lies at a path: names, lengths and times of all files, so that changed input is built anew."""
    fs, p = _fs(spark, path)
    seen, found = [p], []
    while seen:
        at = seen.pop()
        if not fs.exists(at):
            continue
        for s in fs.listStatus(at):
            if s.isDirectory():
                seen.append(s.getPath())
            else:
                found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def atlas_dir(spark: SparkSession, sf_dir: str) -> str:
    """Where the tables of a graph lie: below `lociq.atlas.dir`, or the shared folder where that is unset."""
    base = spark.conf.get("lociq.atlas.dir", None) or f"{scratch_dir(spark)}/lociq/atlas"
    return f"{base.rstrip('/')}/{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:12]}"


def _seen_signature(spark: SparkSession, path: str) -> str:
    at, sign = _signed.get(path, (0.0, ""))
    if not at or time.monotonic() - at > RECHECK:
        sign = input_signature(spark, path)
        _signed[path] = time.monotonic(), sign
    return sign


def _note_at(spark: SparkSession, path: str) -> dict | None:
    mine = spark.sparkContext.applicationId, path
    if mine not in _notes and (note := _read_note(spark, path)):
        fs, done = _fs(spark, note["path"] + "/_SUCCESS")
        if note["format"] != FORMAT or not fs.exists(done):
            return None
        _notes[mine] = note
    return _notes.get(mine)


def _read_note(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(json.dumps(note, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    if not fs.rename(part, p):  # a file system that does not replace
        fs.delete(p, False)
        fs.rename(part, p)


def _holds(spark: SparkSession, note: dict | None) -> bool:
    """Is the table of this note made from what lies there now?"""
    if note is None or any(_seen_signature(spark, path) != sign for path, sign in note["inputs"].items()):
        return False
    below = ((_note_at(spark, at), path) for at, path in note["tables"].items())
    return all(n is not None and n["path"] == path and _holds(spark, n) for n, path in below)


def fresh(spark: SparkSession, sf_dir: str) -> dict[str, bool]:
    """Every table of the atlas of sf_dir and whether it still is what its inputs give."""
    fs, folder = _fs(spark, atlas_dir(spark, sf_dir))
    notes = [p for s in fs.listStatus(folder) if (p := s.getPath().toString()).endswith(".json")] if fs.exists(folder) else []
    return {_read_note(spark, at)["name"]: _holds(spark, _note_at(spark, at)) for at in notes}


def _record(input_path: str | None = None, table_at: tuple[str, str] | None = None, spark: SparkSession | None = None) -> None:
    if not _making:
        return
    if input_path is not None and input_path not in _making[-1]["inputs"]:
        _making[-1]["inputs"][input_path] = _seen_signature(spark, input_path)
    if table_at is not None:
        _making[-1]["tables"][table_at[0]] = table_at[1]


session.on_read = lambda spark, path: _record(input_path=path, spark=spark)


def _kept(spark: SparkSession, sf_dir: str, name: str, settings: dict, write: Callable[[str], dict]):
    """The note of a table, made by write(path) unless one that holds is there. write returns what to add to the note."""
    sf_dir = sf_dir.rstrip("/")
    key = hashlib.sha256(json.dumps([FORMAT, name, settings], sort_keys=True).encode()).hexdigest()[:10]
    at = f"{atlas_dir(spark, sf_dir)}/{name}-{key}.json"
    note = _note_at(spark, at)
    if not _holds(spark, note):
        note = {"format": FORMAT, "name": name, "settings": settings, "path": f"{atlas_dir(spark, sf_dir)}/{name}-{key}-{uuid.uuid4().hex[:8]}", "inputs": {}, "tables": {}}
        _making.append(note)
        try:
            more = write(note["path"])
        finally:
            _making.pop()
        note |= more
        _write_note(spark, at, note)
        _notes[spark.sparkContext.applicationId, at] = note
    _record(table_at=(at, note["path"]))
    return note


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: Sequence[str] = (), order: Sequence[str] = (), settings: dict | None = None, dealt: bool = False, rows: Callable[[], int] | None = None) -> DataFrame:
    """The table `name` of the graph of sf_dir, made and written unless this or an earlier session has done so.

    by: partition columns (a layer is then read without the others); order: rows are dealt out by ranges of these keys
    and sorted, so that files and row groups can be skipped by their bounds and no layer is one task's burden. settings:
    what make() depends on besides its inputs; other settings are another table. dealt: make() deals and sorts the rows so. rows: about how many the
    largest step of make() sorts, where they outgrow the session's number of partitions."""

    def write(path: str) -> dict:
        with session.sized(spark, rows() if rows else 0):
            df = make()
            keys = [*by, *order]
            made = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys and not dealt else df
            made.write.partitionBy(*by).parquet(path)
        return {"schema": df.schema.json()}

    note = _kept(spark, sf_dir, name, {"by": list(by), "order": list(order), **(settings or {})}, write)
    schema = StructType.fromJson(json.loads(note["schema"]))
    return spark.read.schema(schema).parquet(note["path"]).select(*schema.names)


def stored_lines(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], settings: dict | None = None) -> str:
    """The path of a text file set with the lines that make() gives in its column `line`, kept like a table."""

    def write(path: str) -> dict:
        make().select("line").write.text(path)
        return {}

    return _kept(spark, sf_dir, f"text-{name}", settings or {}, write)["path"]


def sweep(spark: SparkSession, sf_dir: str) -> list[str]:
    """Deletes the versions that no note names any more; returns their paths. Not while another session reads them."""
    fs, folder = _fs(spark, atlas_dir(spark, sf_dir))
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    named = {_read_note(spark, p.toString())["path"].rsplit("/", 1)[-1] for p in found if p.getName().endswith(".json")}
    old = [p for p in found if not p.getName().endswith(".json") and p.getName() not in named]
    for p in old:
        fs.delete(p, True)
    return [p.toString() for p in old]
