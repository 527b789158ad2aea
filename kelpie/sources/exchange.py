"""Export and import of a store as one versioned JSON document, and golden sets."""

from __future__ import annotations

import json
import os
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.sources.store import Store, StoreError

EXPORT_VERSION = 1


def export_json(store: Store, path: str, exported_by: str) -> None:
    """Writes all tables as one JSON document; the file appears when it is whole.

    Rows are written in parallel, a line each, in the order of the table's first column; their files are
    then joined byte by byte, so the driver reads no row.
    """
    staged, parts = Path(f"{path}.staged"), Path(f"{path}.parts")
    names = sorted(store.manifest.tables)
    head = {"export_version": EXPORT_VERSION, "exported_by": exported_by, "source_schema_version": store.manifest.schema_version}
    head |= {f"schema_{name}": store.table(name).schema.jsonValue() for name in names}
    try:
        with staged.open("wb") as out:
            out.write(json.dumps(head)[:-1].encode())
            for name in names:
                table = store.table(name)
                key = table.columns[0]
                row = F.concat(F.lit(","), F.to_json(F.struct(*table.columns)))
                table.repartitionByRange(key).sortWithinPartitions(key).select(row).write.mode("overwrite").text(str(parts / name))
                out.write(f"\n,{json.dumps(name)}: [\n".encode())
                first = True
                for part in sorted((parts / name).glob("part-*")):
                    with part.open("rb") as rows:
                        if first and part.stat().st_size:
                            rows.seek(1)  # no comma before the first row
                            first = False
                        shutil.copyfileobj(rows, out, 1 << 20)
                out.write(b"]")
            out.write(b"\n}\n")
        os.replace(staged, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        staged.unlink(missing_ok=True)


def _sections(path: str, folder: Path) -> tuple[dict, list[str]] | None:
    """Copies the rows of each table of an export to a file of its own; the document's head and the tables'
    names. None for a document that isn't laid out in lines as `export_json` does it."""
    names: list[str] = []
    with open(path, "rb") as lines:
        try:
            head = json.loads(lines.readline().rstrip(b"\n") + b"}")
        except ValueError:
            return None
        out = None
        for line in lines:
            if out is None:
                if opened := re.fullmatch(rb",(\"[^\"]+\"): \[\n", line):
                    names.append(json.loads(opened[1]))
                    out = (folder / f"{len(names) - 1}.jsonl").open("wb")
                elif line.strip() != b"}":
                    return None
            elif line.rstrip() == b"]":
                out = out.close()
            else:
                out.write(line[1:] if line.startswith(b",") else line)
    return head, names


def import_json(store: Store, path: str, force: bool = False) -> list[str]:
    """Replaces a store's tables by a document's; a store with rows is only overwritten if `force`.

    The document is divided by tables as it streams by, a line at a time; its rows are parsed in
    parallel. A document in another layout than `export_json` writes is parsed as a whole.
    """
    from pyspark.sql.types import StructType

    folder = Path(f"{path}.sections")
    folder.mkdir(exist_ok=True)
    try:
        divided = _sections(path, folder)
        document, names = divided if divided else (json.loads(Path(path).read_text()), None)
        if document.get("export_version") != EXPORT_VERSION:
            raise StoreError(f"unknown export version {document.get('export_version')}")
        if not force and any(not store.table(n).isEmpty() for n in store.manifest.tables):
            raise StoreError("the store isn't empty")
        if names is None:
            names = [k for k in document if f"schema_{k}" in document]
            for i, name in enumerate(names):
                (folder / f"{i}.jsonl").write_text("".join(json.dumps(row) + "\n" for row in document[name]))
        tables: dict[str, DataFrame] = {}
        for i, name in enumerate(names):
            schema = StructType.fromJson(document[f"schema_{name}"])
            rows = store.spark.read.text(str(folder / f"{i}.jsonl"))
            tables[name] = rows.select(F.from_json("value", schema).alias("r")).select("r.*")
        store.save(tables)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return names


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set (id, query, kind, source_type, title_contains, body_contains, notes); ValueError if it is no good.

    Every query needs an id and a text; one that should match needs something to match.
    """
    schema = (
        "version int, description string, queries array<struct<id:string,query:string,kind:string,source_type:string,"
        "title_contains:array<string>,body_contains:array<string>,notes:string>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("queries"))
    needles = F.size(F.coalesce("title_contains", F.array())) + F.size(F.coalesce("body_contains", F.array()))
    bad = rows.where(
        F.coalesce(F.trim("id") == "", F.lit(True))
        | F.coalesce(F.trim("query") == "", F.lit(True))
        | ~F.coalesce(F.col("kind").isin("match", "empty"), F.lit(False))
        | ((F.col("kind") == "match") & (needles <= 0))
    )
    if first := bad.first():
        raise ValueError(f"golden query {first['id']!r} is incomplete")
    return rows
