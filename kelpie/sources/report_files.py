"""Reports as files: all are staged first, then put in place, and put back if one fails."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame


def report_text(lines: DataFrame) -> str:
    """The text of a report (ord, line); a report is for a person to read, its sections are limited."""
    return "".join(r["line"] + "\n" for r in lines.orderBy("ord").toLocalIterator())


def write_reports(folder: str, texts: dict[str, str]) -> list[str]:
    """Writes files together: staged beside their places, the present ones kept as backups until all are in place.

    If one can't be written the folder is as it was, and the error is raised.
    """
    root, mark = Path(folder), uuid.uuid4().hex
    root.mkdir(parents=True, exist_ok=True)
    staged = {root / name: root / f".{name}.{mark}.staged" for name in texts}
    backups: dict[Path, Path] = {}
    placed: list[Path] = []
    try:
        for (target, part), text in zip(staged.items(), texts.values()):
            part.write_text(text)
        for target, part in staged.items():
            if target.exists():
                backups[target] = root / f".{target.name}.{mark}.backup"
                shutil.copy2(target, backups[target])
            os.replace(part, target)
            placed.append(target)
    except OSError:
        for target in placed:
            if target in backups:
                os.replace(backups.pop(target), target)
            else:
                target.unlink()
        raise
    finally:
        for part in [*staged.values(), *backups.values()]:
            part.unlink(missing_ok=True)
    return sorted(texts)
