"""Chunkers: Markdown by headings, source by definitions, anything by line windows."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def soft_split(body: str, most: int) -> list[str]:
    """Packs blocks, which blank lines outside fences divide, greedily into pieces of at most `most`
    characters; a block that is longer by itself stays whole."""
    blocks, current, fence = [], [], ""
    for line in body.split("\n"):
        mark = _FENCE.match(line)
        if mark:
            fence = "" if fence and mark[1][0] == fence else fence or mark[1][0]
        if not line.strip() and not fence:
            if current:
                blocks.append("\n".join(current))
                current = []
        else:
            current.append(line)
    if current:
        blocks.append("\n".join(current))
    pieces: list[str] = []
    for block in blocks:
        if pieces and len(pieces[-1]) + 2 + len(block) <= most:
            pieces[-1] += "\n\n" + block
        else:
            pieces.append(block)
    return pieces


def markdown_chunks(text: str | None, most: int = 2000) -> list[tuple[str, str]]:
    """(heading path, body) per section, the path as 'A > B'; empty bodies give no chunk."""
    if not text:
        return []
    chunks, trail, lines, fence = [], [], [], ""

    def flush() -> None:
        body = "\n".join(lines)
        path = " > ".join(name for _, name in trail)
        if body.strip():
            chunks.extend((path, piece.strip()) for piece in ([body] if len(body) <= most else soft_split(body, most)))
        lines.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        mark = _FENCE.match(line)
        if mark:
            fence = "" if fence and mark[1][0] == fence else fence or mark[1][0]
        heading = None if fence or mark else _ATX.match(line)
        if heading and heading[2]:
            flush()
            level = len(heading[1])
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, heading[2]))
        else:
            lines.append(line)
    flush()
    return chunks


def line_windows(text: str | None, lines: int = 50, size: int = 4000) -> list[tuple[int, int, str]]:
    """(first line, last line, body): windows of at most so many lines and bytes; a longer line is cut between characters."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    start, held, held_bytes = 1, [], 0

    def flush(last: int) -> None:
        nonlocal held, held_bytes
        if any(x.strip() for x in held):
            out.append((start, last, "\n".join(held)))
        held, held_bytes = [], 0

    for number, line in enumerate(text.split("\n"), 1):
        weight = len(line.encode()) + 1
        if held and (len(held) >= lines or held_bytes + weight > size):
            flush(number - 1)
            start = number
        if weight > size:
            raw, at = line.encode(), 0
            while at < len(raw):
                end = min(at + size, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:  # inside a character
                    end -= 1
                out.append((number, number, raw[at:end].decode()))
                at = end
            start = number + 1
            continue
        held.append(line)
        held_bytes += weight
    flush(text.count("\n") + 1)
    return out


#: Declarations by language: the kind of an item and the expression that its first line matches.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)\s+(?:struct|interface)\b")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("type", r"^\s*(?:export\s+)?class\s+(\w+)")],
    "java": [("type", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{")],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
DECLARATIONS["csharp"] = DECLARATIONS["java"]
_COMMENT = re.compile(r"^\s*(?://|/\*|\*|#\[|@\w)")


def _python_items(text: str) -> list[tuple[str, str, int, int]]:
    items: list[tuple[str, str, int, int]] = []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                items.append(("method" if owner else "function", f"{owner}::{child.name}" if owner else child.name, first, child.end_lineno or first))
            elif isinstance(child, ast.ClassDef):
                inner = [c.lineno for c in child.body if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                last = (min(inner) - 1) if inner else (child.end_lineno or child.lineno)
                items.append(("type", child.name, child.lineno, max(child.lineno, last)))
                visit(child, child.name)

    visit(ast.parse(text), "")
    return items


def _braced_items(text: str, rules: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]:
    lines, items = text.split("\n"), []
    compiled = [(kind, re.compile(pattern)) for kind, pattern in rules]
    for number, line in enumerate(lines, 1):
        for kind, pattern in compiled:
            if found := pattern.match(line):
                depth, opened, last = 0, False, number
                for at in range(number - 1, len(lines)):
                    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'', "", lines[at])
                    depth += bare.count("{") - bare.count("}")
                    opened, last = opened or "{" in bare, at + 1
                    if opened and depth <= 0:
                        break
                first = number
                while first > 1 and _COMMENT.match(lines[first - 2]):
                    first -= 1  # the comment right above belongs to it
                items.append((kind, found[1], first, last))
                break
    return items


def code_chunks(text: str | None, language: str | None) -> list[tuple[str, str | None, int, int, str]]:
    """(kind, symbol, first line, last line, body): definitions of a source file, line windows where none are found.

    Python is parsed, other languages are read by their declarations and braces. A type gives its header,
    its methods chunks of their own.
    """
    if not text:
        return []
    items: list[tuple[str, str, int, int]] = []
    try:
        if language == "python":
            items = _python_items(text)
        elif language in DECLARATIONS:
            items = _braced_items(text, DECLARATIONS[language])
    except (SyntaxError, ValueError, RecursionError):
        items = []
    if not items:
        return [("line-window", None, a, b, body) for a, b, body in line_windows(text)]
    lines = text.split("\n")
    return [(kind, name, a, b, "\n".join(lines[a - 1 : b])) for kind, name, a, b in sorted(items, key=lambda i: (i[2], i[3]))]


def explode_chunks(df: DataFrame, keep: str, inputs: list[str], chunk: Callable[..., list[tuple]], columns: str) -> DataFrame:
    """One row per chunk: the key `keep`, `ord` from 0 and the chunk's columns, given as a schema string."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (key, i, *parts)
                for key, *args in zip(batch[keep], *[batch[c] for c in inputs])
                for i, parts in enumerate(chunk(*[None if a is None or a != a else a for a in args]))
            ]
            yield pd.DataFrame(out, columns=[keep, "ord", *names])

    return df.select(keep, *inputs).mapInPandas(run, f"{keep} long, ord long, {columns}")


def fixed_windows(df: DataFrame, keep: str, text: str, lines: int = 50) -> DataFrame:
    """Line windows where no byte limit is asked for, by built-in functions alone: key, ord, first, last, n_lines.

    A text's windows follow from its number of lines, so no line leaves its row.
    """
    counted = df.where(F.col(text).isNotNull()).select(keep, F.size(F.split(text, "\n")).cast("long").alias("_n"))
    numbered = counted.select(keep, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / lines))).alias("ord"))
    last = F.least((F.col("ord") + 1) * lines, F.col("_n"))
    return numbered.select(keep, "ord", (F.col("ord") * lines + 1).alias("first_line"), last.alias("last_line"), (last - F.col("ord") * lines).alias("n_lines"))
