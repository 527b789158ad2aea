"""Schemas that drift between files (problem 4).

Method: profile every field of every file with types and value sketches, match the fields that one
version lost with those the next gained (bipartite, by name similarity and sketch distance) to detect
renames, then unify the matched fields into one table.

The sketches are sums and bit unions only, so a file with a third of all lines is combined before the
shuffle and its profile is as small as any other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.ordering import previous_in_group
from kelpie.operators.series import so_far
from kelpie.session import cut

BINS = 10
_SKETCH = [f"h{i}" for i in range(BINS)]
_PROFILE_SCHEMA = "file_id long, path string, kind string, n long, bits0 long, bits1 long, " + ", ".join(f"{h} long" for h in _SKETCH)

_SHAPES = [
    re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d"),
    re.compile(r"[-+]?\d+(\.\d+)?$"),
    re.compile(r"[0-9a-f]{8,}$"),
    re.compile(r"v?\d+(\.\d+)+$"),
    re.compile(r"\S*/\S*$"),
    re.compile(r"(?=\S*\d)[\w.]+(-[\w.]+)+$"),
    re.compile(r"[A-Za-z][\w.]*(-[\w.]+)*$"),
    re.compile(r"\S+$"),
]


def parse_object(line: str | None) -> dict | None:
    """The JSON object of a line; None for blank, damaged and non-object lines."""
    if not line or "{" not in line:
        return None
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str, object]]:
    """(dotted path, type, value) of every non-object value; nulls don't count."""
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for name, item in node.items():
            path = f"{at}.{name}" if at else name
            if isinstance(item, dict):
                stack.append((path, item))
            elif isinstance(item, bool):
                yield path, "boolean", item
            elif isinstance(item, (int, float)):
                yield path, "number", item
            elif isinstance(item, str):
                yield path, "string", item
            elif isinstance(item, list):
                yield path, "array", item


def _bin(kind: str, value: object) -> int:
    """Numbers by magnitude (powers of 4), strings by shape and, for prose, by length."""
    if kind == "number":
        size, at = abs(float(value)), 0
        while size >= 1 and at < BINS - 1:
            size, at = size / 4, at + 1
        return at
    if kind == "string":
        for at, shape in enumerate(_SHAPES):
            if shape.match(value):
                return at
        return BINS - 1 if value else BINS - 2
    return min(len(value), BINS - 1) if kind == "array" else int(bool(value))


def _profile_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[tuple, list] = {}
        for file_id, line in zip(batch["file_id"], batch["raw_line"]):
            value = parse_object(line)
            if value is None:
                continue
            for path, kind, item in leaves(value):
                row = seen.get((file_id, path, kind))
                if row is None:
                    row = seen[file_id, path, kind] = [0, 0, 0, *[0] * BINS]
                row[0] += 1
                bit = xxhash.xxh3_64_intdigest(repr(item).encode("utf-8", "surrogatepass")) % 126
                row[1 + bit // 63] |= 1 << (bit % 63)
                row[3 + _bin(kind, item)] += 1
        if seen:
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["file_id", "path", "kind", "n", "bits0", "bits1", *_SKETCH])


def profile_fields(lines: DataFrame) -> DataFrame:
    """Per file and field: types, number of values and value sketch.

    Columns: file_id, path, kinds (the types, sorted and joined by '|'), n, bits0, bits1, h0..h9.
    Blank and damaged lines and lines that are no object give nothing; repeated lines change no type.
    """
    raw = lines.select("file_id", "raw_line").where(F.col("raw_line").isNotNull() & F.col("file_id").isNotNull())
    return (
        raw.mapInPandas(_profile_batches, _PROFILE_SCHEMA)
        .groupBy("file_id", "path")
        .agg(
            F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"),
            F.sum("n").alias("n"),
            F.bit_or("bits0").alias("bits0"),
            F.bit_or("bits1").alias("bits1"),
            *[F.sum(h).alias(h) for h in _SKETCH],
        )
    )


# --- matching --------------------------------------------------------------------------------------

# Abbreviations and synonyms of field-name words, each with the word it is read as.
WORDS = {
    "tok": "token", "tokens": "token", "in": "input", "out": "output", "prompt": "input", "completion": "output",
    "cached": "cache", "write": "creation", "ts": "time", "timestamp": "time", "created": "time", "at": "time",
    "event": "time", "sid": "session", "conversation": "session", "msg": "message", "entry": "message",
    "metering": "usage", "count": "token", "engine": "model", "details": "info", "body": "payload", "data": "payload",
}


def name_words(path: str) -> set[str]:
    """The words of a path: split at dots, underscores and capitals, abbreviations spelt out."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", path)
    return {WORDS.get(p.lower(), p.lower()) for p in parts}


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def _sketch_similarity(a: dict, b: dict) -> float:
    """1 for equal distributions over the bins; for numbers, near bins count as near."""
    ha, hb = [a[h] / max(1, a["n"]) for h in _SKETCH], [b[h] / max(1, b["n"]) for h in _SKETCH]
    if a["kinds"] == "number":
        drift = abs(sum(i * x for i, x in enumerate(ha)) - sum(i * x for i, x in enumerate(hb)))
        return max(0.0, 1 - drift / 4)
    overlap = sum(min(x, y) for x, y in zip(ha, hb))
    bits_a, bits_b = a["bits0"] | (a["bits1"] << 63), b["bits0"] | (b["bits1"] << 63)
    fewer = min(bits_a.bit_count(), bits_b.bit_count())
    shared = (bits_a & bits_b).bit_count() / fewer if fewer else 0.0
    return min(1.0, 0.85 * overlap + 0.15 * shared)


def similarity(old: dict, new: dict) -> float:
    """0 if the types differ, else name, place and sketch taken together."""
    if old["kinds"] != new["kinds"]:
        return 0.0
    (old_at, _, old_leaf), (new_at, _, new_leaf) = old["path"].rpartition("."), new["path"].rpartition(".")
    leaf = 1.0 if old_leaf == new_leaf else _jaccard(name_words(old_leaf), name_words(new_leaf))
    leaf = max(leaf, _jaccard(name_words(old["path"]), name_words(new["path"])))
    place = 1.0 if old_at == new_at else 0.8 * _jaccard(name_words(old_at), name_words(new_at))
    if old_leaf == new_leaf and old_at != new_at:
        place = max(place, 0.5)
    sketch = _sketch_similarity(old, new)
    rate = min(old["n"], new["n"]) / max(old["n"], new["n"], 1)
    return 0.4 * leaf + 0.2 * place + 0.3 * sketch + 0.1 * rate if sketch > 0.25 else 0.0


def assign(weights: list[list[float]]) -> list[int]:
    """Maximum-weight assignment of rows to columns (-1: none), by shortest augmenting paths."""
    n, m = len(weights), len(weights[0]) if weights else 0
    size = max(n, m)
    cost = [[-(weights[i][j]) if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
    row_price, col_price, of_col = [0.0] * size, [0.0] * size, [-1] * size
    for start in range(size):
        best, came, done = [float("inf")] * size, [-1] * size, [False] * size
        row, col = start, -1
        while True:
            step, nearest = float("inf"), -1
            for j in range(size):
                if done[j]:
                    continue
                reduced = cost[row][j] - row_price[row] - col_price[j]
                if reduced < best[j]:
                    best[j], came[j] = reduced, col
                if best[j] < step:
                    step, nearest = best[j], j
            row_price[start] += step
            for j in range(size):
                if done[j]:
                    row_price[of_col[j]] += step
                    col_price[j] -= step
                else:
                    best[j] -= step
            col = nearest
            done[col] = True
            if of_col[col] < 0:
                break
            row = of_col[col]
        while col >= 0:
            before = came[col]
            of_col[col] = start if before < 0 else of_col[before]
            col = before
    out = [-1] * n
    for j, i in enumerate(of_col):
        if i < n and j < m:
            out[i] = j
    return out


def match_fields(lost: list[dict], gained: list[dict], threshold: float = 0.45) -> list[tuple[str, str]]:
    """Changes between two versions: (old, new) for renames, '' on the missing side otherwise.

    Fields of one container that was renamed as a whole support each other: the more of them find
    their suffix under the same new container, the likelier each is.
    """
    if not lost or not gained:
        return [(f["path"], "") for f in lost] + [("", f["path"]) for f in gained]
    votes: dict[tuple[str, str], int] = {}
    for a in lost:
        for b in gained:
            if a["kinds"] == b["kinds"] and (ends := _container(a["path"], b["path"])):
                votes[ends] = votes.get(ends, 0) + 1
    weights = []
    for a in lost:
        row = []
        for b in gained:
            w = similarity(a, b)
            ends = _container(a["path"], b["path"]) if w else None
            row.append(w + 0.2 * (ends is not None and votes.get(ends, 0) > 1))
        weights.append(row)
    weights = [[w if w >= threshold else 0.0 for w in row] for row in weights]
    chosen = assign(weights)
    pairs = [(lost[i]["path"], gained[j]["path"]) for i, j in enumerate(chosen) if j >= 0 and weights[i][j] > 0]
    olds, news = {a for a, _ in pairs}, {b for _, b in pairs}
    return pairs + [(f["path"], "") for f in lost if f["path"] not in olds] + [("", f["path"]) for f in gained if f["path"] not in news]


def _container(a: str, b: str) -> tuple[str, str] | None:
    """The differing heads of two paths with a common tail of at least one name; None if there is none."""
    xs, ys = a.split("."), b.split(".")
    while len(xs) > 1 and len(ys) > 1 and xs[-1] == ys[-1]:
        xs.pop()
        ys.pop()
    return (".".join(xs), ".".join(ys)) if len(xs) < len(a.split(".")) else None


def _match_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for file_id, fields in zip(batch["file_id"], batch["fields"]):
            rows = [f if isinstance(f, dict) else f.asDict() for f in fields]
            rows.sort(key=lambda f: f["path"])
            lost, gained = [f for f in rows if f["side"] == "lost"], [f for f in rows if f["side"] == "gained"]
            out += [(file_id, a, b) for a, b in match_fields(lost, gained)]
        yield pd.DataFrame(out, columns=["file_id", "old_field", "new_field"])


def file_pairs(files: DataFrame) -> DataFrame:
    """(file_id, prev_id): each file with the one before it in its stream, by opened_at; firsts have none."""
    distinct = files.where(F.col("stream_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("stream_id", "opened_at")).alias("f"))
    flat = distinct.select("file_id", "f.stream_id", "f.opened_at")
    before = previous_in_group(flat, "stream_id", "opened_at", F.date_trunc("hour", "opened_at"), "file_id", "prev_id")
    return before.where(F.col("prev_id").isNotNull()).select("file_id", "prev_id")


def schema_changes(files: DataFrame, fields: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field): what changed against the file before it in its stream.

    Added fields have old_field '', removed ones new_field ''; a field of another type has its path in
    both; a renamed or moved one has both paths and no other row. A file without valid lines has no
    fields, so everything before it counts as removed and everything after it as added.
    """
    pairs = file_pairs(files)
    now = pairs.join(fields, "file_id").select("file_id", "path", F.struct("kinds", "n", "bits0", "bits1", *_SKETCH).alias("new"))
    was = (
        pairs.join(fields.withColumnRenamed("file_id", "prev_id"), "prev_id")
        .select("file_id", "path", F.struct("kinds", "n", "bits0", "bits1", *_SKETCH).alias("old"))
    )
    both = now.join(was, ["file_id", "path"], "full_outer")
    retyped = both.where(F.col("new").isNotNull() & F.col("old").isNotNull() & (F.col("new.kinds") != F.col("old.kinds")))
    moved = both.where(F.col("new").isNull() | F.col("old").isNull())
    field = F.coalesce("new", "old")
    listed = moved.groupBy("file_id").agg(
        F.collect_list(
            F.struct(
                "path", F.when(F.col("new").isNull(), "lost").otherwise("gained").alias("side"), field["kinds"].alias("kinds"),
                field["n"].alias("n"), field["bits0"].alias("bits0"), field["bits1"].alias("bits1"), *[field[h].alias(h) for h in _SKETCH],
            )
        ).alias("fields")
    )  # as long as the two schemas, never as the files
    matched = listed.mapInPandas(_match_batches, "file_id long, old_field string, new_field string")
    return matched.unionByName(retyped.select("file_id", F.col("path").alias("old_field"), F.col("path").alias("new_field")))


STRETCH = 10_000  # lines of a file that are read with one copy of its field roles

# --- one consistent table --------------------------------------------------------------------------

# The columns of a turn, and the words by which a field is recognised as one of them.
TURN_FIELDS = {
    "ts": {"time"},
    "session_id": {"session", "id"},
    "input_tokens": {"usage", "input", "token"},
    "output_tokens": {"usage", "output", "token"},
    "cache_read_tokens": {"usage", "cache", "read", "input", "token"},
    "cache_creation_tokens": {"usage", "cache", "creation", "input", "token"},
}


def turn_field(path: str) -> str | None:
    """Which column of a turn a field is, by its first name in the stream; None if none."""
    words = name_words(path)
    if "usage" in words:
        if words & {"tier", "web", "requests", "cost"}:
            return None
        if "cache" in words:
            return "cache_creation_tokens" if "creation" in words else "cache_read_tokens"
        if "total" in words or "token" in words or path.rpartition(".")[2] in ("input", "output"):
            return "output_tokens" if "output" in words else "input_tokens" if "input" in words else None
        return None
    leaf = name_words(path.rpartition(".")[2])
    if "." not in path and leaf == {"time"}:
        return "ts"
    if leaf in ({"session", "id"}, {"session"}) or path in ("payload.id", "sessionId"):
        return "session_id"
    return None


def first_names(files: DataFrame, fields: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, path, first_path): each field of each file with the name it had first in its stream.

    Renames form chains; each is followed to its start by pointer doubling over the rename events
    alone, log2(longest chain) rounds, every round written to the shared checkpoint folder.
    """
    at = files.groupBy("file_id").agg(F.min(F.struct("stream_id", "opened_at")).alias("f")).select("file_id", "f.*")
    events = (
        changes.where((F.col("old_field") != "") & (F.col("new_field") != "") & (F.col("old_field") != F.col("new_field")))
        .join(at, "file_id")
        .select("stream_id", "opened_at", "old_field", "new_field")
    )
    order = [F.col("opened_at"), F.col("kind")]
    into = events.select("stream_id", F.col("new_field").alias("path"), "opened_at", F.lit(0).alias("kind"),
                         F.struct("new_field", "opened_at").alias("event"), F.lit(None).cast("string").alias("for_path"))
    out_of = events.select("stream_id", F.col("old_field").alias("path"), "opened_at", F.lit(-1).alias("kind"),
                           F.lit(None).cast("struct<new_field:string,opened_at:timestamp>").alias("event"), F.col("new_field").alias("for_path"))
    linked = (
        so_far(into.unionByName(out_of).withColumn("field", F.struct("stream_id", "path")), "field", order, {"parent": ("last", F.col("event"))})
        .where("kind = -1")
        .select("stream_id", F.col("for_path").alias("new_field"), "opened_at", F.col("path").alias("root"), F.col("parent"))
    )
    linked = cut(linked)
    while not linked.where(F.col("parent").isNotNull()).isEmpty():
        up = linked.select(
            F.col("stream_id").alias("_s"), F.struct("new_field", "opened_at").alias("_e"), F.col("root").alias("_root"), F.col("parent").alias("_up")
        )
        linked = cut(
            linked.join(up, (F.col("stream_id") == F.col("_s")) & (F.col("parent") == F.col("_e")), "left").select(
                "stream_id", "new_field", "opened_at", F.coalesce("_root", "root").alias("root"), F.col("_up").alias("parent")
            )
        )
    uses = fields.select("file_id", "path").join(at, "file_id").select("stream_id", "path", "opened_at", F.lit(1).alias("kind"), "file_id", F.lit(None).cast("string").alias("root"))
    starts = linked.select("stream_id", F.col("new_field").alias("path"), "opened_at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("file_id"), "root")
    named = so_far(uses.unionByName(starts).withColumn("field", F.struct("stream_id", "path")), "field", [*order, F.col("file_id")], {"_root": ("last", F.col("root"))})
    return named.where("kind = 1").select("file_id", "path", F.coalesce("_root", "path").alias("first_path"))


def _number(value: object) -> int | None:
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None


def _turn_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "line_no", "parsed", *TURN_FIELDS]
    for batch in batches:
        out = []
        for file_id, line_no, line, roles in zip(batch["file_id"], batch["line_no"], batch["raw_line"], batch["roles"]):
            value = parse_object(line)
            row: dict = {"file_id": file_id, "line_no": line_no, "parsed": value is not None if line and line.strip() else None}
            if value is not None and roles is not None:
                role_of = dict(roles)
                for path, kind, item in leaves(value):
                    role = role_of.get(path)
                    if role and role.endswith("_tokens"):
                        if (amount := _number(item)) is not None:
                            row[role] = (row.get(role) or 0) + amount  # output comes as output plus reasoning
                    elif role and row.get(role) is None and kind == "string":
                        row[role] = item
            out.append(tuple(row.get(c) for c in columns))
        frame = pd.DataFrame(out, columns=columns)
        for c in columns:
            if c.endswith("_tokens"):
                frame[c] = frame[c].astype("Int64")
        yield frame


def unified_turns(files: DataFrame, lines: DataFrame, fields: DataFrame, changes: DataFrame) -> DataFrame:
    """One consistent table of all lines: file_id, line_no, parsed, ts and the counters of a turn.

    Renamed, moved and retyped fields end in the same column; numbers that came as text are numbers
    again; missing counters are null; reasoning tokens count as output. A line that repeats counts once,
    by its latest reading. Damaged lines stay, with parsed = false, blank ones with parsed = null. A
    file's field roles are joined to its lines by stretches of `STRETCH` lines, so a file with a third of
    all lines is spread, and the roles of others aren't copied.
    """
    role = F.udf(turn_field, "string")  # on distinct names only
    named = first_names(files, fields, changes)
    known = named.select("first_path").distinct().withColumn("role", role("first_path")).where(F.col("role").isNotNull())
    roles = (
        named.join(known, "first_path")
        .groupBy("file_id")
        .agg(F.map_from_entries(F.collect_set(F.struct("path", "role"))).alias("roles"))
        .join(lines.groupBy("file_id").agg(F.min("line_no").alias("_low"), F.max("line_no").alias("_high")), "file_id")
        .withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_low") / STRETCH), F.floor(F.col("_high") / STRETCH))))
        .drop("_low", "_high")
    )
    once = lines.groupBy("file_id", "line_no").agg(F.max(F.struct("read_at", "raw_line"))["raw_line"].alias("raw_line"))
    joined = once.withColumn("_stretch", F.floor(F.col("line_no") / STRETCH)).join(roles, ["file_id", "_stretch"], "left")
    schema = "file_id long, line_no long, parsed boolean, ts string, session_id string, " + ", ".join(f"{c} long" for c in list(TURN_FIELDS)[2:])
    turns = joined.select("file_id", "line_no", "raw_line", "roles").mapInPandas(_turn_batches, schema)
    return turns.withColumn("ts", F.try_to_timestamp("ts"))
