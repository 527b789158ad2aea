"""Credentials embedded in code, configuration and prose (problem 3).

Method: a trigram index over the lines of the texts; the trigrams that each detection expression
requires are derived from it, their postings intersected, and only the candidate lines are verified by
the expression. Every expression finds what begins on one line; what follows may be spread over more.
What an expression finds is then judged as a value: placeholders, references, masked values, patterns,
hashes, identifiers and public keys are no credentials.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.trigrams import TrigramIndex, lowered, required, segments

# --- values ----------------------------------------------------------------------------------------

# Forms of tokens that providers issue.
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[\w\-]{16,}|npm_[A-Za-z0-9_]{16,}|xox[abeoprs]-[\w\-]{10,}"
    r"|qv\d\.[0-9a-f]{32,}|hf_[A-Za-z0-9]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|AIza[\w\-]{30,}|tk-[A-Za-z0-9]{16,}"
    r"|eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{10,})"
)

# Words that stand in a value's place until someone fills it in.
PLACEHOLDERS = re.compile(
    r"(?i)^(?:change-?_?me.*|place-?_?holder.*|string|text|null|none|nil|undefined|true|false|redacted|masked|hidden|dummy|todo|tbd|"
    r"secret|password|passwd|token|key|value|example.*|sample.*|test|user|admin|your[-_ ].*|my[-_ ].*|replace[-_ ]?.*|insert[-_ ].*|"
    r"from[-_ ]?(?:vault|env|keychain).*|<.*>?|\.+|-+)$"
)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|<[A-Za-z_ \-]+>|^\$|^%\w+%$|^!|^@\w|^env[.:]|^vault[:/]|^arn:|^secretref")
_MASKED = re.compile(r"\*{3,}|x{4,}|X{4,}|•|…..|#{4,}|\.{3,}.")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\\[swdbSWDB]|\{\d+,?\d*\}|\(\?")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake\d\w?|crc32)[-:]")
_DOTTED = re.compile(r"^[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+$")
_HEX = re.compile(r"^[0-9a-fA-F]{20,}$")


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def secret_like(value: str, strict: bool = False) -> bool:
    """Whether a literal would be a secret where one is expected; `strict` where one isn't named."""
    value = value.rstrip("…")
    if len(value) < 8 or value != value.strip() or re.search(r"\s", value):
        return False
    if PLACEHOLDERS.match(value) or _REFERENCE.search(value) or _MASKED.search(value) or _PATTERN.search(value):
        return False
    if _UUID.match(value) or _DIGEST.match(value) or value.startswith("data:") or "://" in value:
        return False
    if PROVIDER.search(value) or _HEX.match(value):
        return True
    if _DOTTED.match(value) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", value.rpartition(".")[2] + value.partition(".")[0]):
        return False
    lower, upper, digit = (bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d"))
    other = bool(re.search(r"[^A-Za-z0-9]", value))
    if not digit or not (lower or upper):
        return len(value) >= 20 and lower and upper and entropy(value) > 4.0 and not re.search(r"[a-z]{7,}", value)
    if re.fullmatch(r"[/.]?[\w.\-]*(?:/[\w.\-]+)+", value) and len(value) < 20 and not upper:
        return False  # a path
    kinds = lower + upper + digit + other
    if strict:
        return kinds >= 3 and lower and upper
    return kinds >= 3 or (len(value) >= 16 and entropy(value) > 3.2)


def decoded_secret(value: str) -> bool:
    """Whether a value is the base64 form of a provider's token or of user:password."""
    if len(value) % 4 or len(value) < 16:
        return False
    try:
        plain = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    if not plain.isprintable():
        return False
    user, colon, password = plain.partition(":")
    return bool(PROVIDER.search(plain)) or (bool(colon) and bool(re.fullmatch(r"[\w.@\-]+", user)) and secret_like(password))


# --- expressions -----------------------------------------------------------------------------------

_QUOTED = re.compile(r"(?<![\w\\])([\"'`])((?:(?!\1)[^\n\\]|\\.)*)(\1|(?=…|$|\n))")
_MORE = re.compile(r"\s*(?:\+|\\|\.\.|&|<>)?\s*\n\s*(?:\+|\.\.|&)?\s*([\"'`])((?:(?!\1)[^\n\\]|\\.)*)(\1|(?=…|$|\n))|\s*(?:\+|\.\.|&)\s*([\"'`])((?:(?!\4)[^\n\\]|\\.)*)\4")
_BARE = re.compile(r"[^\s\"'`,;|(){}\[\]<>]+")

_NAME = (
    r"(?:passw(?:or)?d|passwort|pass_?-?phrase|passcode|pwd|secret|token|api[_\-]?key|access[_\-]?key|signing[_\-]?key|"
    r"private[_\-]?key|hook[_\-]?key|auth[_\-]?key|relay[_\-]?key|encryption[_\-]?key|master[_\-]?key|account[_\-]?key|accountpwd|"
    r"sharedaccesskey|credentials?|bearer|kennwort|contrase(?:ñ|n)a)"
)


@dataclass(frozen=True)
class Rule:
    """An expression and how its matches are judged (the name of a function below)."""

    name: str
    pattern: str
    judge: str


RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", "_private_key"),
    Rule("provider", r"gh[pousr]_|github_pat_|AKIA|ASIA|[srp]k_live_|[srp]k_test_|glpat-|npm_|xox[abeoprs]-|qv[0-9]\.|hf_|AIza|tk-|eyJ", "_provider"),
    Rule("assigned", rf"(?i){_NAME}(?![A-Za-z])[\"'\])]{{0,3}}[ \t]*(?::=|=>|=|:|,)", "_assigned"),
    Rule("assigned_pw", r"(?i)(?<![A-Za-z])pw(?:=|:|[ \t](?::=|=>|=|:)|[\"'][\])]?[ \t]*(?:=>|=|:|,))", "_assigned"),
    Rule("attribute", rf"(?i){_NAME}\w*[\"'][ \t]+value[ \t]*=[ \t]*[\"']", "_attribute"),
    Rule("attribute_key", r"(?i)key[\"'][ \t]+value[ \t]*=[ \t]*[\"']", "_attribute"),
    Rule("authorization", r"(?i)authorization[\"'\])]{0,3}[ \t]*[:=,][ \t]*[\"'`]?(?:(?:basic|bearer|token)[ \t]+)?", "_authorization"),
    Rule("userinfo", r"(?<=[A-Za-z0-9])://[^\s:/@\"'`]*:", "_userinfo"),
    Rule("connection", r"(?i)(?:accountkey|accountpwd|sharedaccesskey|password|pwd)=", "_connection"),
    Rule("call", r"(?i)(?:login|auth|bind|signin|sign_in|connect|credentials)\w*\([ \t]*[\"'`][^\"'`\n]*[\"'`][ \t]*,[ \t]*[\"'`]", "_call"),
    Rule("command", r"(?i)(?:curl|login|wget|mysql|psql|http|ssh|registry)\b[^\n]*?[ \t](?:-u|-p|--user|--password)[ =]", "_command"),
    Rule("netrc", r"(?i)machine[ \t]+\S+[ \t]+login[ \t]+\S+[ \t]+password[ \t]+", "_following"),
    Rule("prose", r"(?i)password|passwort|kennwort|contrase|mot de passe|login|log in|zugang|clave|credential|anmelde|identifiant|rotate", "_prose"),
    Rule("cell", r"[ \t\n]\|[ \t]+(?=[^|\n]*\d)[^|\s]{8,}(?=[ \t]+\|)", "_cell"),
    Rule("encoded", r"Z2h[vwtyz]|QUtJQ|c2tfb|cmtfb|Z2xwY|bnBtX|cXY[wxyz]|ZXlK|eG94", "_encoded"),
]


def _whole(text: str, start: int, end: int) -> tuple[str, list[tuple[int, int]]]:
    """A literal and the parts joined to it: its value and the spans of the parts."""
    value, spans, at = text[start:end], [(start, end)], end + 1
    while more := _MORE.match(text, at):
        quote = 2 if more[1] else 5
        value += more[quote]
        spans.append(more.span(quote))
        at = more.end()
    return value, spans


_EXPRESSION = re.compile(r"[a-z_][a-z_0-9]*(?:[+*/%&^=]|-(?=\w+$))[a-z_0-9]+")


def _literals(text: str, at: int, bare_too: bool = True) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The literals that a line's rest after `at` holds: quoted ones with what is joined to them, or the bare word."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    gap = re.compile(r"[ \t]*").match(text, at).end()
    if bare_too and gap < end and text[gap] not in "\"'`" and (bare := _BARE.match(text, gap, end)):
        after = text[bare.end() : bare.end() + 1]
        if after not in ("(", "[", "{") and not _EXPRESSION.fullmatch(bare[0]):
            yield bare[0].rstrip(".…"), [bare.span()]
    for quoted in _QUOTED.finditer(text, at, end):
        yield _whole(text, *quoted.span(2))


_NEXT = re.compile(r"[\"'`]?\s*(?:,|\?\?|\|\||\bor\b|:(?!=))\s*(?:([\"'`])((?:(?!\1)[^\n\\]|\\.)*)\1|([^\s\"'`,;|(){}\[\]<>=:]+)(?=[\s,;\]})\"'`]|$))(?!\s*[:=(])")


def _listed(text: str, at: int) -> Iterator[list[tuple[int, int]]]:
    """The further values of a list or choice whose last one ended at `at`; a name with a value of its own ends it."""
    while more := _NEXT.match(text, at):
        span = more.span(2 if more[1] else 3)
        if secret_like(text[slice(*span)]):
            yield [span]
        at = span[1]


def _private_key(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    close = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY").search(text, m.end())
    # a key that isn't closed, as in a clipped snippet, ends with its lines of base64
    end = close.start() if close else re.compile(r"(?:(?:\\n|\s)*[A-Za-z0-9+/=]{16,})*…?").match(text, m.end()).end()
    body = re.sub(r"\\n|\\r|[\s#/*\"'`+>|\\]+", "", text[m.end() : end])
    body = re.sub(r"^(?:[A-Za-z\-]+:[^,]*,?)+", "", body)
    if body.startswith("REDACTED"):
        return
    if re.match(r"[A-Za-z0-9+/=]{16,}", body) or not close and len(body.strip("…")) == 0:
        yield [(m.start(), end)]


def _provider(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    if token := PROVIDER.match(text, m.start()):
        if not _MASKED.search(token[0]):
            yield [token.span()]
        return
    # the value may be joined from parts
    line = text.rfind("\n", 0, m.start()) + 1
    for quoted in _QUOTED.finditer(text, line):
        if quoted.start() > m.start():
            return
        if quoted.end() > m.start():
            value, spans = _whole(text, *quoted.span(2))
            if len(spans) > 1 and PROVIDER.search(value):
                yield spans
            return


def _assigned(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    for value, spans in _literals(text, m.end(), bare_too=not m[0].endswith(",")):
        if secret_like(value):
            yield spans
            yield from _listed(text, spans[-1][1])
            return
        if "://" in value or re.match(r"(?i)(?:basic|bearer|token) ", value):
            return  # other rules


def _attribute(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    end = re.compile(r"[^\"'\n]*").match(text, m.end()).end()
    if secret_like(text[m.end() : end]):
        yield [(m.end(), end)]


def _authorization(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    value = re.compile(r"[^\s\"'`]+").match(text, m.end())
    if value and (secret_like(value[0]) or decoded_secret(value[0])):
        yield [value.span()]


def _userinfo(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    value = re.compile(r"([^\s@/\"'`]{4,})@").match(text, m.end())
    if not value or PLACEHOLDERS.match(value[1]) or _REFERENCE.search(value[1]) or _MASKED.search(value[1]):
        return
    if not re.fullmatch(r"[A-Z_]+|[a-z_]+", value[1]) and not value[1].startswith("$"):
        yield [value.span(1)]


def _connection(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    value = re.compile(r"[^;\"'\s]+").match(text, m.end())
    if value and secret_like(value[0]):
        yield [value.span()]


def _call(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    end = re.compile(r"[^\"'`\n]*").match(text, m.end()).end()
    value, spans = _whole(text, m.end(), end)
    if secret_like(value):
        yield spans


def _command(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    end = text.find("\n", m.end())
    at = m.end()
    while True:  # all options of the line
        value = re.compile(r"[\"']?(?:[\w.@\-]+:)?([^\s\"':]+)").match(text, at)
        if value and secret_like(value[1]):
            yield [value.span(1)]
        more = re.compile(r"(?i)[ \t](?:-u|-p|--user|--password)[ =]").search(text, at, end if end >= 0 else len(text))
        if not more:
            return
        at = more.end()


def _following(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    value = re.compile(r"\S+").match(text, m.end())
    if value and secret_like(value[0]):
        yield [value.span()]


_STOP = re.compile(r"[.!?][\"')\]]*[ \t]+(?=[A-ZÄÖÜÀ-Þ¿¡])")


def _prose(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    start = text.rfind("\n", 0, m.start()) + 1
    end = text.find("\n", m.end())
    end = len(text) if end < 0 else end
    # the sentence of the word, the one before it and the one after it
    stops = [start, *(stop.end() for stop in _STOP.finditer(text, start, end)), end]
    at = bisect.bisect_right(stops, m.start()) - 1
    first, last = stops[max(0, at - 1)], stops[min(len(stops) - 1, at + 2)]
    for word in re.compile(r"[^\s`\"'|<>()]+").finditer(text, first, last):
        value = word[0].rstrip(".,;:")
        if not re.match(r"[\w./\-\[\]]+[=({][^=]", value) and "=" not in value[:-2] and secret_like(value, strict=not re.fullmatch(r"[0-9a-f]{32,}", value)):
            yield [(word.start(), word.start() + len(value))]


def _cell(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    value = m[0].strip("| \t")
    if secret_like(value, strict=not _HEX.match(value)):
        at = text.index(value, m.start())
        yield [(at, at + len(value))]


def _encoded(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    run = re.compile(r"[A-Za-z0-9+/]{12,}={0,2}").match(text, m.start())
    if run and not re.match(r"[A-Za-z0-9+/]", text[m.start() - 1 : m.start()] or " ") and decoded_secret(run[0]):
        yield [run.span()]


#: Expressions that ignore case run over the lower-cased text, which is several times faster.
_COMPILED = {
    rule.name: (re.compile(rule.pattern.removeprefix("(?i)")), rule.pattern.startswith("(?i)"), globals()[rule.judge]) for rule in RULES
}
_NEVER = re.compile(r"(?i)\b(?:sha(?:1|224|256|384|512)|md5|checksum|digest|integrity|fingerprint|etag|commit|content_hash)\b[\"'\])]*\s*(?::=|=|:)")


Places = dict[str, list[tuple[int, int]]]  # by expression, where in a text it is to be tried


def all_credentials(text: str | None, places: Places | None = None) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(line, rule, spans) of every credential of a text in order, lines from 1; any number per line.

    What several expressions find at one place is one credential, with all that any of them covers.
    Null and empty texts have none. Each rule is tried at its `places` only; None means everywhere.
    """
    if not text:
        return []
    found: list[tuple[str, list[tuple[int, int]]]] = []
    low = lowered(text)
    for rule in RULES:
        pattern, any_case, judge = _COMPILED[rule.name]
        for start, end in [(0, len(text))] if places is None else places.get(rule.name, ()):
            for m in pattern.finditer(low if any_case else text, start, end):
                for spans in judge(text, m):
                    at = spans[0][0]
                    if rule.name in ("prose", "cell", "assigned", "assigned_pw") and _NEVER.search(text, text.rfind("\n", 0, at) + 1, at):
                        continue
                    found.append((rule.name, spans))
    # what begins inside another finding (a part of a joined value, the body of a key) is no finding of its own
    groups: list[list[tuple[str, list[tuple[int, int]]]]] = []
    covered = key_end = -1
    for rule, spans in sorted(found, key=lambda f: f[1][0][0]):
        if spans[0][0] < key_end:
            continue  # a key ends where its END line begins, whatever else is read there
        if rule == "private_key":
            key_end = spans[-1][1]
        if spans[0][0] >= covered:
            groups.append([])
        groups[-1].append((rule, spans))
        covered = max(covered, *(end for _, end in spans))
    out, line, at = [], 1, 0
    for group in groups:
        rule = max(group, key=lambda f: _extent(f[1]))[0]
        spans = _united(span for _, spans in group for span in spans)
        line, at = line + text.count("\n", at, spans[0][0]), spans[0][0]
        out.append((line, rule, spans))
    return out


def _extent(spans: list[tuple[int, int]]) -> tuple[int, int]:
    """Joined parts count before length."""
    return len(spans), spans[-1][1] - spans[0][0]


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(spans)):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _per_line(found: list[tuple[int, str, list[tuple[int, int]]]]) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """The one finding of each line that has most parts, then the longest, then the first."""
    best: dict[int, tuple[int, str, list[tuple[int, int]]]] = {}
    for f in found:
        if f[0] not in best or _extent(f[2]) > _extent(best[f[0]][2]):
            best[f[0]] = f
    return list(best.values())


def find_credentials(text: str | None, places: Places | None = None) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(line, rule, spans) of the lines on which a credential begins, one credential per line; see `all_credentials`."""
    return _per_line(all_credentials(text, places))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """The text with every span replaced; line breaks inside a span stay, so no line moves."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start < at:
            continue
        head = text.index("-----", start + 5) + 5 if text.startswith("-----BEGIN", start) else start
        parts = re.split(r"(\\n|\\r|\r?\n)", text[head:end])  # breaks, written out or escaped, stand at odd places
        kept = text[start:head] + "".join(p if i % 2 or not p.strip() else mark for i, p in enumerate(parts))
        out += [text[at:start], kept]
        at = end
    return "".join([*out, text[at:]])


# --- over tables -----------------------------------------------------------------------------------

INDEX = TrigramIndex({rule.name: required(rule.pattern) for rule in RULES})


def candidate_places(lower_texts: list[str]) -> list[Places]:
    """For each text of a segment the lines on which each expression may match, by the index.

    A match may take the line end before its line along.
    """
    segment = INDEX.segment(lower_texts)
    out: list[Places] = [{} for _ in lower_texts]
    for rule in RULES:
        lines = INDEX.candidates(segment, rule.name)
        for text, start, end in zip(segment.text[lines].tolist(), segment.start[lines].tolist(), segment.end[lines].tolist()):
            out[text].setdefault(rule.name, []).append((max(0, start - 1), end))
    return out


def _verify(with_text: bool):
    columns = ["item_kind", "item_id", "line_no", "rule", *(["n_found", "redacted_text"] if with_text else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for low, high, lower_texts in segments(batch["text"]):
                part = batch.iloc[low:high]
                for kind, item, text, places in zip(part["item_kind"], part["item_id"], part["text"], candidate_places(lower_texts)):
                    found = all_credentials(text, places) if places else []
                    if with_text and found:
                        clean = redact(text, [s for _, _, spans in found for s in spans])
                        out.append((kind, item, *_per_line(found)[0][:2], len(found), clean))
                    elif not with_text:
                        out += [(kind, item, line, rule) for line, rule, _ in _per_line(found)]
            yield pd.DataFrame(out, columns=columns)

    return run


def _texts(texts: DataFrame) -> DataFrame:
    return texts.where(F.length("text") > 0).select("item_kind", "item_id", "text")


def credentials_in(texts: DataFrame) -> DataFrame:
    """(item_kind, item_id, line_no, rule): the line on which each credential begins."""
    return _texts(texts).mapInPandas(_verify(False), "item_kind string, item_id long, line_no long, rule string")


def redacted(texts: DataFrame) -> DataFrame:
    """Texts that hold credentials, redacted: item_kind, item_id, first line and rule, n_found, redacted_text.

    Every credential is redacted and counted, however many stand on a line.
    """
    schema = "item_kind string, item_id long, line_no long, rule string, n_found long, redacted_text string"
    return _texts(texts).mapInPandas(_verify(True), schema)


def stored_texts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Snippets of hits and contents of documents as (item_kind, item_id, text)."""
    return hits.select(F.lit("hit").alias("item_kind"), F.col("hit_id").alias("item_id"), F.col("snippet").alias("text")).unionByName(
        docs.select(F.lit("doc").alias("item_kind"), F.col("prep_id").alias("item_id"), F.col("content").alias("text"))
    )
