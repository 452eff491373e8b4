"""Secrets in texts: fixed patterns, and literals that source or configuration syntax gives a sensitive name."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import FOLD, byte_slices, fresh_names, text_buffer

KINDS = ("assign", "access", "hex", "literal")

SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

# Fixed patterns and least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Weights of the words in a target name; a name scores the largest.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "secretkey": 1.0, "encryptionkey": 1.0,
}
# Two neighbouring words of a name that count as one, such as api_key.
_JOINED = {k for k in NAME_WEIGHTS if k.endswith("key")}
# A text without any of these has no sensitive name and no fixed assignment.
HINTS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api", "credential", "bearer", "private", "access", "auth", "encryption")

THRESHOLD = 0.5

# Name, assignment sign and value in the syntaxes of code, JSON, YAML, INI, shell and XML attributes.
# A run of name characters is read once, from its start, however long it is.
_PAIR = re.compile(
    r"""(?:(?P<quote>["'])|(?<![A-Za-z0-9_.\-]))[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?(quote)(?P=quote))"""
    r"""\x20*(?:=>|:=|=(?!=)|:(?!:))\x20*"""
    r"""(?:(?P<mark>["'`])(?P<literal>(?:\\.|(?!(?P=mark))[^\\\n])*)(?P=mark)|(?P<bare>[^\s"'`,;(){}\[\]<>]+))"""
)
# Name and sign within a bare value, as in "config:key=value".
_HEAD = re.compile(r"(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?:=>|:=|=(?!=)|:(?!:))")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
# What may stand before, between and after name and value on a line of configuration: KEY=value or key: value.
_LINE_LEADS = ("export", "set", "setx", "ENV", "ARG", "-")
_LINE_SIGN = re.compile(r"=|:\x20+")
_LINE_END = re.compile(r"[\x20\t]*+(?:[#;][^\n]*+)?\r?(?:\n|\Z)")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target name is: the largest weight of its words, or of two neighbours taken as one."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)} & _JOINED
    return max((NAME_WEIGHTS.get(w, 0.0) for w in [*words, *joined]), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a credential: 0 when it is short, a placeholder or a word, up to 1."""
    return _literal_scores(value, [(0, len(value))])[0]


def _literal_scores(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """``literal_score`` of each span; of spans with one end all but the longest are parts of it, counted once."""
    out = [0.0] * len(spans)
    counts: Counter = Counter()
    end, at = -1, -1
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][1], -spans[k][0])):
        start, stop = spans[k]
        if stop != end:
            counts, end, at = Counter(), stop, stop
        counts.update(text[start:at])
        at = start
        if stop - start < 8 or text.startswith(("${", "$(", "<", "{{", "%("), start) or any(c.isspace() for c in counts):
            continue
        digits = sum(n for c, n in counts.items() if c.isascii() and c.isdigit())
        lower = any("a" <= c <= "z" for c in counts)
        upper = any("A" <= c <= "Z" for c in counts)
        kinds = bool(digits) + lower + upper + any(not (c.isascii() and c.isalnum()) for c in counts)
        if kinds == 1 and not all(c.isdigit() for c in counts):
            continue
        size = stop - start
        entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
        out[k] = min(1.0, entropy / 3.0) * min(1.0, 0.4 + 0.2 * kinds)
    return out


def _starts_line(text: str, at: int) -> bool:
    """Whether only blanks, and perhaps one word that leads in a setting, stand before ``at`` on its line."""
    for lead in (True, False):
        while at and text[at - 1] in " \t":
            at -= 1
        if at == 0 or text[at - 1] == "\n":
            return True
        word = next((w for w in _LINE_LEADS if lead and text.endswith(w, 0, at)), "")
        at -= len(word)
        if not word:
            break
    return False


def _is_literal(text: str, begin: int, sign: int, start: int, stop: int) -> bool:
    """Whether a bare value that could be a name, but is none that is known, is taken for a literal.

    It is when it holds a digit or both cases and is not called or indexed, or when its pair, from ``begin`` on with the
    text from ``sign`` on between name and value, is a line of configuration.
    """
    value = text[start:stop]
    if text[stop : stop + 1] not in ("(", "[") and (any(c.isdigit() for c in value) or value not in (value.lower(), value.upper())):
        return True
    return bool(_LINE_SIGN.fullmatch(text, sign, start) and _LINE_END.match(text, stop)) and _starts_line(text, begin)


def name_literal_pairs(text: str) -> list[tuple[str, int, int]]:
    """``(name, start, stop)`` of every assignment of a literal in ``text``, constants propagated.

    A bare value that is the name of an earlier literal stands for it: the target name is paired with that literal's
    own place, over any chain of names. Another bare value that could be a name is a literal when it looks like one or
    its line is one of configuration, and else a reference to what the text does not hold. A bare value may hold pairs
    of its own, as in "config:key=value" or "a=b&c=d"; their values end at the next "&" with a pair or where it ends, and
    its characters are read once.
    """
    pairs: list[tuple[str, int, int]] = []
    constants: dict[str, tuple[int, int]] = {}
    longest = 0
    at = 0
    while found := _PAIR.search(text, at):
        if found["mark"]:
            heads = []
            places = [(found["name"], found.span("literal"))]
            at = found.end()
        else:
            start = found.start("bare")
            stop = start + len(found["bare"].rstrip(".,"))
            heads = [(found["name"], found.start(), found.end("name") + bool(found["quote"]), start)]
            places, ends = [], []
            at = max(found.start() + 1, stop)
            for head in _HEAD.finditer(text, start, found.end()):
                if head.end() >= stop:
                    # Its value, a quoted one perhaps, lies behind.
                    at = head.start()
                    break
                # In a query string, as in "a=b&c=d", the next pair ends a value.
                if text[head.start() - 1] == "&":
                    ends += [head.start() - 1] * (len(heads) - len(ends))
                heads.append((head["name"], head.start(), head.end("name"), head.end()))
            ends += [stop] * (len(heads) - len(ends))
            heads = [(*head, end) for head, end in zip(heads, ends, strict=True)]
        for name, begin, sign, low, stop in heads:
            place = constants.get(text[low:stop]) if stop - low <= longest else None
            if place is None and (not _IDENTIFIER.fullmatch(text, low, stop) or _is_literal(text, begin, sign, low, stop)):
                place = (low, stop)
            if place is not None:
                places.append((name, place))
        for name, place in places:
            if place[1] > place[0]:
                pairs.append((name, *place))
                constants[name] = place
                longest = max(longest, len(name))
    return pairs


def find_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Places of literals whose target name and looks together reach the threshold."""
    weights: dict[str, float] = {}
    spans = []
    for name, start, stop in name_literal_pairs(text):
        if name not in weights:
            weights[name] = name_score(name)
        if weights[name]:
            spans.append((weights[name], (start, stop)))
    scores = _literal_scores(text, [x for _, x in spans])
    return sorted({x for (weight, x), score in zip(spans, scores, strict=True) if weight * score >= threshold})


def scan_text(text: str, threshold: float = THRESHOLD, hinted: bool = True, hexed: bool = True) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, stop)`` in code points, by start and then in the order of KINDS.

    ``hinted`` and ``hexed`` say whether the text holds any of HINTS, or a run of hex digits long enough.
    """
    spans = []
    if hinted:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        spans += [("literal", *x) for x in find_literals(text, threshold)]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if hexed:
        spans += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _worth(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a hint, AKIA, or a long enough run of hex digits; found on the bytes of all rows at once."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1

    def holding(buffer: bytes, needle: bytes, out: np.ndarray) -> None:
        at = buffer.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(needle) <= offsets[row + 1]:
                out[row] = True
                at = buffer.find(needle, int(offsets[row + 1]))
            else:
                at = buffer.find(needle, at + 1)

    hinted, access = np.zeros(rows, bool), np.zeros(rows, bool)
    folded = FOLD[data].tobytes()
    for hint in HINTS:
        holding(folded, hint.encode(), hinted)
    holding(data.tobytes(), b"AKIA", access)
    digit = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    breaks = np.flatnonzero(np.concatenate([[True], ~digit, [True]]))
    long = np.flatnonzero(np.diff(breaks) > LEAST["hex"])
    hexed = np.zeros(rows, bool)
    hexed[np.searchsorted(offsets, breaks[long], side="right") - 1] = True
    # A run that goes on over the end of a row is looked at in every row it touches.
    for a, b in zip(breaks[long], breaks[long + 1] - 1, strict=True):
        hexed[np.searchsorted(offsets, a, side="right") - 1 : np.searchsorted(offsets, b, side="left")] = True
    return hinted, access, hexed


def _scanned(batch: pa.RecordBatch, at: int, threshold: float) -> dict[int, list]:
    hinted, access, hexed = _worth(batch.column(at))
    found = {}
    for row in np.flatnonzero(hinted | access | hexed).tolist():
        if spans := scan_text(batch.column(at)[row].as_py() or "", threshold, bool(hinted[row]), bool(hexed[row])):
            found[row] = spans
    return found


def find_secrets(docs: DataFrame, keys: list[str], text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``keys`` and ``spans``, in code points, by start.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns, matched leftmost without overlap and dropped when
    too short. ``literal`` is the value that an assignment in code or configuration syntax gives to a sensitive name,
    directly or through a constant, where name and value together score ``threshold`` or more; it may overlap others.
    Null and empty texts have no spans; repeated rows are reported each; ``keys`` may be null and have any name but ``spans``,
    and no rows give none. Nothing is shuffled.
    """
    name, = fresh_names(keys, "text")
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)]) + f", spans {SPANS}"

    def run(batches):
        for batch in byte_slices(batches, len(keys)):
            found = _scanned(batch, len(keys), threshold)
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in found.get(r, ())] for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(spans, _SPAN_TYPE)], [*keys, "spans"])

    return picked.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text: str, marker: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` in ``text`` replaced by ``marker``, overlapping ones by one.

    All rows and other columns stay as they are, null texts too.
    """
    at = docs.schema.names.index(text)

    def run(batches):
        for batch in byte_slices(batches, at):
            found = _scanned(batch, at, threshold)
            if found:
                texts = batch.column(at).to_pylist()
                for row, spans in found.items():  # never a null text
                    parts, last = [], 0
                    for _, a, b in spans:
                        if a >= last:
                            parts += [texts[row][last:a], marker]
                        last = max(last, b)
                    texts[row] = "".join(parts) + texts[row][last:]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
