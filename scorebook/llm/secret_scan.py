"""Secret scans: base patterns, and literals assigned to sensitive names found by lexing source and configuration syntax.

Every text is read whole. Three base kinds are matched leftmost and without overlap, each on its own:

* ``assign``  a sensitive word, ``:`` or ``=``, and a value of at least 12 characters (the span is the whole match),
* ``access``  an access key id, at least 18 characters,
* ``hex``     a run of at least 16 lower-case hexadecimal digits.

The lexer adds kind ``literal``. It reads each line that holds ``=``, ``:`` or an element ``<name>…</name>`` as tokens (names,
quoted literals, bare values, operators), forms name-value pairs, and evaluates a value as a sum of literals and of names
bound earlier in the same document, so a literal reached through constants is traced to where it stands. A pair's score is the
weight of the target name (``name_score``) times the plausibility of the joined value (``value_score``); each literal part of a
value with a score of at least ``threshold`` is reported. A comment begins with ``#``, ``//`` or ``--`` at a line's start or after white space, or with
``;`` at a line's start; elsewhere ``;`` parts statements. A type between ``:`` and ``=`` is skipped. Constants are known from their line on; a later
binding replaces an earlier one. Literals that follow each other are one value, also behind a string prefix or in three quotes. ``#define NAME "…"`` and
``key="NAME" value="…"`` are pairs; a value may open the next line where a line ends with the operator, a bracket, a backslash or a block sign behind it.
A bare name that is called, indexed or dotted is an expression and no literal; of a call with several arguments, a last one
in quotes counts as the value (the default). A value of over 2 ** 31 characters, which only sums of sums reach, is no literal either.

Null and empty texts have no spans. Repeated rows give repeated rows; ``doc_id`` may be null. An empty table gives no rows. Other
columns are not read by the scan and, if asked for, pass through unchanged. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import free_name, map_batches

KINDS = ("assign", "access", "hex", "literal")

# The base patterns (ASCII letters in either case in the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Weights of words that make a target name sensitive; the words of a name are cut at case changes, "_", "-" and ".".
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "signature": 0.5, "salt": 0.5, "pin": 0.4, "key": 0.3,
}
#: Words before "key" that make it sensitive.
KEYS = frozenset({"api", "access", "private", "secret", "encryption", "signing", "master", "auth", "client", "account", "shared"})
#: Words that say a name holds something about a secret, not the secret.
MILD = frozenset({"name", "id", "length", "len", "count", "file", "path", "url", "type", "field", "label", "hint", "policy", "expiry", "ttl", "public"})
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*|\{\{.*|%.*%|your[_-].*|change[_-]?me.*|example.*|placeholder.*|none|null|true|false|undefined|todo.*|redacted.*)$")
THRESHOLD = 0.5
#: Characters of a value's ends that tell placeholders, and of the longest value that is weighed.
SEEN, LONGEST = 256, 2**31

OPERATOR = re.compile(r"[=:]|</|\#[ \t]*define\b")
TOKEN = re.compile(r"""
    (?P<comment>(?:(?<!\S)(?:\#|//|--\ )|^[ \t]*;)[^\n]*$)
  | "(?P<double>(?:[^"\\\n]|\\.)*)"
  | '(?P<single>(?:[^'\\\n]|\\.)*)'
  | `(?P<back>[^`\n]*)`
  | (?P<element><(?P<tag>[A-Za-z_][\w.-]*)>(?P<inner>[^<>\n]*)</(?P=tag)>)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)
  | (?P<bind>:=|=>|=(?!=)|:(?!//))
  | (?P<plus>\+|\.\.)
  | (?P<other>\S)
""", re.VERBOSE | re.MULTILINE)
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
DEFINE = re.compile(r"""[ \t]*\#[ \t]*define[ \t]+(\w+)[ \t]+L?"((?:[^"\\\n]|\\.)*)\"""")
ATTRIBUTES = re.compile(r"""\b(?:key|name)[ \t]*=[ \t]*(["'])([^"'\n]*)\1[ \t]+value[ \t]*=[ \t]*(["'])([^"'\n]*)\3""", re.IGNORECASE)
#: Letters before the quote of a literal, such as those of raw or formatted strings.
PREFIX = re.compile(r"(?i)(?:f|r|b|u|fr|rf|br|rb|l|@|\$)\Z")
#: What a member access looks like: short words joined by dots, with no more than two digits at their ends.
DOTTED = re.compile(r"[A-Za-z_$][A-Za-z_$]{0,23}\d{0,2}(?:\.[A-Za-z_$][A-Za-z_$]{0,23}\d{0,2})+\Z")
#: Literal that opens a line, behind brackets, and the bare word that a block sign announces.
OPENS = re.compile(r"""[ \t]*[(\[{]*[ \t]*(?=["'`])""")
BLOCK = re.compile(r"[ \t]*([^\s\"'`:=]+)[ \t]*\Z")
CONTINUES = re.compile(r"(?::=|=>|[=:])[ \t]*(?P<sign>[|>][+-]?|[(\[{\\]*)[ \t]*\Z")
#: Words that may stand before the name of a type.
MODIFIERS = frozenset({"static", "const", "mut", "unsigned", "readonly", "final"})
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Span = tuple[int, int]


@lru_cache(10_000)
def name_score(name: str) -> float:
    """How sensitive the target of an assignment is, 0 to 1."""
    words = [w.lower() for w in WORD.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:]):
        if b == "key" and a in KEYS or a == "pass" and b in ("word", "phrase", "wd"):
            best = 1.0
    return best * 0.3 if words and words[-1] in MILD else best


class Value:
    """What a name stands for: a literal at a place, or the sum of two values. Sums share their parts, so a name that grows in every line costs little."""

    __slots__ = ("parts", "span", "length", "counts", "head", "tail", "told")

    def __init__(self, text: str = "", span: Span | None = None, parts: tuple[Value, Value] | None = None):
        self.parts, self.span, self.told = parts, span, False
        if parts:
            left, right = parts
            self.length = left.length + right.length
            self.counts = left.counts
            if self.length <= LONGEST:
                self.counts = dict(left.counts)
                for c, n in right.counts.items():
                    self.counts[c] = self.counts.get(c, 0) + n
            self.head = left.head if len(left.head) >= SEEN else (left.head + right.head)[:SEEN]
            self.tail = right.tail if right.length >= SEEN else (left.tail + right.tail)[-SEEN:]
        else:
            self.length, self.counts, self.head, self.tail = len(text), Counter(text), text[:SEEN], text[-SEEN:]

    def spans(self) -> list[Span]:
        """Places of the literals in it that have not been told before."""
        out, stack = [], [self]
        while stack:
            value = stack.pop()
            if value.told:
                continue
            value.told = True
            if value.parts:
                stack += value.parts
            elif value.length:
                out.append(value.span)
        return out

    def score(self) -> float:
        """How much it looks like a secret, 0 to 1: long enough, no placeholder, mixed or of high entropy."""
        n = self.length
        shown = self.head if n <= SEEN else self.head + self.tail
        if not 8 <= n <= LONGEST or PLACEHOLDER.match(shown) or any(c.isspace() for c in self.counts):
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        marks = "".join(self.counts)
        classes = sum(map(bool, (re.search(form, marks) for form in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))))
        return min(1.0, 0.25 * classes + max(0.0, bits - 2.0) / 3.0)


def value_score(value: str) -> float:
    return Value(value).score()


def total(parts: list[Value]) -> Value | None:
    out = None
    for part in parts:
        out = part if out is None else Value(parts=(out, part))
    return out


class Bindings:
    """Names bound so far in a document, each to its value."""

    def __init__(self, threshold: float):
        self.values: dict[str, Value] = {}
        self.threshold = threshold
        self.found: set[Span] = set()
        self.waits: str | None = None

    def bind(self, name: str, value: Value | None) -> None:
        if value is None:
            self.values.pop(name, None)
            self.values.pop(name.rsplit(".", 1)[-1], None)
            return
        self.values[name] = self.values[name.rsplit(".", 1)[-1]] = value
        weight = name_score(name)
        if weight and not value.told and weight * value.score() >= self.threshold:
            self.found.update(value.spans())

    def lead(self, text: str, base: int, block: bool) -> list[Value]:
        """The literals that open a line behind one that ended with an operator, or the bare word of a block."""
        if m := OPENS.match(text):
            tokens = [t for t in TOKEN.finditer(text, m.end()) if t.lastgroup != "comment"]
            parts, i = self.value(text, base, tokens, 0)
            return [] if i < len(tokens) and tokens[i]["bind"] else parts
        m = BLOCK.match(text) if block else None
        return [Value(m[1], (base + m.start(1), base + m.end(1)))] if m else []

    def line(self, text: str, base: int) -> None:
        """Pairs of one line; ``base`` is where it starts in the document."""
        if m := DEFINE.match(text):
            self.bind(m[1], Value(m[2], (base + m.start(2), base + m.end(2))))
            return
        for m in ATTRIBUTES.finditer(text):
            self.bind(m[2], Value(m[4], (base + m.start(4), base + m.end(4))))
        tokens = [m for m in TOKEN.finditer(text) if m.lastgroup != "comment"]
        i, last = 0, None
        while i < len(tokens):
            m = tokens[i]
            if m["element"]:
                at = m.start("inner")
                inner = m["inner"].strip()
                at += len(m["inner"]) - len(m["inner"].lstrip())
                self.bind(m["tag"], Value(inner, (base + at, base + at + len(inner))))
                i += 1
                continue
            target = m["name"] if m["name"] is not None else m["double"] if m["double"] is not None else m["single"]
            if target and i + 1 < len(tokens) and tokens[i + 1]["bind"]:
                at = i + 2
                if tokens[i + 1][0] == ":":
                    at = self.behind_type(text, tokens, at)
                parts, i = self.value(text, base, tokens, at)
                last = None if parts else target
                self.bind(target, total(parts))
            else:
                i += 1
        if last and (m := CONTINUES.search(text)):
            self.waits = last

    @staticmethod
    def behind_type(text: str, tokens: list[re.Match], i: int) -> int:
        """The token behind ``type =`` from token i on; i if no such type stands there."""
        depth, before = 0, ""
        for j in range(i, len(tokens)):
            m = tokens[j]
            word = m[0]
            if m["name"] is not None:
                if len(word) >= 8 and any(c.isdigit() for c in word) or depth <= 0 and before and before not in MODIFIERS:
                    return i
                before = word
                continue
            if m["bind"] and word == "=" and depth <= 0:
                literal = j + 1 < len(tokens) and tokens[j + 1].lastgroup in ("double", "single", "back")
                return j + 1 if j > i and (text[m.start() - 1].isspace() or literal) else i
            if word in ("[", "<", "("):
                depth += 1
            elif word in ("]", ">", ")"):
                depth -= 1
            elif not (word in ("|", "&", "*", "?", "'", ".") or depth > 0 and (word in (",", ";") or word.isdigit())):
                return i
            before = ""
        return i

    def value(self, text: str, base: int, tokens: list[re.Match], i: int) -> tuple[list[Value], int]:
        """Parts of ``term + term …`` from token i on, and the first token behind it."""
        parts: list[Value] = []
        while i < len(tokens):
            m = tokens[i]
            if m["name"] is not None and PREFIX.match(m[0]) and i + 1 < len(tokens) and tokens[i + 1].start() == m.end() and self.quoted(tokens[i + 1]):
                i += 1
                m = tokens[i]
            kind = self.quoted(m)
            if kind:
                parts.append(Value(m[kind], (base + m.start(kind), base + m.end(kind))))
                end = m.end()
            elif m["name"] is not None and text[m.end(): m.end() + 1] in ("(", "["):
                default, i = self.arguments(base, tokens, i + 1)
                if default is not None:
                    parts.append(default)
                end = 0
            elif m["name"] is not None and m["name"] in self.values:
                parts.append(self.values[m["name"]])
                end = m.end()
            else:
                bare = BARE.match(text, m.start())
                if not bare:
                    return parts, max(i, 1)
                if bare[0].strip("|\\") and not DOTTED.match(bare[0]):
                    parts.append(Value(bare[0], (base + bare.start(), base + bare.end())))
                end = bare.end()
            i += end > 0
            while i < len(tokens) and tokens[i].start() < end:
                i += 1
            if i < len(tokens) and kind and self.quoted(tokens[i]):
                continue  # literals side by side are one
            if i + 1 < len(tokens) and tokens[i]["plus"]:
                i += 1
                continue
            break
        return parts, i

    @staticmethod
    def quoted(m: re.Match) -> str | None:
        return next((g for g in ("double", "single", "back") if m[g] is not None), None)

    def arguments(self, base: int, tokens: list[re.Match], i: int) -> tuple[Value | None, int]:
        """Behind a name that is called or indexed: the last of several arguments if it is a literal, and the first token behind all brackets."""
        depth, commas, last = 0, 0, None
        while i < len(tokens):
            m = tokens[i]
            if m[0] in ("(", "[", "{"):
                depth += 1
            elif m[0] in (")", "]", "}"):
                depth -= 1
                if depth == 0 and not (i + 1 < len(tokens) and tokens[i + 1].start() == m.end() and tokens[i + 1][0] in (".", "(", "[")):
                    i += 1
                    break
            elif m[0] == "," and depth == 1:
                commas, last = commas + 1, None
            elif depth == 1 and commas:
                kind = self.quoted(m)
                last = Value(m[kind], (base + m.start(kind), base + m.end(kind))) if kind else None
            i += 1
        return last, i


def lexed(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literal spans that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text and "define" not in text:
        return []
    seen = Bindings(threshold)
    at = 0
    while m := OPERATOR.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        seen.line(text[start:end], start)
        if seen.waits:
            sign = CONTINUES.search(text, start, end)
            block, parts = bool(sign and sign["sign"][:1] in ("|", ">")), []
            while end < len(text):  # literals on lines of their own are one value
                after = text.find("\n", end + 1)
                after = len(text) if after < 0 else after
                more = seen.lead(text[end + 1: after], end + 1, block and not parts)
                if not more:
                    break
                parts.extend(more)
                end = after
            seen.bind(seen.waits, total(parts))
        seen.waits = None
        at = end
    return sorted(seen.found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts and spans of each row, beside the columns named in ``keep``."""
    out = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]

    def make():
        def step(batch: pa.RecordBatch):
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for text in batch.column(len(keep)).to_pylist():
                base = base_spans(text or "")
                full = base + [(a, 3, b) for a, b in lexed(text or "", threshold)]
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in full))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(full))
            numbers = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), *numbers[:3], pa.array(digest, pa.string()), pa.array(spans, pa.string()), numbers[3]],
                [*keep, *(f.split()[0] for f in SCANNED.split(", "))])

        return step

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "_text")))
    return map_batches(rows, make, ", ".join([*out, SCANNED]))


def mask(text: str, threshold: float = THRESHOLD, sign: str = "[SECRET]") -> str:
    """The text with every secret value replaced; overlapping spans become one. Of an assignment only its value goes."""
    spans = [(a, b) for a, _, b in base_spans(text) if _ != 0] + lexed(text, threshold)
    if "=" in text or ":" in text:
        spans += [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], sign]
        at = b
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its secrets masked in ``text`` and ``n_chars`` counted anew; all columns and rows stay."""
    names = docs.columns
    i = names.index("text")

    def make():
        def step(batch: pa.RecordBatch):
            text = [None if t is None else mask(t, threshold) for t in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if k == i else batch.column(k) for k in range(len(names))], names)

        return step

    masked = map_batches(docs, make, docs.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked
