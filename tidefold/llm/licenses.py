"""License scans: an Aho-Corasick automaton over normalised words, and licence expressions.

A text is lower-cased (A-Z) and cut into words of ASCII digits and letters and all characters beyond
ASCII; the words are joined by single spaces and one automaton finds every phrase at word borders,
overlaps included. Texts with an identifier tag also get the expression after it: a shunting-yard
parser turns `and`, `or`, `with` and brackets into postfix form, which is evaluated to the licences
named, and to the lightest duty a user can choose (or: the lighter side, and: the heavier side,
with: one step lighter).

Defined results: null text counts as empty and has no word, match or label (score 0); rows with a
null or repeated doc_id are scanned like any other; of the line after a tag the longest start that
is an expression counts, so prose or punctuation may follow; without one the tag names no licence but
counts as weak evidence. Extra columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notice phrases of the method's own, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "the unlicense": "unlicense",
}

#: Words before a phrase that make it a statement of licence rather than a mention.
LEADS = ("licensed under", "released under", "distributed under", "available under", "terms of")
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)

#: Label and duty (0 permissive, 1 weak copyleft, 2 strong copyleft, 3 restricted) by identifier prefix.
FAMILIES = (
    ("agpl", "agpl", 2),
    ("lgpl", "lgpl", 1),
    ("gpl", "gpl", 2),
    ("apache", "apache", 0),
    ("mit", "mit", 0),
    ("bsd", "bsd", 0),
    ("isc", "isc", 0),
    ("mpl", "mpl", 1),
    ("epl", "epl", 1),
    ("unlicense", "unlicense", 0),
    ("cc0", "cc0", 0),
    ("cc-by-nc", "cc-by-nc", 3),
    ("cc-by-nd", "cc-by-nd", 3),
    ("cc-by-sa", "cc-by-sa", 1),
    ("cc-by", "cc-by", 0),
)

RESULT = (
    "doc_id long, n_words long, matches array<struct<label:string,word:long,words:long,base:boolean>>, "
    "expressions array<string>, labels array<string>, duty int, score double"
)
_MATCH = pa.list_(
    pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("base", pa.bool_())])
)

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")


_PART = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")


class ExpressionError(ValueError):
    pass


def leading(line: str) -> str:
    """The longest start of a line that is a whole expression, empty if there is none. It ends at a
    foreign character, at punctuation after a name, and at a word that cannot continue it."""
    at = end = depth = 0
    want_name = True
    while found := _PART.match(line, at):
        token = found[1]
        name = token not in ("(", ")") and token.lower() not in _PRECEDENCE
        if (token == "(" or name) != want_name or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        want_name = token == "(" or not (name or token == ")")
        bare = token.rstrip(".:-") if name else token
        if not bare:
            break
        at = found.end()
        if not want_name and not depth:
            end = found.start(1) + len(bare)
        if bare != token:
            break
    return line[:end]


def postfix(text: str) -> list[str]:
    """Shunting-yard: a licence expression in postfix order."""
    text = text.lower()
    if _TOKEN.sub("", text).strip():
        raise ExpressionError("unexpected character")
    out: list[str] = []
    held: list[str] = []
    want_name = True
    for token in _TOKEN.findall(text):
        if token == "(":
            if not want_name:
                raise ExpressionError("operator expected")
            held.append(token)
        elif token == ")":
            if want_name:
                raise ExpressionError("licence expected")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError("unbalanced bracket")
            held.pop()
        elif token in _PRECEDENCE:
            if want_name:
                raise ExpressionError("licence expected")
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            want_name = True
        else:
            if not want_name:
                raise ExpressionError("operator expected")
            out.append(token)
            want_name = False
    if want_name or "(" in held:
        raise ExpressionError("unfinished expression")
    return out + held[::-1]


def evaluate(code: list[str]) -> tuple[set[str], int]:
    """Labels named by a postfix expression, and the lightest duty that can be chosen."""
    stack: list[tuple[set[str], int]] = []
    for token in code:
        if token in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((a[0], max(0, a[1] - 1)))
            else:
                stack.append((a[0] | b[0], (min if token == "or" else max)(a[1], b[1])))
        else:
            label, duty = next(((x, d) for p, x, d in FAMILIES if token.startswith(p)), (None, 3))
            stack.append(({label} if label else set(), duty))
    return stack[0]


#: ASCII to its normalised form: letters in lower case, digits, and a space for all else.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        phrases = [(p, x, "base") for p, x in BASE.items()] + [(p, x, "notice") for p, x in NOTICES.items()]
        phrases += [(p, "", "lead") for p in LEADS] + [(TAG, "", "tag")]
        for phrase, label, kind in phrases:
            self.automaton.add_word(f" {phrase} ", (label, kind, len(phrase), phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """(n_words, matches, expressions, labels, duty, score)"""
        words = text.encode().translate(_NORMAL).split(b" ")
        words = [w for w in words if w]
        line = f" {b' '.join(words).decode()} "
        found, leads, tags = [], set(), False
        for end, (label, kind, length, n) in self.automaton.iter(line):
            start = end - length
            if kind == "tag":
                tags = True
            elif kind == "lead":
                leads.add(end)
            else:
                found.append((start, label, n, kind == "base"))
        if not found and not tags:
            return len(words), [], [], [], None, 0.0
        found.sort()
        matches, doubt, at, word = [], 1.0, 0, -1
        for start, label, n, base in found:
            word += line.count(" ", at, start)
            at = start
            matches.append({"label": label, "word": word, "words": n, "base": base})
            led = any(e in leads for e in (start - 1, start - 5))  # the phrase, or "the" and the phrase
            doubt *= 0.2 if led else 0.5
        labels = {m["label"] for m in matches}
        expressions, duty = [], None
        for raw in _TAG_LINE.findall(text) if tags else []:
            try:
                code = postfix(leading(raw))
                named, own = evaluate(code)
            except ExpressionError:
                doubt *= 0.7
                continue
            labels |= named
            duty = own if duty is None else max(duty, own)
            expressions.append(" ".join(code))
            doubt *= 0.05
        return len(words), matches, expressions, sorted(labels), duty, 1.0 - doubt


def scan(documents: DataFrame) -> DataFrame:
    """Matches with their word spans, expressions in postfix form, labels, duty and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py() or "") for t in batch.column("text")]
            if not rows:
                continue
            n, matches, expressions, labels, duty, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(matches, _MATCH),
                    pa.array(expressions, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())),
                    pa.array(duty, pa.int32()), pa.array(score, pa.float64()),
                ],
                ["doc_id", "n_words", "matches", "expressions", "labels", "duty", "score"],
            )

    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(picked, run, RESULT)


def digest(scanned: DataFrame) -> DataFrame:
    """One flat row per document: counts and places of base phrases, labels as comma-joined text."""
    base = F.filter("matches", lambda m: m["base"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions", ";").alias("expressions"),
    )
