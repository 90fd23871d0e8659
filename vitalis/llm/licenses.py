"""License scan: Aho-Corasick over words, a shunting-yard parser for expressions.

A text is folded to words (A-Z lower-cased, words are the runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one blank between them, and read once by
an automaton of all phrases: the base phrases, the notices and the tags. A tag, such
as ``SPDX-License-Identifier:``, is followed by a licence expression in the original
text. The longest prefix that is an expression is read by the shunting-yard method
(WITH binds tighter than AND, AND tighter than OR) and evaluated to the least
obligations that it allows: the lesser side of OR, the greater of AND, and one step
less for a known exception of WITH.

After a tag that prose also uses (``licensed under``), and after an operator in lower
case, only known identifiers count, so prose is not taken for licences.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .decontaminate import _FOLD

# FIXED VALUES: phrases in folded words, and the label of each.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "gnu general public license": "gpl", "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl-3.0", "gnu free documentation license": "gfdl",
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "apache 2 0 license": "apache-2.0",
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc", "permission to use copy modify and or distribute this software for any purpose": "isc",
    "bsd license": "bsd", "2 clause bsd license": "bsd-2-clause", "3 clause bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "eclipse public license": "epl",
    "boost software license": "bsl-1.0", "artistic license": "artistic", "zlib license": "zlib", "unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain", "dedicated to the public domain": "public-domain",
    "creative commons attribution": "cc-by", "cc0": "cc0-1.0", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "proprietary and confidential": "reserved",
}
#: Tags, and whether any identifier counts after them or only known ones.
TAGS = {"spdx license identifier": True, "license expression": True, "licensed under": False, "released under": False,
        "available under": False, "distributed under": False, "license": False, "licence": False}
#: Obligations of the known identifiers, by the beginning of the identifier (the
#: longest that fits): 1 none to speak of, 2 weak copyleft, 3 copyleft, 4 copyleft
#: over a network, 5 use is restricted.
LEVELS = {
    "0bsd": 1, "afl": 1, "apache": 1, "artistic": 1, "bsd": 1, "bsl-1.0": 1, "cc-by": 1, "cc0": 1, "curl": 1, "isc": 1,
    "mit": 1, "ncsa": 1, "ofl": 1, "openssl": 1, "postgresql": 1, "psf": 1, "python": 1, "unlicense": 1, "wtfpl": 1,
    "x11": 1, "zlib": 1, "public-domain": 1, "cddl": 2, "cecill-c": 2, "cc-by-sa": 2, "epl": 2, "eupl": 3, "lgpl": 2, "mpl": 2,
    "ms-pl": 1, "ms-rl": 2, "gfdl": 3, "gpl": 3, "osl": 3, "sspl": 4, "agpl": 4, "busl": 5, "cc-by-nc": 5, "cc-by-nd": 5,
    "none": 5, "noassertion": 5,
}
NAMES = {1: "permissive", 2: "weak-copyleft", 3: "copyleft", 4: "network-copyleft", 5: "restricted"}
#: Exceptions that lift one step of obligations when code is linked or generated.
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "autoconf-exception", "bison-exception", "font-exception",
              "linux-syscall-note", "openjdk-assembly-exception", "ocaml-lgpl-linking-exception", "wxwindows-exception")
#: Words between a tag and its expression that prose puts there.
FILLERS = ("the", "either", "terms", "of", "a", "an", "is", "type", "name")
#: How much a label says on its own: a parsed expression, a notice, a base phrase.
WEIGHTS = {"expression": 0.95, "notice": 0.8, "base": 0.5}
# END OF FIXED VALUES

_PREFIXES = sorted(LEVELS, key=len, reverse=True)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_LEAD = re.compile(r"[ \t:=\"'`]*(?:(?:%s)\b[ \t:=\"'`]*)*" % "|".join(FILLERS), re.IGNORECASE)
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_AFTER = re.compile(r"$|[^a-z]|v[0-9]")


def level_of(name: str) -> int | None:
    """Obligations of an identifier; None for an unknown one."""
    return next((LEVELS[p] for p in _PREFIXES if name.startswith(p) and _AFTER.match(name, len(p))), None)


def normal_id(token: str) -> str:
    """Lower case; a plus at the end is written out."""
    low = token.lower().rstrip(".:-")
    return low.rstrip("+") + "-or-later" if low.endswith("+") else low


def combine(op: str, a: int, b: int) -> int:
    """Obligations of two sides. Those of an exception are 0 if it lifts a step and
    -1 if it is unknown."""
    if op == "OR":
        return min(a, b)
    if op == "AND":
        return max(a, b)
    return max(1, a - 1) if b == 0 and a in (2, 3, 4) else a


def parse(text: str, at: int = 0, any_id: bool = True) -> tuple[int, int | None, list[str]]:
    """The longest licence expression that begins at ``at``: (its end, its
    obligations, its identifiers), (``at``, None, []) if there is none. Unknown
    identifiers count as restricted. Two stacks, no recursion."""
    values: list[int] = []
    ops: list[str] = []
    names: list[str] = []
    depth, operand, strict = 0, True, any_id  # operand: one is due
    best: tuple[int, int | None, int] = (at, None, 0)

    def fold(rank: int) -> None:
        while ops and ops[-1] != "(" and _RANK[ops[-1]] >= rank:
            b, a = values.pop(), values.pop()
            values.append(combine(ops.pop(), a, b))

    def whole() -> int:  # outside brackets at most one operator of each rank waits
        v, o = list(values), list(ops)
        while o:
            b, a = v.pop(), v.pop()
            v.append(combine(o.pop(), a, b))
        return v[0]

    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        token, at = m.group(1), m.end()
        word = token.upper()
        end = at
        if operand:
            exception = bool(ops) and ops[-1] == "WITH"
            if token == "(" and not exception:
                ops.append(token)
                depth += 1
                continue
            if token in "()" or word in _RANK:
                break
            name = normal_id(token)
            level = level_of(name)
            lifts = exception and name.startswith(EXCEPTIONS)
            if not name or not (strict or level is not None or lifts):
                break
            values.append((0 if lifts else -1) if exception else level or 5)
            names.append(name)
            operand = False
            end = m.start(1) + len(token.rstrip(".:-"))
        elif token == ")" and depth:
            fold(0)
            ops.pop()
            depth -= 1
        elif word in _RANK and not (word == "WITH" and (text[m.start(1) - 1] == ")" or ops and ops[-1] == "WITH")):
            fold(_RANK[word])
            ops.append(word)
            operand, strict = True, any_id and token == word
            continue
        else:
            break
        if not depth:
            best = end, whole(), len(names)
        if end < at:  # a sentence ends here
            break
    return best[0], best[1], names[:best[2]]


class Scan:
    """What one text holds."""

    def __init__(self, text: str | None) -> None:
        raw = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
        data = np.frombuffer(raw.translate(_FOLD), np.uint8)
        blank = data == 32
        keep = ~blank
        keep[0] = True
        keep[1:] |= blank[1:] & ~blank[:-1]
        line = data[keep]
        gaps = np.flatnonzero(line == 32)
        self.n_words = len(gaps) - 1
        self.base: list[tuple[int, str]] = []  # word number, label
        self.notices: list[tuple[int, str]] = []
        self.expressions: list[dict] = []
        if self.n_words <= 0:
            self.n_words = 0
            return
        hits = list(_automaton().iter(line.tobytes().decode("latin-1")))
        if not hits:
            return
        place = None
        chars = None
        for end, (kind, n, what) in hits:
            first = int(np.searchsorted(gaps, end)) - n
            if kind == "base":
                self.base.append((first, what))
            elif kind == "notice":
                self.notices.append((first, what))
            else:
                if place is None:  # bytes of the text before each byte of the line
                    place = np.flatnonzero(keep) - 1
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8)[1:-1] & 0xC0) != 0x80)])
                self._tag(text, int(chars[min(int(place[end]), len(chars) - 1)]), what)

    def _tag(self, text: str, at: int, strict: bool) -> None:
        begin = _LEAD.match(text, at).end()
        if strict and not text[at:begin].strip(" \t"):  # an identifier tag has a colon or the like
            strict = False
        end, level, names = parse(text, begin, strict)
        if level is not None:
            self.expressions.append({"start": begin, "end": end, "level": level, "labels": sorted(set(names))})
        elif strict:
            self.expressions.append({"start": begin, "end": begin, "level": 5, "labels": ["unparsed"]})

    def row(self) -> dict:
        places = [p for p, _ in self.base]
        base = sorted({x for _, x in self.base})
        notices = {x for _, x in self.notices}
        found = {x for e in self.expressions for x in e["labels"]}
        weight = {x: WEIGHTS["base"] for x in base}
        weight |= {x: WEIGHTS["notice"] for x in notices if x not in base}
        weight |= {x: WEIGHTS["expression"] for x in found if x != "unparsed"}
        miss = 1.0
        for x in sorted(weight):
            miss *= 1.0 - weight[x]
        levels = [e["level"] for e in self.expressions]
        levels += [level_of(x) or 5 for x in {*base, *notices}]
        labels = sorted({*base, *notices, *found, *({NAMES[max(levels)]} if levels else ())})
        return {"n_words": self.n_words, "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": base, "labels": labels,
                "expressions": self.expressions, "score": 1.0 - miss}


_BUILT: list = []


def _automaton():
    if not _BUILT:
        import ahocorasick
        a = ahocorasick.Automaton()
        both: dict[str, tuple] = {p: ("notice", len(p.split()), x) for p, x in NOTICES.items()}
        both |= {p: ("base", len(p.split()), x) for p, x in BASE.items()}
        both |= {p: ("tag", len(p.split()), x) for p, x in TAGS.items()}
        for phrase, what in both.items():
            a.add_word(f" {phrase} ", what)
        a.make_automaton()
        _BUILT.append(a)
    return _BUILT[0]


MARKS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("expressions", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("level", T.IntegerType()),
        T.StructField("labels", T.ArrayType(T.StringType()))]))),
    T.StructField("score", T.DoubleType())])


def find_licenses(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) of every row plus n_words, n_base (places
    of base phrases, overlapping ones each), first_word and last_word (smallest and
    largest start, words from 0; null without one), base_labels, labels (base labels,
    those of notices and expressions, ``unparsed`` for an identifier tag without an
    expression, and the name of the strictest obligations found), expressions (start
    and end in code points of the original, obligations 1 to 5, identifiers) and score
    (0 without a label; each label on its own weighs as ``WEIGHTS`` says).

    Null and empty texts, and texts without words, have no words and no labels. Every
    row is scanned on its own: repeated rows give the same row again, and an empty
    table gives none. Label lists are distinct and sorted. Other columns are not
    looked at, whatever their names.
    """
    import pyarrow as pa
    keep = ["doc_id"] if keep is None else keep
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__marks", MARKS)])
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
                      ("expressions", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()),
                                                          ("labels", pa.list_(pa.string()))]))),
                      ("score", pa.float64())])

    def run(batches):
        for b in batches:
            marks = [Scan(t.as_py()).row() for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(marks, kind)],
                                             names=[f.name for f in out])

    found = src.mapInArrow(run, out)
    return found.select(*[F.col(c) for c in keep], *[F.col("__marks")[f.name].alias(f.name) for f in MARKS])
