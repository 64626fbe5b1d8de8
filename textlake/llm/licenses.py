"""License scans: ordered signature rules behind a keyword prefilter; contained detections of lower priority are dropped.

Texts are lower-cased (A-Z) and cut into words of ASCII letters and digits and all other non-ASCII characters; rules are
regular expressions over the words joined by single spaces. They are written by hand in :mod:`signatures`, license texts,
notices and hints, and for names of licenses made from what statements say around a name. A rule's keyword is the longest
literal run of its expression that no alternative or option can leave out, so each match holds it (or one for each
alternative): one automaton finds all keywords of a text in a pass, and only the rules run whose keyword is there. Detections are ordered by priority, then
length, then place; one that lies within a kept detection is suppressed, so "gnu general public license" says nothing
inside "gnu lesser general public license version 3 ...". A text's score joins its kept detections' weights,
1 - product(1 - weight).

Base phrases are found in any case: all places where a phrase's words stand consecutively. Null or empty text has no
words. Ties in all of priority, length and place go by the rules' order. Repeated rows are scanned alike, an empty table
gives an empty result, ids aren't used. Other columns stay; one named like a result column is replaced. Matches lie within
one text; a rule's gaps are bounded, and detections are kept in a tree of interval ends, so very long texts take time in
proportion, but for a logarithm, and a few times their size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import ALNUM, in_chunks, others, raw
from textlake.llm.signatures import HINTS, NOTICES, TEXTS

RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label; names in running text, as regular expressions over words; the identifier's words. Longer names come first.
FAMILIES = (
    ("agpl-3", r"gnu affero general public license(?: version 3)?", "agpl 3 0"),
    ("lgpl-2.1", r"gnu (?:lesser|library) general public license version 2(?: 1)?", "lgpl 2 1"),
    ("lgpl-3", r"gnu lesser general public license(?: version 3)?", "lgpl 3 0"),
    ("gpl-2", r"gnu general public license version 2", "gpl 2 0"),
    ("gpl-3", r"gnu general public license version 3", "gpl 3 0"),
    ("gpl", r"gnu (?:general public license|gpl)", "gpl 1 0"),
    ("gfdl", r"gnu free documentation license", "gfdl 1 3"),
    ("apache-1.1", r"apache (?:software )?license version 1 1", "apache 1 1"),
    ("apache-2", r"apache (?:software )?license(?: version)? 2(?: 0)?", "apache 2 0"),
    ("mit", r"(?:mit|expat|x11) license", "mit"),
    ("mit-0", r"mit no attribution license", "mit 0"),
    ("bsd-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd) license", "bsd 2 clause"),
    ("bsd-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) license", "bsd 3 clause"),
    ("bsd-4", r"(?:bsd 4 clause|4 clause bsd|original bsd) license", "bsd 4 clause"),
    ("bsd", r"bsd(?: style)? license", "0bsd"),
    ("isc", r"isc license", "isc"),
    ("mpl-1.1", r"mozilla public license version 1 1", "mpl 1 1"),
    ("mpl-2", r"mozilla public license(?: version)?(?: 2 0)?", "mpl 2 0"),
    ("epl-1", r"eclipse public license(?: version)? 1 0", "epl 1 0"),
    ("epl-2", r"eclipse public license(?: version)?(?: 2 0)?", "epl 2 0"),
    ("edl-1", r"eclipse distribution license", "edl 1 0"),
    ("cddl-1", r"common development and distribution license", "cddl 1 0"),
    ("cpl-1", r"common public license", "cpl 1 0"),
    ("eupl-1.2", r"european union public licen[cs]e", "eupl 1 2"),
    ("artistic-2", r"artistic license(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic-1", r"artistic license", "artistic 1 0"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("boost-1", r"boost software license", "bsl 1 0"),
    ("business-source", r"business source license", "busl 1 1"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license", "wtfpl"),
    ("ofl-1.1", r"sil open font license", "ofl 1 1"),
    ("psf-2", r"python software foundation license", "psf 2 0"),
    ("php-3", r"php license", "php 3 01"),
    ("ruby", r"ruby license", "ruby"),
    ("openssl", r"openssl license", "openssl"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("ncsa", r"university of illinois ncsa open source license", "ncsa"),
    ("ms-pl", r"microsoft public license", "ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "ms rl"),
    ("osl-3", r"open software license", "osl 3 0"),
    ("afl-3", r"academic free license", "afl 3 0"),
    ("upl-1", r"universal permissive license", "upl 1 0"),
    ("sspl-1", r"server side public license", "sspl 1 0"),
    ("elastic-2", r"elastic license", "elastic 2 0"),
    ("odbl-1", r"open (?:data commons open )?database license", "odbl 1 0"),
    ("odc-by-1", r"open data commons attribution license", "odc by 1 0"),
    ("pddl-1", r"public domain dedication and license", "pddl 1 0"),
    ("cc0-1", r"creative commons zero(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc0-1", r"cc0(?: 1 0)? universal", "cc0 1 0"),
    ("cc-by-nc-nd", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", r"(?:creative commons )?attribution non ?commercial share ?alike", "cc by nc sa 4 0"),
    ("cc-by-nc", r"(?:creative commons )?attribution non ?commercial", "cc by nc 4 0"),
    ("cc-by-nd", r"(?:creative commons )?attribution no ?deriv(?:ative)?s", "cc by nd 4 0"),
    ("cc-by-sa", r"(?:creative commons )?attribution share ?alike", "cc by sa 4 0"),
    ("cc-by", r"creative commons attribution", "cc by 4 0"),
)
#: What a statement says around a name, its weight and its priority; {} is the name.
STATEMENTS = (
    (r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{}", 0.95, 80),
    (r"subject to the (?:terms (?:and conditions )?of the )?{}", 0.9, 70),
    (r"(?:you may obtain|see) a copy of the {}", 0.9, 65),
    (r"under the (?:terms of the )?{}", 0.85, 60),
    (r"{}", 0.6, 30),
)
@dataclass(frozen=True)
class Rule:
    """keywords: of these any match holds one."""

    label: str
    keywords: tuple[str, ...]
    found: re.Pattern
    weight: float
    priority: int


#: What may be absent or differ in a match, innermost brackets first: groups, classes, escapes, and characters that may repeat or miss.
_UNSURE = re.compile(r"\([^()]*\)(?:[?*+]|\{[0-9,]*\})?|\[[^\]]*\](?:[?*+]|\{[0-9,]*\})?|\\.(?:[?*+]|\{[0-9,]*\})?|.(?:[?*]|\{[0-9,]*\})")


#: A group that must be there.
_GROUP = re.compile(r"\((?:\?:)?([^()]*)\)(?![?*]|\{0)")
#: Literal runs shorter than this say too little, where a group's alternatives say more.
TELLING = 6


def keywords(expression: str) -> tuple[str, ...]:
    """Literals of which every match holds one: the longest run that nothing can leave out, or else those of a group's alternatives."""
    bare = expression
    while (inner := _UNSURE.sub("|", bare)) != bare:
        bare = inner
    best = max((x.strip() for x in bare.split("|")), key=len)
    if len(best) >= TELLING:
        return (best,)
    for group in _GROUP.finditer(expression):
        own = [keywords(x) for x in group[1].split("|")]
        if all(x for one in own for x in one) and min(len(x) for one in own for x in one) > len(best):
            return tuple(sorted({x for one in own for x in one}))
    return (best,)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    out = []

    def add(label: str, weight: float, priority: int, expression: str) -> None:
        out.append(Rule(label, keywords(expression), re.compile(rf"(?<= ){expression}(?= )".encode()), weight, priority))

    for label, name, identifier in FAMILIES:
        for statement, weight, priority in STATEMENTS:
            add(label, weight, priority, statement.format(name))
        add(label, 0.99, 100, rf"spdx license identifier {identifier}(?: only| or later)?")
        if " " in identifier:
            add(label, 0.9, 75, rf"licen[cs]e (?:is )?{identifier}")
    for signature in (*TEXTS, *NOTICES, *HINTS):
        add(*signature)
    for phrase, label in BASE:
        add(label, 0.85, 62, phrase)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.found.pattern)))


@cache
def _prefilter() -> ahocorasick.Automaton:
    """Finds keywords; each holds the numbers of its rules."""
    by_keyword: dict[str, list[int]] = {}
    for number, rule in enumerate(rules()):
        for word in rule.keywords:
            by_keyword.setdefault(word, []).append(number)
    made = ahocorasick.Automaton()
    for word, numbers in by_keyword.items():
        made.add_word(word, tuple(numbers))
    made.make_automaton()
    return made


class Covered:
    """Kept detections: whether one lies within another, by the furthest end of all that begin no later (a tree of prefix maxima)."""

    def __init__(self, begins: list[int]):
        self.begins = sorted({*begins})
        self.ends = [0] * (len(self.begins) + 1)

    def holds(self, begin: int, end: int) -> bool:
        i = bisect_right(self.begins, begin)
        while i:
            if self.ends[i] >= end:
                return True
            i &= i - 1
        return False

    def add(self, begin: int, end: int) -> None:
        i = bisect_right(self.begins, begin)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i


def detections(line: bytes) -> list[tuple[int, int, Rule]]:
    """The kept detections (begin, end, rule) in a line of words, the highest priority first."""
    numbers = {n for _, own in _prefilter().iter(line.decode("latin-1")) for n in own}
    found = [(-rules()[n].priority, x.start() - x.end(), x.start(), n, x.end()) for n in numbers for x in rules()[n].found.finditer(line)]
    kept, out = Covered([x[2] for x in found]), []
    for _, _, begin, number, end in sorted(found):
        if not kept.holds(begin, end):
            kept.add(begin, end)
            out.append((begin, end, rules()[number]))
    return out


def base_places(line: bytes) -> list[tuple[int, str]]:
    """Byte places and labels of the base phrases."""
    out = []
    for phrase, label in BASE:
        key, at = f" {phrase} ".encode(), -1
        while (at := line.find(key, at + 1)) >= 0:
            out.append((at, label))
    return out


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text, and its detections (label, first word, end)."""
    words = text.translate(ALNUM).split()
    line = b" " + b" ".join(words) + b" "
    found = detections(line)
    if not found:  # a base phrase is a rule of its own
        return len(words), 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    number = lambda at: int(np.searchsorted(spaces, at))
    base = base_places(line)
    places = [number(at) for at, _ in base]
    labels, missed = {label for _, label in base}, 1.0
    own = sorted(labels)
    for _, _, rule in found:
        labels.add(rule.label)
        missed *= 1 - rule.weight
    spans = [{"label": rule.label, "first_word": number(begin - 1), "end_word": number(end)} for begin, end, rule in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(own), ",".join(sorted(labels)), 1 - missed, spans


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])
STRUCT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,detections:array<struct<label:string,first_word:long,end_word:long>>>"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(SPAN))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The documents with n_words, n_base, first_word, last_word, base_labels, labels, score and the kept detections by priority (words from 0, ends exclusive)."""

    def made(chunk: pa.RecordBatch) -> pa.Array:
        out = [scan(x) for x in raw(chunk)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(KINDS)], list(RESULT))

    @F.arrow_udf(STRUCT)
    def found(text: pa.Array) -> pa.Array:
        return in_chunks(made, text)

    keep = [F.col(f"`{c}`") for c in others(docs, RESULT)]
    return docs.select(*keep, found("text").alias("_made")).select(*keep, "_made.*")
