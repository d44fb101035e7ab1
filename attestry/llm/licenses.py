"""License scan: ordered signature rules behind keyword gates, with priority and containment to settle overlaps."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Phrases and labels of the base rule.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License families. Label, names as they stand in texts (words after normalising), identifiers of the SPDX kind.
FAMILIES = [
    ("afl", ["academic free license"], ["afl 3 0", "afl 2 1"]),
    ("agpl", ["affero general public license"], ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"]),
    ("apache", ["apache license", "apache software license"], ["apache 2 0", "apache 1 1"]),
    ("apsl", ["apple public source license"], ["apsl 2 0"]),
    ("artistic", ["artistic license", "clarified artistic license"], ["artistic 2 0", "artistic 1 0"]),
    ("blueoak", ["blue oak model license"], ["blueoak 1 0 0"]),
    ("bsd", ["bsd license", "berkeley software distribution license", "new bsd license", "simplified bsd license", "modified bsd license"], ["bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"]),
    ("bsl", ["boost software license"], ["bsl 1 0"]),
    ("busl", ["business source license"], ["busl 1 1"]),
    ("cc by", ["creative commons attribution license"], ["cc by 4 0", "cc by 3 0"]),
    ("cc by nc", ["creative commons attribution noncommercial license"], ["cc by nc 4 0", "cc by nc 3 0"]),
    ("cc by nc nd", ["creative commons attribution noncommercial noderivatives license"], ["cc by nc nd 4 0"]),
    ("cc by nc sa", ["creative commons attribution noncommercial sharealike license"], ["cc by nc sa 4 0"]),
    ("cc by nd", ["creative commons attribution noderivatives license"], ["cc by nd 4 0"]),
    ("cc by sa", ["creative commons attribution sharealike license"], ["cc by sa 4 0", "cc by sa 3 0"]),
    ("cc0", ["creative commons zero", "cc0 public domain dedication"], ["cc0 1 0"]),
    ("cddl", ["common development and distribution license"], ["cddl 1 0", "cddl 1 1"]),
    ("cecill", ["cecill free software license"], ["cecill 2 1", "cecill b", "cecill c"]),
    ("cpl", ["common public license"], ["cpl 1 0"]),
    ("ecl", ["educational community license"], ["ecl 2 0"]),
    ("elastic", ["elastic license"], ["elastic 2 0"]),
    ("epl", ["eclipse public license"], ["epl 1 0", "epl 2 0"]),
    ("eupl", ["european union public license", "european union public licence"], ["eupl 1 1", "eupl 1 2"]),
    ("gfdl", ["free documentation license"], ["gfdl 1 3", "gfdl 1 2"]),
    ("gpl", ["gnu general public license", "general public license"], ["gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 3 0 only", "gpl 2 0 or later", "gpl 3 0 or later"]),
    ("isc", ["isc license"], ["isc"]),
    ("lgpl", ["lesser general public license", "library general public license"], ["lgpl 2 1", "lgpl 3 0", "lgpl 2 1 or later", "lgpl 3 0 or later"]),
    ("lppl", ["latex project public license"], ["lppl 1 3c"]),
    ("mit", ["mit license", "expat license"], ["mit", "mit 0"]),
    ("mpl", ["mozilla public license"], ["mpl 1 1", "mpl 2 0"]),
    ("ms pl", ["microsoft public license"], ["ms pl"]),
    ("ms rl", ["microsoft reciprocal license"], ["ms rl"]),
    ("ncsa", ["university of illinois ncsa open source license"], ["ncsa"]),
    ("odbl", ["open database license"], ["odbl 1 0"]),
    ("ofl", ["open font license"], ["ofl 1 1"]),
    ("openssl", ["openssl license"], ["openssl"]),
    ("osl", ["open software license"], ["osl 3 0"]),
    ("pddl", ["public domain dedication and license"], ["pddl 1 0"]),
    ("php", ["php license"], ["php 3 01"]),
    ("postgresql", ["postgresql license"], ["postgresql"]),
    ("psf", ["python software foundation license"], ["psf 2 0", "python 2 0"]),
    ("sspl", ["server side public license"], ["sspl 1 0"]),
    ("unlicense", ["the unlicense"], ["unlicense"]),
    ("vim", ["vim license"], ["vim"]),
    ("w3c", ["w3c software notice and license"], ["w3c"]),
    ("wtfpl", ["do what the fuck you want to public license"], ["wtfpl"]),
    ("zlib", ["zlib license", "zlib libpng license"], ["zlib"]),
    ("zpl", ["zope public license"], ["zpl 2 1"]),
]

# Sentences that stand only in one license's own text.
CLAUSES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("proprietary", "all rights reserved"),
    ("public domain", "released into the public domain"),
    ("public domain", "dedicated to the public domain"),
]

VERSION = r"(?: v| version| v?)(?: ?[0-9]+){1,3}"
LEAD = r"(?:(?:re|dual |sub)?licensed|released|distributed|available|published|provided|covered) (?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: gnu)?"


@dataclass(frozen=True)
class Rule:
    """Lower ``priority`` is stronger; every keyword must stand in the text before ``pattern`` is tried."""

    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """Signatures in order: own clauses, tagged identifiers, named grants, names with a version, bare names, bare identifiers after a grant."""
    made = [Rule(label, 0, 1.0, (" ".join(text.split()[:3]),), text) for label, text in CLAUSES]
    for label, names, ids in FAMILIES:
        for spdx in ids:
            made.append(Rule(label, 1, 1.0, ("spdx", spdx), rf"spdx license identifier {spdx}"))
            made.append(Rule(label, 2, 0.9, ("licen", spdx), rf"(?:{LEAD}|license|licence|licensed) {spdx}(?: license| licence)?"))
            if " " in spdx:
                made.append(Rule(label, 5, 0.6, (spdx,), rf"{spdx} licen[sc]e"))
        for name in names:
            made.append(Rule(label, 2, 0.95, (name,), rf"{LEAD} {name}(?:{VERSION})?"))
            made.append(Rule(label, 3, 0.9, (name,), rf"{name}{VERSION}"))
            made.append(Rule(label, 4, 0.7, (name,), name))
    return sorted(made, key=lambda r: (r.priority, -len(r.pattern), r.label, r.pattern))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


class Scanner:
    """Compiled rules; ``scan`` gives the words, the base places and the settled detections of one text."""

    def __init__(self, signatures: Sequence[Rule]) -> None:
        self.rules = [(r, re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])")) for r in signatures]
        self.gate = sorted({k for r in signatures for k in r.keywords})
        self.base = [(p, label, re.compile(rf"(?<![^ ]){p}(?![^ ])")) for p, label in BASE.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        found = WORD.findall((text or "").translate(CAPITALS) if text and not text.isascii() else (text or "").lower())
        flat = " ".join(found)
        seen = {k for k in self.gate if k in flat}
        if not seen:
            return len(found), [], []
        starts, at = [], 0
        for w in found:
            starts.append(at)
            at += len(w) + 1
        place = lambda i: bisect_right(starts, i) - 1
        base = [(place(m.start()), place(m.end() - 1), label) for p, label, rx in self.base if p in flat for m in rx.finditer(flat)]
        hits: list[tuple[int, int, str, float]] = []
        firsts: list[int] = []
        reach: list[int] = []
        for rule, rx in self.rules:
            if seen.issuperset(rule.keywords):
                known = len(hits)
                for m in rx.finditer(flat):
                    a, b = place(m.start()), place(m.end() - 1)
                    # A stronger rule already holds this place: what lies inside it says nothing more. Matches of one rule never overlap.
                    at = bisect_right(firsts, a)
                    if not at or reach[at - 1] < b:
                        hits.append((a, b, rule.label, rule.weight))
                if len(hits) > known:
                    # Starts in order, and how far the spans that start up to there reach.
                    ends = sorted((x, y) for x, y, *_ in hits)
                    firsts, reach = [x for x, _ in ends], list(accumulate((y for _, y in ends), max))
        return len(found), sorted(base), sorted(hits)


OUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType())]))),
])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, word count, base places, labels, score and the settled spans (words from 0, last inclusive).

    ``score`` is 1 minus the product of (1 - weight) over distinct labels' strongest detections; 0 without one. Null and
    empty texts have no words and no labels; texts are read whole, a batch of rows at a time; repeated rows and null
    keys are judged one by one; other columns are not read.
    """
    signatures = list(signatures or rules())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(signatures)
        for batch in batches:
            rows = []
            for value in batch["_text"]:
                n, base, hits = scanner.scan(value)
                best: dict[str, float] = {}
                for _, _, label, weight in hits:
                    best[label] = max(best.get(label, 0.0), weight)
                rest = 1.0
                for label in sorted(best):
                    rest *= 1 - best[label]
                named = sorted({x[2] for x in base})
                rows.append((n, len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), ",".join(named), ",".join(sorted({*named, *best})), 1 - rest if best else (0.7 if base else 0.0), [{"first": a, "last": b, "label": label} for a, b, label, _ in hits]))
            out = pd.DataFrame(rows, columns=OUT.names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, key, batch["_key"].values)
            yield out

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *OUT.fields])
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInPandas(run, schema)
