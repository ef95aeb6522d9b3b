"""Operator 5: licence scan by ordered signature rules.

Rules are regular expressions over the lower-cased text: signatures of licence texts and notices written by hand
(``licence_rules``), names of licences with their versions and grants, tags, and the base phrases. Each has a
priority, a label and keywords that the text must hold before the expression is tried at all; one automaton
finds all keywords in one pass. What lower rules find inside an interval that a higher rule has found is
suppressed, so "GNU General Public License, version 3" is reported once, as its version. Phrases of the base
list are always reported. Suppression sorts intervals and searches them, so it is n log n in detections.

One pass over the documents, no shuffle; hot sources or copies make no difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.licence_rules import BODY, NOTICE
from kindred.llm.tables import table
from kindred.llm.words import chunks, encoded

#: Base phrases and their labels: fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Bytes of a word, once A-Z are lower case: digits, a-z and all of any longer UTF-8 sequence.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_W, _GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    score: float
    keywords: tuple[bytes, ...]
    source: bytes

    @property
    def pattern(self) -> re.Pattern:
        return _compiled(self.source)


@lru_cache(maxsize=None)
def _compiled(source: bytes) -> re.Pattern:
    """Most rules are never tried in a process, so they are compiled when first needed; there are as many as rules."""
    return re.compile(source)


#: family: (label stem, names, versions that it is published in). A name's words may stand apart by anything that is no word.
FAMILIES = [
    ("gpl", ["gnu general public licen[sc]e", "gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl", "agpl"], ["1", "3"]),
    ("gfdl", ["gnu free documentation licen[sc]e", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache software licen[sc]e", "apache licen[sc]e", "asl"], ["1", "1 1", "2", "2 0"]),
    ("mpl", ["mozilla public licen[sc]e", "mpl"], ["1", "1 1", "2", "2 0"]),
    ("epl", ["eclipse public licen[sc]e", "epl"], ["1", "1 0", "2", "2 0"]),
    ("cddl", ["common development and distribution licen[sc]e", "cddl"], ["1", "1 0", "1 1"]),
    ("cpl", ["common public licen[sc]e"], ["1", "1 0"]),
    ("eupl", ["european union public licen[sc]e", "eupl"], ["1", "1 1", "1 2"]),
    ("artistic", ["artistic licen[sc]e"], ["1", "1 0", "2", "2 0"]),
    ("ofl", ["sil open font licen[sc]e", "open font licen[sc]e"], ["1", "1 0", "1 1"]),
    ("osl", ["open software licen[sc]e"], ["1", "2", "2 1", "3", "3 0"]),
    ("afl", ["academic free licen[sc]e"], ["1 2", "2", "2 1", "3", "3 0"]),
    ("bsl", ["boost software licen[sc]e"], ["1", "1 0"]),
    ("psf", ["python software foundation licen[sc]e", "psf licen[sc]e"], ["2"]),
    ("zpl", ["zope public licen[sc]e"], ["2", "2 0", "2 1"]),
    ("cc-by", ["creative commons attribution licen[sc]e", "creative commons attribution", "cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["creative commons attribution share ?alike", "cc by sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial", "cc by nc"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["creative commons attribution no ?derivatives", "cc by nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike", "cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?derivatives", "cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", ["creative commons zero", "cc0"], ["1 0"]),
]
#: Licences without versions: label, names.
SINGLE = [
    ("mit", ["mit licen[sc]e", "expat licen[sc]e"]), ("isc", ["isc licen[sc]e"]), ("zlib", ["zlib licen[sc]e", "zlib libpng licen[sc]e"]),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd licen[sc]e", "freebsd licen[sc]e"]),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd licen[sc]e", "modified bsd licen[sc]e", "revised bsd licen[sc]e"]),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd licen[sc]e"]), ("bsd", ["bsd licen[sc]e", "bsd style licen[sc]e"]),
    ("wtfpl", ["wtfpl"]), ("unlicense", ["the unlicense", "unlicense org"]), ("beerware", ["beerware licen[sc]e", "beer ware licen[sc]e"]),
    ("ms-pl", ["microsoft public licen[sc]e"]), ("ms-rl", ["microsoft reciprocal licen[sc]e"]), ("odbl", ["open database licen[sc]e", "odbl"]),
    ("pddl", ["public domain dedication and licen[sc]e"]), ("public-domain", ["public domain dedication", "dedicated to the public domain", "released into the public domain"]),
    ("proprietary", ["all rights reserved", "proprietary and confidential"]), ("postgresql", ["postgresql licen[sc]e"]), ("ruby", ["ruby licen[sc]e"]),
    ("php", ["php licen[sc]e"]), ("vim", ["vim licen[sc]e"]), ("x11", ["x11 licen[sc]e"]), ("openssl", ["openssl licen[sc]e"]), ("curl", ["curl licen[sc]e"]),
]
#: How a licence is granted, before its name.
GRANTS = ["licen[sc]ed under", "released under", "distributed under", "available under", "published under", "made available under", "under the terms of", "subject to", "governed by"]


def _expression(phrase: str) -> bytes:
    return _GAP.join(w.encode() for w in phrase.replace(" ?", "\0").split(" ")).replace(b"\0", b"[^0-9a-z\\x80-\\xff]?")


def _signature(phrase: str) -> bytes:
    """Expression of a hand-written rule."""
    # words in brackets may hold spaces; a bracket with ? may be missing, with the space that parts it
    words = re.findall(r"(?:\([^)]*\)\??|\[[^\]]*\]|[^\s(\[])+", phrase.replace(" ?", "\0"))
    out = b""
    for w in words:
        if w == "*":
            out += b"(?:" + _W + b"+" + _GAP + b"){0,8}"
            continue
        x = w.encode().replace(b" ", _GAP).replace(b"\0", b"[^0-9a-z\\x80-\\xff]?")
        out += b"(?:" + x[:-1] + _GAP + b")?" if re.fullmatch(r"\([^)]*\)\?", w) else x + _GAP
    return out.removesuffix(_GAP)


def _literal(phrase: str) -> tuple[bytes, ...]:
    """The longest two literal words that every match of a hand-written rule holds."""
    plain = re.sub(r"\([^)]*\)\??", " ", phrase.replace(" ?", "?")).split(" ")
    found = {m[0] for w in plain if (m := re.match(r"[a-z0-9]+(?![a-z0-9]*\?)", w))}
    return tuple(w.encode() for w in sorted(found, key=lambda w: (len(w), w))[-2:])


def _keywords(*phrases: str) -> tuple[bytes, ...]:
    """The literal letters of a phrase's longest words: a text without them can't match."""
    found = [re.split(r"[^a-z0-9]", w.replace("licen[sc]e", "licen").replace("licen[sc]ed", "licen"))[0] for p in phrases for w in p.replace(" ?", " ").split(" ")]
    return tuple(w.encode() for w in sorted({w for w in found if w}, key=len)[-2:])


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first: texts, notices, tags, grants with a version, grants, names with a version, bare names, base phrases."""
    out = []

    def add(kind: str, label: str, priority: int, score: float, phrase: bytes, keys: tuple[bytes, ...]) -> None:
        out.append(Rule(f"{kind}:{label}:{len(out)}", label, priority, score, keys, rb"(?<!" + _W + rb")" + phrase + rb"(?!" + _W + rb")"))

    grant = b"(?:" + b"|".join(map(_expression, GRANTS)) + b")" + _GAP + b"(?:(?:the|a|an|this)" + _GAP + b")?"
    version = b"(?:" + _GAP + b"(?:version|ver|v))?"
    for stem, names, versions in FAMILIES:
        for name in names:
            keys, text = _keywords(name), _expression(name)
            for v in versions:
                dotted = v.replace(" ", ".")
                number = _GAP + b"v?" + _expression(v)
                full = f"{stem}-{dotted if '.' in dotted else dotted + '.0'}"
                add("grant", full, 60, 1.0, grant + text + version + number, keys)
                add("version", full, 40, 0.9, text + version + number, keys)
            add("grant", stem, 50, 0.95, grant + text, keys)
            add("name", stem, 20, 0.7 if " " in name else 0.4, text, keys)
        for v in versions:
            tag = f"{stem}-{v.replace(' ', '.')}"
            add("tag", tag if "." in tag else tag + ".0", 70, 1.0, _expression("spdx licen[sc]e identifier " + stem.replace("-", " ") + " " + v), (b"spdx",))
    for label, names in SINGLE:
        for name in names:
            keys, text = _keywords(name), _expression(name)
            add("grant", label, 50, 0.95, grant + text, keys)
            add("name", label, 20, 0.3 if label == "proprietary" else 0.7, text, keys)
        add("tag", label, 70, 1.0, _expression("spdx licen[sc]e identifier " + label.replace("-", " ")), (b"spdx",))
    for kind, priority, lines in (("text", 90, BODY), ("notice", 80, NOTICE)):
        for line in lines.strip().splitlines():
            label, phrase = line.split(": ", 1)
            add(kind, label, priority, 1.0 if priority == 90 else 0.95, _signature(phrase), _literal(phrase))
    for phrase, label in BASE.items():
        words = phrase.encode().split(b" ")
        add("base", label, 0, 0.5, _GAP.join(words), tuple(sorted(words, key=len)[-2:]))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


@lru_cache(maxsize=1)
def _gate():
    """An automaton of all keywords, and the rules (by their place in the order) under one of their keywords, with the others."""
    found, by_word = ahocorasick.Automaton(), {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            found.add_word(k.decode("latin-1"), k)
        by_word.setdefault(r.keywords[-1], []).append((i, frozenset(r.keywords)))
    found.make_automaton()
    return found, by_word


def opened(low: bytes) -> list[int]:
    """Places of the rules whose keywords the text holds."""
    found, by_word = _gate()
    held = {k for _, k in found.iter(low.decode("latin-1"))}
    return sorted(i for k in held for i, needs in by_word.get(k, ()) if needs <= held)


def _inside(s: np.ndarray, e: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which intervals [s, e) lie in one of those of a set in which starts and ends both rise."""
    at = np.searchsorted(starts, s, "right") - 1
    return (at >= 0) & (np.append(ends, 0)[at] >= e)


def detections(low: bytes) -> list[tuple[int, int, Rule]]:
    """Spans (start, end, rule) of a lower-cased text that no span of a higher rule contains and no longer one of the same rank, and all base phrases; by start."""
    ranks: dict[int, list[int]] = {}
    for i in opened(low):
        ranks.setdefault(-rules()[i].priority, []).append(i)
    starts, ends = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kept: list[tuple[int, int, int]] = []
    for rank in sorted(ranks):
        spans = [(*m.span(), i) for i in ranks[rank] for m in rules()[i].pattern.finditer(low)]
        if not spans:
            continue
        s, e, i = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
        if rank == 0:  # base phrases
            kept += spans
            continue
        free = ~_inside(s, e, starts, ends)
        s, e, i = s[free], e[free], i[free]
        # of equal starts the longest first: an interval with an end as late before it lies inside that
        order = np.lexsort((-e, s))
        s, e, i = s[order], e[order], i[order]
        if not len(s):
            continue
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])
        place = np.cumsum(fresh) - 1
        us, ue = s[fresh], e[fresh]
        outer = np.concatenate([[True], np.maximum.accumulate(ue)[:-1] < ue[1:]])
        keep = outer[place]
        kept += zip(s[keep].tolist(), e[keep].tolist(), i[keep].tolist(), strict=True)
        # the set of all intervals so far that lie in no other
        s, e = np.append(starts, us[outer]), np.append(ends, ue[outer])
        order = np.lexsort((-e, s))
        s, e = s[order], e[order]
        outer = np.concatenate([[True], np.maximum.accumulate(e)[:-1] < e[1:]])
        starts, ends = s[outer], e[outer]
    order = rules()
    return [(s, e, order[i]) for s, e, i in sorted(kept, key=lambda x: (x[0], -x[1], order[x[2]].name))]


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``found``.

    found lists (label, rule, first word, last word) of every detection. A null or empty text has no words
    and no labels (labels are then empty strings, score 0). Repeated rows and null keys each give a row.
    Long texts are whole. Further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [b.lower() for b in encoded(pdf["t"])]
            for i, j in chunks(items):
                buf = np.frombuffer(b"\n".join([*items[i:j], b""]), dtype=np.uint8)
                w = WORD[buf]
                starts = np.flatnonzero(w & ~np.concatenate([[False], w[:-1]]))
                offset = np.concatenate([[0], np.cumsum([len(b) + 1 for b in items[i:j]])])
                first = np.searchsorted(starts, offset)
                rows = []
                for d, low in enumerate(items[i:j]):
                    own = starts[first[d] : first[d + 1]] - offset[d]
                    spans = detections(low)
                    begin, last = np.searchsorted(own, [x[0] for x in spans]).tolist(), (np.searchsorted(own, [x[1] for x in spans]) - 1).tolist()
                    found = [(r.label, r.name, b, z, r) for b, z, (_, _, r) in zip(begin, last, spans, strict=True)]
                    base = [f for f in found if f[4].priority == 0]
                    miss = 1.0
                    for f in found:
                        miss *= 1 - 0.9 * f[4].score
                    at = [f[2] for f in base]
                    rows.append(
                        (len(own), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found})), 1 - miss if found else 0.0, [dict(zip(("label", "rule", "first", "last"), f[:4], strict=True)) for f in found])
                    )
                out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])
                out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
                out.insert(0, "k", pdf["k"].iloc[i:j].to_numpy())  # strings
                yield out

    kind = "k string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,rule:string,first:long,last:long>>"
    out = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, kind)
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), *out.columns[1:])


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("found")
