"""License scans: ordered signature rules gated by a keyword prefilter, with priority and interval containment.

Clauses of notices and license texts are written by hand (license_clauses); the names of license families, their
versions and forms (headers, SPDX lines, notices, URLs) give the other rules. A rule is a regular expression over
lower-cased (A-Z) text in which a blank stands for blanks, line ends and comment marks; keywords of which every match
holds one; a priority and a relevance. Keywords are looked for once in a whole batch; only texts that hold one run the
rules that it gates. Detections are resolved in order of priority, then length, then rule: one whose interval lies
inside an accepted one is suppressed (accepted ones are kept in order, so each test is a binary search).

Defined results: null text is empty; no detection gives no labels and score 0; a text that stands twice, or whose id
does, has the same row twice; an empty table gives none; other columns are passed over; of equal intervals the rule of
higher priority stays, of equal priority the earlier one. Very long texts are read whole, a slice of their own each.
The base phrases are counted on words, whatever stands between them, and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_clauses import CLAUSES
from .shared import map_slices
from .textkernel import ALNUM, LOWER, raw, words

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Signature:
    name: str
    label: str
    pattern: str
    keyword: str
    priority: int
    relevance: float


#: label, names as written in prose, SPDX stem, versions, URL path
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl"), "gpl", ("1.0", "2.0", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl"), "lgpl", ("2.0", "2.1", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl"), "agpl", ("1.0", "3.0"), r"gnu\.org/licenses/agpl"),
    ("gfdl", ("gnu free documentation licen[sc]e", "gnu fdl"), "gfdl", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e"), "apache", ("1.0", "1.1", "2.0"), r"apache\.org/licenses/license"),
    ("mpl", ("mozilla public licen[sc]e",), "mpl", ("1.0", "1.1", "2.0"), r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", ("eclipse public licen[sc]e",), "epl", ("1.0", "2.0"), r"eclipse\.org/legal/epl"),
    ("cddl", ("common development and distribution licen[sc]e",), "cddl", ("1.0", "1.1"), r"opensource\.org/licenses/cddl"),
    ("eupl", ("european union public licen[sc]e",), "eupl", ("1.0", "1.1", "1.2"), r"joinup\.ec\.europa\.eu/[\w/-]*eupl"),
    ("artistic", ("artistic licen[sc]e",), "artistic", ("1.0", "2.0"), r"opensource\.org/licenses/artistic"),
    ("osl", ("open software licen[sc]e",), "osl", ("1.0", "2.0", "2.1", "3.0"), r"opensource\.org/licenses/osl"),
    ("afl", ("academic free licen[sc]e",), "afl", ("1.1", "2.0", "2.1", "3.0"), r"opensource\.org/licenses/afl"),
    ("bsl", ("boost software licen[sc]e",), "bsl", ("1.0",), r"boost\.org/license"),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), "ofl", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    ("upl", ("universal permissive licen[sc]e",), "upl", ("1.0",), r"opensource\.org/licenses/upl"),
    ("odbl", ("open database licen[sc]e",), "odbl", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), "psf", ("2.0",), r"docs\.python\.org/\d/license"),
    ("php", ("php licen[sc]e",), "php", ("3.0", "3.01"), r"php\.net/license"),
    ("ncsa", ("university of illinois/ncsa open source licen[sc]e", "ncsa open source licen[sc]e"), "ncsa", (), r"opensource\.org/licenses/ncsa"),
    ("zlib", ("zlib licen[sc]e", "zlib/libpng licen[sc]e"), "zlib", (), r"zlib\.net/zlib_license"),
    ("isc", ("isc licen[sc]e",), "isc", (), r"opensource\.org/licenses/isc"),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"), "mit", (), r"opensource\.org/licenses/mit"),
    ("bsd-2-clause", (r"(?:simplified|2-clause|two-clause|freebsd) bsd licen[sc]e", "bsd 2-clause(?: licen[sc]e)?"), "bsd-2-clause", (), r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", (r"(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e", "bsd 3-clause(?: licen[sc]e)?"), "bsd-3-clause", (), r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd", ("bsd licen[sc]e", "bsd-style licen[sc]e"), "bsd", (), r"opensource\.org/licenses/bsd-license"),
    ("unlicense", ("the unlicense",), "unlicense", (), r"unlicense\.org"),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e", "wtfpl"), "wtfpl", (), r"wtfpl\.net"),
    ("cc0", ("cc0", "creative commons zero", "creative commons cc0"), "cc0", ("1.0",), r"creativecommons\.org/publicdomain/zero"),
)
#: creative commons: label, prose name, URL and SPDX part
COMMONS = (
    ("cc-by", "attribution", "by"), ("cc-by-sa", "attribution[- ]share[- ]?alike", "by-sa"), ("cc-by-nd", "attribution[- ]no[- ]?deriv(?:ative|ative work|)s?", "by-nd"),
    ("cc-by-nc", "attribution[- ]non[- ]?commercial", "by-nc"), ("cc-by-nc-sa", "attribution[- ]non[- ]?commercial[- ]share[- ]?alike", "by-nc-sa"),
    ("cc-by-nc-nd", "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative|ative work|)s?", "by-nc-nd"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: What a blank of a pattern matches: blanks and line ends, with comment marks between them.
GAP = r"\s+(?:(?:[*#;%!|>]+|//+|--+|dnl|rem)\s+)*"
VERSION = r"(?:,? ?(?:version|v\.?|ver\.?)? ?{}(?!\d))"


@cache
def signatures() -> tuple[Signature, ...]:
    """The ordered rules: SPDX lines, URLs, versioned names, names, clauses; higher priority first."""
    out: list[Signature] = []

    def add(name, label, pattern, keyword, priority, relevance):
        out.append(Signature(name, label, pattern, keyword, priority, relevance))

    for label, names, spdx, versions, url in FAMILIES:
        for v in versions:
            short = v.removesuffix(".0")
            number = f"(?:{re.escape(v)}|{re.escape(short)}(?![.\\d]))"
            add(f"{label}-{v}-spdx", f"{label}-{v}", rf"spdx-license-identifier: ?{spdx}-{re.escape(v)}(?:-only|-or-later|\+)?", "spdx", 100, 1.0)
            add(f"{label}-{v}-url", f"{label}-{v}", rf"https?://(?:www\.)?{url}[-/]?{number}", "http", 90, 0.9)
            for i, n in enumerate(names):
                add(f"{label}-{v}-name{i}", f"{label}-{v}", rf"\b{n}{VERSION.format(number)}(?: or (?:\(at your option\) )?(?:any )?later)?", _keyword(n), 80, 0.9)
        if not versions:
            add(f"{label}-spdx", label, rf"spdx-license-identifier: ?{spdx}\b", "spdx", 95, 1.0)
        add(f"{label}-url", label, rf"https?://(?:www\.)?{url}", "http", 60, 0.8)
        for i, n in enumerate(names):
            add(f"{label}-licensed{i}", label, rf"\b(?:released|licen[sc]ed|distributed|available|published) under (?:the (?:terms of the )?)?{n}", _keyword(n), 70, 0.9)
            add(f"{label}-name{i}", label, rf"\b{n}\b", _keyword(n), 50, 0.6)
    for label, prose, part in COMMONS:
        for v in COMMONS_VERSIONS:
            n = re.escape(v)
            add(f"{label}-{v}-spdx", f"{label}-{v}", rf"spdx-license-identifier: ?cc-{part}-{n}", "spdx", 100, 1.0)
            add(f"{label}-{v}-url", f"{label}-{v}", rf"https?://(?:www\.)?creativecommons\.org/licenses/{part}/{n}", "http", 90, 1.0)
            add(f"{label}-{v}-name", f"{label}-{v}", rf"\bcreative commons {prose}(?: licen[sc]e)?,? ?(?:version )?{n}", "creative", 80, 0.9)
            add(f"{label}-{v}-short", f"{label}-{v}", rf"\bcc[ -]{part}[ -]{n}", "cc", 80, 0.9)
        add(f"{label}-name", label, rf"\bcreative commons {prose}\b", "creative", 60, 0.7)
        add(f"{label}-short", label, rf"\bcc[ -]{part}\b(?!-)", "cc", 50, 0.6)
    for i, (label, pattern, keyword, relevance) in enumerate(CLAUSES):
        add(f"clause{i}-{label}", label, pattern, keyword, 40 if relevance < 0.5 else 85, relevance)
    return tuple(sorted(out, key=lambda s: -s.priority))


def spread(pattern: str) -> str:
    """The pattern with GAP for every blank (an optional one for a blank and "?")."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == " ":
            c = r"\s" if inside else f"(?:{GAP})" if pattern[i + 1 : i + 2] == "?" else GAP
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def _keyword(pattern: str) -> str:
    """The longest literal word of a pattern."""
    plain = re.sub(r"\(\?:[^)]*\)|\[[^]]*\].?|\\.", " ", pattern)
    found = re.findall(r"[a-z]{3,}|[a-z0-9]{3,}", plain)
    literal = [w for w in found if w in pattern and not re.search(rf"{w}\[", pattern)]
    return max(literal, key=len)


@cache
def _compiled() -> tuple[list[tuple[Signature, re.Pattern]], dict[bytes, list[int]]]:
    rules = [(s, re.compile(spread(s.pattern), re.S)) for s in signatures()]
    gates: dict[bytes, list[int]] = {}
    for i, (s, _) in enumerate(rules):
        for word in s.keyword.split("|"):
            gates.setdefault(word.encode(), []).append(i)
    return rules, gates


class Outermost:
    """Intervals none of which lies inside another; both ends ascend."""

    def __init__(self):
        self.starts, self.stops = [], []

    def add(self, a: int, b: int) -> bool:
        """Whether a..b lies inside none so far; then it is added, and those inside it go."""
        i = bisect_right(self.starts, a)
        if i and self.stops[i - 1] >= b:
            return False
        lo, hi = bisect_left(self.starts, a), bisect_right(self.stops, b)
        if hi < lo:
            hi = lo
        self.starts[lo:hi], self.stops[lo:hi] = [a], [b]
        return True


def detect(text: str, candidates: list[int] | None = None) -> list[tuple[int, int, str, str, float]]:
    """Accepted detections (start, end, rule, label, relevance) of a lower-cased text, by start."""
    rules, gates = _compiled()
    if candidates is None:
        candidates = sorted({i for k, ix in gates.items() if k.decode() in text for i in ix})
    found = [(m.start(), m.end(), s, i) for i in candidates for s, p in [rules[i]] for m in p.finditer(text)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[3], d[0]))
    spans = Outermost()
    return sorted((a, b, s.name, s.label, s.relevance) for a, b, s, _ in found if spans.add(a, b))


def _gated(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[int]]:
    """By text, the rules whose keyword it holds."""
    rules, gates = _compiled()
    blob, out = data.tobytes(), {}
    for key, ix in gates.items():
        at, docs = blob.find(key), set()
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            docs.add(d)
            at = blob.find(key, int(offsets[d + 1])) if at + len(key) <= offsets[d + 1] else blob.find(key, at + 1)
        for d in docs:
            out.setdefault(d, []).extend(ix)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, places array<struct<word, label>> of the base phrases, detections
    array<struct<start, stop, rule, label, relevance>> (characters of the text)."""
    phrases = [([p.encode() for p in phrase.split()], label) for phrase, label in BASE]
    probe, o = raw(pa.array([x.decode() for p, _ in phrases for x in p]))
    keys = words(probe, o, ALNUM).hashes()

    def run(batch: pa.RecordBatch):
        data, off = raw(batch.column(1))
        data = LOWER[data]
        w = words(data, off, ALNUM)
        h, places, k = w.hashes(), {}, 0
        for phrase, label in phrases:
            n, at = len(phrase), np.flatnonzero(h == keys[k])
            for j in range(1, n):
                at = at[at + j < len(h)]
                at = at[h[at + j] == keys[k + j]]
            k += n
            for p in at.tolist():
                d = int(np.searchsorted(w.first, p, "right")) - 1
                if p + n <= w.first[d + 1] and all(w.text(p + j) == x for j, x in enumerate(phrase)):
                    places.setdefault(d, []).append({"word": int(p - w.first[d]), "label": label})
        found = {}
        for d, rules in _gated(data, off).items():
            text = data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
            found[d] = [dict(zip(("start", "stop", "rule", "label", "relevance"), x, strict=True)) for x in detect(text, sorted(set(rules)))]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(w.counts, pa.int64()),
                pa.array([sorted(places.get(d, []), key=lambda x: (x["word"], x["label"])) for d in range(n)], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                pa.array([found.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("rule", pa.string()), ("label", pa.string()), ("relevance", pa.float64())]))),
            ],
            names=["id", "n_words", "places", "detections"],
        )

    return map_slices(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", run,
        f"id {dict(docs.dtypes)[id_col]}, n_words long, places array<struct<word:long,label:string>>, detections array<struct<start:long,stop:long,rule:string,label:string,relevance:double>>",
    ).withColumnRenamed("id", id_col)
