"""License detection by ordered signature rules (``license_rules``).

Texts are lower-cased and cut into runs of letters, digits and non-ASCII
characters; rules are regular expressions over those words joined by blanks. A
rule is tried only where all its keywords are among a text's words. Of the
detections of one text, one that lies within another of higher priority (or of
the same priority, if longer), or around one of higher priority, is suppressed. Three base phrases are always
reported, whatever rules suppress.

Defined cases: a null text is empty and has no word, no label and score 0; a null
doc_id is kept; repeated rows are scanned each; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of
from .license_rules import NAMES, WORDINGS

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))

BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Priorities by the kind of rule, and how sure a detection of the kind is.
KINDS = {"wording": (90, 0.95), "address": (85, 0.95), "spdx": (80, 0.9), "grant": (70, 0.9), "name": (60, 0.8), "identifier": (50, 0.6), "loose": (10, 0.3)}


class Rule:
    def __init__(self, label: str, kind: str, pattern: str, gates: list[set[bytes]]):
        self.label, (self.priority, self.sure) = label, KINDS[kind]
        self.pattern = re.compile(rb"(?<= )" + pattern.encode() + rb"(?= )")
        self.gates = gates


def rules() -> list[Rule]:
    """Names give four rules each (name, grant, SPDX tag, identifier); wordings give one."""
    out = []
    gates = lambda text, *more: [set(x.encode().split()) | set(more) for x in text.split(",")]
    for line in NAMES.splitlines():
        label, name, keys, tag = (x.strip() for x in line.split(" | "))
        required = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:[^()]*\)\?", "", name))  # without what may be absent
        words = [b"unlicense"] if label == "unlicense" else [b"license", b"licence"] if "licen[sc]e" in required else []
        every = [g | {w} for g in gates(keys) for w in words] or gates(keys)
        granted = [g | {v} for g in gates(keys) for v in (b"licensed", b"distributed", b"released", b"available")]
        first = {re.split(r"[ (\[]", tag)[0].encode()}
        out += [
            Rule(label, "name", name, every),
            Rule(label, "grant", rf"(?:licensed|distributed|released|available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", granted),
            Rule(label, "spdx", rf"spdx license identifier {tag}", [first | {b"spdx", b"identifier"}]),
            Rule(label, "identifier", rf"(?:license|licence|licensed under|licensed under the) {tag}", [first | {w} for w in (b"license", b"licence", b"licensed")]),
        ]
    for line in WORDINGS.splitlines():
        label, pattern, keys = (x.strip() for x in line.split(" | "))
        kind = "loose" if label.endswith("unspecified") or label in ("proprietary", "creative-commons") else "address" if " org " in f"{pattern} " else "wording"
        out.append(Rule(label, kind, pattern, gates(keys)))
    return out


_READY: list = []


def _ready() -> tuple[list[Rule], set[bytes], dict[bytes, list[int]]]:
    """The rules, all keywords, and the rules that each keyword may open; made once a worker."""
    if not _READY:
        made, opens = rules(), {}
        for k, rule in enumerate(made):
            for gate in rule.gates:
                opens.setdefault(max(gate, key=len), set()).add(k)  # its longest keyword opens a gate
        keywords = {w for rule in made for g in rule.gates for w in g} | {w for p in BASE for w in p.split()}
        _READY.extend((made, keywords, {w: sorted(v) for w, v in opens.items()}))
    return tuple(_READY)


def normalized(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, sureness) that no kept one of higher rank contains or lies in.

    Kept detections never contain each other, so by start they are in order of their ends, too, and
    one look on either side decides.
    """
    kept, starts = [], []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        at = bisect_right(starts, d[0])
        within = at and kept[at - 1][1] >= d[1]
        at = bisect_left(starts, d[0])
        if not within and not (at < len(kept) and kept[at][1] <= d[1]):
            starts.insert(at, d[0])
            kept.insert(at, d)
    return kept


def scan_words(words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, str, float]]]:
    """Base places (word, label) and kept detections, whose starts and ends are words."""
    made, keywords, opens = _ready()
    if keywords.isdisjoint(words):
        return [], []
    present = keywords.intersection(words)
    line = b" " + b" ".join(words) + b" "
    base = [(m.start(), label) for phrase, label in BASE.items() if present.issuperset(phrase.split()) for m in re.finditer(rb"(?<= )" + phrase + rb"(?= )", line)]
    found = []
    for k in sorted({k for w in present if w in opens for k in opens[w]}):
        rule = made[k]
        if any(g <= present for g in rule.gates):
            found += [(m.start(), m.end(), rule.priority, rule.label, rule.sure) for m in rule.pattern.finditer(line)]
    if not base and not found:
        return [], []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word = lambda places: (np.searchsorted(blanks, np.array(places, np.int64)) - 1).tolist()
    kept = suppress(found)
    spans = zip(kept, word([d[0] for d in kept]), word([d[1] for d in kept]))
    return sorted(zip(word([p for p, _ in base]), (label for _, label in base))), [(a, b + 1, *d[2:]) for d, a, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": spans}
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part, cols = batch.slice(k, 2048), {c: [] for c in kinds}
            for text in part["text"]:
                words = normalized(text.as_py())
                base, kept = scan_words(words)
                plain, missed = {label for _, label in base}, 0.1 if base else 1.0
                for d in kept:
                    missed *= 1 - d[4]
                row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(plain)), ",".join(sorted(plain | {d[3] for d in kept})), 1 - missed, [{"label": d[3], "first": d[0], "end": d[1], "priority": d[2]} for d in kept])
                for c, v in zip(cols.values(), row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(cols[c], t) for c, t in kinds.items())], names=["doc_id", *kinds])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts and places of base phrases, labels, score, and the kept detections with their words."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string, first:long, end:long, priority:long>>"
    return text_of(docs).mapInArrow(_scan, schema)
