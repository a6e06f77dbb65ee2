"""License signatures: every rule against its gates, labels against brute force, and long texts."""

import random
import re
import time
from re import _constants as kinds
from re import _parser as parser

from lumenfold.llm import license_scan as ls


def example(parsed, rng):
    """A string that the parsed expression matches, of blanks and words only."""
    out = ""
    for kind, value in parsed:
        if kind is kinds.LITERAL:
            out += chr(value)
        elif kind is kinds.NOT_LITERAL or kind is kinds.ANY:
            out += rng.choice("xyz")
        elif kind is kinds.IN:
            ranges = [v for k, v in value if k is kinds.RANGE] + [(v, v) for k, v in value if k is kinds.LITERAL]
            if value[0][0] is kinds.NEGATE or not ranges:
                out += rng.choice("xyz")
            else:
                out += chr(rng.randint(*rng.choice(ranges)))
        elif kind is kinds.SUBPATTERN:
            out += example(value[3], rng)
        elif kind is kinds.BRANCH:
            out += example(rng.choice(value[1]), rng)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(least, min(most, least + 3))))
        else:
            assert kind in (kinds.ASSERT, kinds.AT), kind
    return out


def test_no_gate_hides_a_match():
    rng, made = random.Random(1), ls._ready()[0]
    assert len(made) > 500
    for rule in made:
        tried = 0
        for _ in range(60):
            words = example(parser.parse(rule.pattern.pattern.decode()), rng).split()
            line = b" " + " ".join(words).encode() + b" "
            if rule.pattern.search(line):
                tried += 1
                assert any(g <= set(line.split()) for g in rule.gates), (rule.label, line)
        assert tried > 10, rule.pattern


def brute(words):
    """All rules without gates, then suppression by its definition."""
    line, found = b" " + b" ".join(words) + b" ", set()
    for rule in ls.rules():
        for m in rule.pattern.finditer(line):
            first = line[: m.start()].count(b" ") - 1
            found.add((first, first + m.group().count(b" ") + 1, rule.priority, rule.label, rule.sure))
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], -len(b" ".join(words[d[0] : d[1]])), d[0], d[3])):
        inside = any(k[0] <= d[0] and d[1] <= k[1] for k in kept)
        around = any(d[0] <= k[0] and k[1] <= d[1] and d[2] < k[2] for k in kept)
        if not inside and not around:
            kept.append(d)
    return sorted(kept)


def test_labels_match_brute_force(spark):
    rng, rules = random.Random(2), ls.rules()
    patterns = [parser.parse(r.pattern.pattern.decode()) for r in rules]
    texts = []
    for k in range(60):
        parts = [example(rng.choice(patterns), rng).strip() for _ in range(rng.randint(0, 12))] + ["plain words", "license", "the mit license"]
        rng.shuffle(parts)
        texts.append((k, rng.choice([", ", " and ", " "]).join(parts).title()))
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, text in texts:
        kept = brute(ls.normalized(text))
        assert [(d.first, d.end, d.priority, d.label) for d in got[k].detections] == [d[:4] for d in kept]
        base = {label for phrase, label in ls.BASE.items() if f" {phrase.decode()} " in f" {re.sub('[^a-z0-9]+', ' ', text.lower())} "}
        assert got[k].labels == ",".join(sorted(base | {d[3] for d in kept})) and got[k].base_labels == ",".join(sorted(base))
        missed = 0.1 if base else 1.0
        for d in kept:
            missed *= 1 - d[4]
        assert abs(got[k].score - (1 - missed)) < 1e-9


def test_long_texts_of_detections():
    for phrase in ("licensed under the mit license ", "all rights reserved gpl v2 spdx license identifier mit "):
        words, began = ls.normalized(phrase * (100_000 // len(phrase.split()))), time.time()
        _, kept = ls.scan_words(words)
        assert len(kept) >= 20_000 and time.time() - began < 10  # about a second; a quadratic scan takes over a minute
