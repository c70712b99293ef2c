import random
import re

from locusforge.llm.license_scan import BASE_PHRASES, Detection, Scanner, scan_licenses, standard_rules, suppress


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(2)
    pool = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved.", "é", "x", "gnu", "4.0", "sa", "\x00", "mit"]
    out = [None, "", "!!", "All rights\treserved", "CC BY CC BY", "cc\x7fby", "ccé by", "GENERAL, PUBLIC; LICENSE " * 20_000]
    return out + [" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(300)]


def test_base_matches_brute_force_and_labels_stay(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(rows)] + [(None, "cc by", "q", 1)], "doc_id long, text string, labels string, score int")
    got = scan_licenses(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[r.doc_id] if r.doc_id is not None else "cc by"
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels) and 0 <= r.score <= 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_rules():
    assert len(standard_rules()) > 300
    scanner = Scanner()
    label = lambda t: scanner.scan(t)["labels"]
    assert label("Licensed under the Apache License, Version 2.0 (the") == "apache-2.0"
    assert label("SPDX-License-Identifier: CC-BY-SA-4.0") == "cc-by,cc-by-sa-4.0"
    assert label("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert "mit" in label("Permission is hereby granted, free of charge, to any person obtaining a copy of")
    assert label("nothing to see") == "" and scanner.scan("nothing")["score"] == 0
    assert scanner.scan("released under the MIT license")["score"] > 0.9


def test_keyword_gate_loses_nothing():
    """Every rule's keywords must occur in whatever it matches: the gated scan equals one without a gate."""
    scanner = Scanner()
    samples = ["gnu gpl version 3", "licensed under the mozilla public license 2 0", "same terms as perl itself", "ms pl", "psf license", "no rights reserved", "copyright c 2020", "expat licence", "creative commons zero"]
    for text in samples:
        words = scanner.words(text)
        every = [Detection(r.label, m.start(), m.end(), r.priority, r.confidence) for r, p in zip(scanner.rules, scanner._compiled) for m in p.finditer(b" ".join(words))]
        gated = scanner.detections(words)
        assert gated and {d.label for d in suppress(every)} == {d.label for d in gated}


def sample(parsed, rng):
    """A text that a parsed pattern matches, look-arounds aside."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], 4))))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else "7"
        elif name == "ANY":
            out += "q"
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_keyword_gate_loses_no_rule_and_no_version():
    """Texts generated from every rule, joined forms among them, give what a scan without a gate gives."""
    scanner, rng = Scanner(), random.Random(7)
    for rule, pattern in zip(scanner.rules, scanner._compiled):
        parsed = re._parser.parse(rule.pattern)
        for _ in range(12):
            words = scanner.words(sample(parsed, rng))
            joined = b" ".join(words)
            if not pattern.search(joined):
                continue
            every = [Detection(r.label, m.start(), m.end(), r.priority, r.confidence) for r, p in zip(scanner.rules, scanner._compiled) for m in p.finditer(joined)]
            assert scanner.detections(words) == suppress(every), joined


def test_joined_names_and_versions():
    for text, label in {"GPLv3": "gpl-3", "GPLv2": "gpl-2", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3", "MPL2": "mpl-2", "WTFPLv2": "wtfpl-2", "under GNU GPLv3.": "gpl-3", "CC01": "cc0-1", "gplv": "gpl"}.items():
        assert Scanner().scan(text)["labels"] == label


def test_identifiers():
    scanner = Scanner()
    for text, label in {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later", "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "the Apache-2.0 license": "apache-2.0", "under an EPL-2.0 License": "epl-2.0", "LGPLv2.1": "lgpl-2.1", "SPDX-License-Identifier: MIT-0": "mit-0", "SPDX-License-Identifier: 0BSD": "0bsd",
        "used for Good, not Evil. The Software shall be used for Good, not Evil.": "json", "(Dual) licensed under nothing": "dual", "No part of this publication may be reproduced": "proprietary",
    }.items():
        assert scanner.scan(text)["labels"] == label, text


def test_rules_are_ordered_and_apart():
    rules = standard_rules()
    assert len({(r.label, r.pattern) for r in rules}) == len(rules) and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_suppression_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        found = [Detection(f"l{i}", s, s + rng.randint(1, 6), rng.randint(1, 3), 0.5) for i in range(rng.randint(0, 7)) for s in [rng.randint(0, 8)]]
        kept = suppress(found)
        for d in found:
            inside = any(k is not d and k.start <= d.start and k.end >= d.end and k.priority >= d.priority for k in kept)
            assert (d in kept) != inside or (d in kept and not inside)
