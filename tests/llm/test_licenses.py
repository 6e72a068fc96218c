import random
import re

import pytest

from millrace.llm import licenses as lic
from tests.llm.data import clashing, corpus, frame

TEXTS = [
    None,
    "",
    "mit",
    "MIT License mit license\nMIT  license. Apache-License, Version 2.0",
    "SPDX-License-Identifier: GPL-3.0-only OR MIT",
    "This is under the GNU Lesser General Public License version 2.1, see it",
    "Licensed under CC BY-NC 4.0.",
    "limit license; mit licenses, xmit license",
    "ſ mit_license é general\x00public license K",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "all rights reserved. Licensed under the Apache License, Version 2.0.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit license " * 300,
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in lic.BASE:
        own = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(own)] == own:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in corpus(3, 20)]
    out = {r.doc_id: r for r in lic.scan(clashing(frame(spark, rows))).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert lic.scan(frame(spark, [])).count() == 0


def test_labels_and_suppression(spark):
    out = {r.doc_id: r for r in lic.scan(frame(spark, list(enumerate(TEXTS)))).collect()}
    labels = {i: r.labels for i, r in out.items()}
    assert labels[2] == "" and labels[3] == "apache,apache-2.0,mit" and labels[4] == "gpl-3.0-only" and labels[5] == "gpl,lgpl-2.1"
    assert labels[6] == "cc-by-nc-4.0" and labels[9] == "mit" and labels[10] == "apache,apache-2.0,proprietary" and labels[11] == "bsd"
    assert [(d.a, d.b, d.label) for d in out[5].detections] == [(4, 12, "lgpl-2.1")]
    assert out[4].score == 1 and out[0].score == 0


def test_rules_are_sound():
    assert len(lic.RULES) > 250 and [r.priority for r in lic.RULES] == sorted(r.priority for r in lic.RULES)
    for r in lic.RULES:
        re.compile(r.pattern)
        assert r.keyword in lic._certain(r.pattern) and 0 < r.weight <= 1


@pytest.mark.parametrize("rule", lic.RULES[::9], ids=lambda r: r.pattern[:30])
def test_each_rule_passes_its_gate(spark, rule):
    """A text made from the pattern with its optional parts left out opens the gate."""
    text = re.sub(r"\(\?:[^()]*\)\?", "", rule.pattern)
    text = re.sub(r"\(\?:([^|()]*)\|[^()]*\)(\{[^}]*\})?", r"\1", text).replace("licen[sc]e", "license").replace("ed?", "ed").replace("v?", "v").replace(" ?", " ").replace(r"\S+ ", "x ")
    text = re.sub(r"\[1-3\]", "1", text).replace("(?:x ){1,8}", "x ")
    if "(" in text or "?" in text:
        pytest.skip("not spelled out")
    row = lic.scan(frame(spark, [(1, text.upper())])).first()
    assert row.labels, text


def by_rules(text):
    """Labels and score by trying each rule, without gates and keywords."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    form = " " + "".join(w + " " for w in words)
    found = []
    for r in lic.RULES:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", form):
            first = form[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" ") + 1, r.priority, r.label, r.weight))

    def beaten(d):
        return any(e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2] or (e[2] == d[2] and e[3] < d[3])) for e in found)

    kept = [d for d in found if not beaten(d)]
    base = set(filter(None, brute(text)[4].split(",")))
    doubt = 0.4 if base else 1.0
    for d in kept:
        doubt *= 1 - d[4]
    return ",".join(sorted(base | {d[3] for d in kept})), 1 - doubt


def test_labels_and_score_equal_all_rules_tried(spark):
    rng = random.Random(6)
    spelled = []
    for r in lic.RULES:
        text = re.sub(r"\(\?:([^|()]*)\|?[^()]*\)(\{[^}]*\}|\?)?", lambda m: rng.choice([m[1], ""]), r.pattern).replace("licen[sc]e", rng.choice(["license", "licence"]))
        spelled.append(re.sub(r"\[[^]]*\]|\\S\+|\?|\{[^}]*\}", "1", text))
    texts = list(TEXTS) + spelled
    for _ in range(150):
        parts = [rng.choice(spelled + ["the", "code is", "mit license", "é", "GPL", "apache license"]) for _ in range(rng.randrange(1, 7))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).replace("the", rng.choice(["the", "THE"])))
    out = {r.doc_id: r for r in lic.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        labels, score = by_rules(t)
        assert out[i].labels == labels and abs(out[i].score - score) < 1e-9, t


def test_very_long_texts_repeated_rows_and_null_ids(spark):
    long = "apache license, version 2.0 é general public license\nmit license spdx-license-identifier: gpl-2.0-only " * 20_000
    rows = [(1, long), (1, long), (None, TEXTS[3]), (None, TEXTS[3]), (2, "x" * 300_000 + " mit license"), (None, None)]
    out = lic.scan(frame(spark, rows)).drop("detections").collect()
    assert len(out) == len(rows)
    for i, t in rows:
        own = [r for r in out if r.doc_id == i and r.n_words == brute(t)[0]]
        assert own and all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t) for r in own)
    assert {r.labels for r in out if r.doc_id == 1} == {"apache,apache-2.0,gpl,gpl-2.0-only,mit"}
