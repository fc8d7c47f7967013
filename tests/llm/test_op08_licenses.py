import re

from siftwood.llm import licenses
from siftwood.llm.queries import op8_license_scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORDS.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        hits = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_against_brute_force(spark, documents):
    docs = {
        1: "CC-BY cc by, CC  BY\ncc by ccby",
        2: "the GNU General Public License, version 3; general public. LICENSE",
        3: "All rights reserved. all all rights reserved rights",
        4: "général public license 漢字 cc by 漢",
        5: None,
        6: "by cc by cc by",
    }
    for r in licenses.scan_licenses(documents(docs)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])


def test_templates_need_place_weight_and_key(spark, documents):
    docs = {
        1: "x y. Licensed under the Apache License, Version 2.0 (the License)",
        2: "apache version license licensed 2 0 in another order, no notice",
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation",
        4: "Released under the MIT License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        5: "licensed under the apache of version two",
        6: "nothing here",
    }
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(docs)).collect()}
    assert {k: v.labels for k, v in found.items()} == {1: "apache-2.0", 2: "", 3: "mit", 4: "bsd,mit", 5: "", 6: ""}
    assert found[1].placements[0].start == 2 and found[1].score == 1.0 and 0.6 <= found[3].score < 1.0 and found[6].score == 0.0


def test_every_template_finds_itself(spark, documents):
    docs = {n: f"before it {t.text} after it" for n, t in enumerate(licenses.TEMPLATES)}
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(docs)).collect()}
    for n, t in enumerate(licenses.TEMPLATES):
        assert t.label in found[n].labels.split(",") and (t.label, 2) in {(p.label, p.start) for p in found[n].placements}


def test_files_with_many_notices_lose_none(spark, documents):
    mit, bsd = (next(t.text for t in licenses.TEMPLATES if t.label == x and len(t.text) > 60) for x in ("mit", "bsd"))
    apache = licenses.TEMPLATES[0].text
    docs = {n: f"notice {apache}" for n in range(40)}  # common, so that its words have the lowest IDF
    docs |= {100: f"{mit}. {bsd}. {apache}.", 101: ". ".join(t.text for t in licenses.TEMPLATES)}
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(docs)).collect()}
    assert found[100].labels == "apache-2.0,bsd,mit"
    assert {t.label for t in licenses.TEMPLATES} <= set(found[101].labels.split(","))


def test_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op8_license_scan(spark, small)
    for r in found.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_against_a_brute_force_of_placements(spark, documents):
    """Random mixes of whole, cut and damaged notices; every template laid at every place."""
    import random
    from math import log

    rng = random.Random(12)
    texts = {}
    for n in range(80):
        words = []
        for t in rng.sample(licenses.TEMPLATES, rng.randint(0, 6)):
            own = t.text.split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "zzz"
            if rng.random() < 0.3:
                own = own[rng.randint(1, 3) :]
            words += own + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 5))]
        texts[n] = " ".join(words)
    rules = licenses.LicenseRules()
    vocabulary = {w for t in rules.templates for w in t.text.split()} - licenses.FUNCTION_WORDS
    split = {n: t.split() for n, t in texts.items()}
    idf = {w: log((len(split) + 1) / (sum(w in ws for ws in split.values()) + 1)) + 1 for w in vocabulary}
    wanted = {}
    for n, words in split.items():
        labels = {label for p, label in licenses.BASE_PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        for t in rules.templates:
            own, key = t.text.split(), t.key.split()
            at = licenses._key_place(t)
            whole = sum(idf[w] for w in own if w in idf)
            for start in range(-len(own), len(words)):
                share = sum(idf[w] for k, w in enumerate(own) if w in idf and 0 <= start + k < len(words) and words[start + k] == w) / whole
                if share >= rules.min_share and start + at >= 0 and words[start + at : start + at + len(key)] == key:
                    labels.add(t.label)
        wanted[n] = ",".join(sorted(labels))
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(documents(texts)).collect()}
    assert found == wanted
