import random
import re
import string

from helpers import SCHEMA, odd_documents, prose
from priorfield.llm import licenses as lic

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(text, templates, threshold):
    w = words(text)
    places, base = [], set()
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    half = max(len(words(t)) for _, t in templates)
    labels, best = set(base), 0.0
    for b in range(0, max(1, len(w)), half):
        block = set(w[b:b + 2 * half])
        for label, t in templates:
            s = set(words(t))
            share = len(s & block) / len(s)
            if len(s & block) >= max(1, -(-(threshold * len(s) - 1e-9) // 1)):
                labels.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best)


def check(spark, texts, templates=lic.TEMPLATES, threshold=lic.THRESHOLD):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: tuple(r)[1:] for r in lic.scan_licenses(docs, templates=templates, threshold=threshold).collect()}
    for i, t in enumerate(texts):
        want = plain(t, templates, threshold)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-12, (i, got[i], want)


def test_phrases_and_templates(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "Under the MIT License", "under-the.MIT\nlicense under the mit license, under the mit licenses", "cc by nc cc by nc", "CC BY-NC 4.0 licensed under",
             "Apache License, Version 2.0. Licensed under the", "MIT LicenseK under the mit license", "ünder the mit license", prose(rng, 5000) + " cc by nc " + prose(rng, 300)]
    for label, t in lic.TEMPLATES:
        w = t.split()
        texts += [prose(rng, rng.randrange(60)) + " " + " ".join(w[:cut]) + " " + prose(rng, rng.randrange(2500)) for cut in (len(w), len(w) - 1, len(w) - 3)]
    check(spark, texts)


def test_low_threshold_and_odd_rows(spark):
    check(spark, [r[1] for r in odd_documents()], [("x", "a b c zz"), ("y", "b c"), ("z", "one")], 0.6)
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    assert lic.scan_licenses(docs).count() == docs.count() and lic.scan_licenses(docs.limit(0)).count() == 0
    assert lic.scan_licenses(docs, phrases=[], templates=[]).filter("score > 0").count() == 0
