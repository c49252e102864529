"""Licence scans against plain searches and a recursive evaluation."""

import itertools
import random
import re

from weft.llm.licenses import BASE, NOTICES, evaluate, grant_of, label_of, labelled, licences, postfix

SCHEMA = "doc_id long, text string, id string, n_words int, notices string, score string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in texts], SCHEMA)


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    words = plain_words(text)
    return [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = "under the mit license apache version 2 0 cc by nc gnu general public 3 été MIT License, Under\nThe x\t- spdx SPDX-License-Identifier: or and with ( ) Apache-2.0 all rights reserved".split(" ")
    return [" ".join(rng.choice(pool) + rng.choice(["", "", ",", "\n", "."]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_licences(spark):
    """Base places, words and labels of every text, odd ones included."""
    texts = list(enumerate(random_texts(300, 2)))
    texts += [(900, None), (901, ""), (902, " \n-"), (903, "CC-BY-NC cc by nc"), (903, "CC-BY-NC cc by nc"), (None, "under the MIT license"), (904, "x " * 300000 + "Under the mit LICENSE"), (905, "cc" * 200000), (906, "cc by nc by nc cc by")]
    got = sorted((str(r) for r in labelled(licences(table(spark, texts))).drop("labels", "score").collect()))
    want = []
    for i, t in texts:
        base = plain_base(t)
        at = [p for p, _ in base]
        want.append((i, len(plain_words(t)), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base}))))
    frame = spark.createDataFrame(want, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    assert got == sorted(str(r) for r in frame.collect())
    assert licences(table(spark, [])).count() == 0


def test_labels_and_scores(spark):
    cases = {
        "Released under the MIT License.": ("mit", 1.0),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", 1.0),
        "Licensed under CC BY-NC 4.0.": ("cc-by-nc", 0.2),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl-3", 0.5),
        "# SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) AND Apache-2.0\ncode": ("apache-2,gpl-3,mit", 1.0),
        "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ("gpl-2", 0.5),
        "SPDX-License-Identifier: MIT OR\nApache-2.0": ("mit", 1.0),
        '"license": "CC-BY-SA-4.0"': ("cc-by-sa", 0.6),
        "licensed under MIT or Apache-2.0, at your option. All rights reserved": ("apache-2,mit,proprietary", 0.0),
        "licensed under nothing known": ("", 0.0),
        "SPDX-License-Identifier: " + "(" * 5000 + "MIT" + ")" * 5000 + " or ISC": ("isc,mit", 1.0),
        "licensed under the Apache way": ("", 0.0),
        "no licence here": ("", 0.0),
        "license: MIT and license: MPL-2.0": ("mit,mpl-2", 0.7),
    }
    got = {r.doc_id: (r.labels, r.score) for r in labelled(licences(table(spark, list(enumerate(cases))))).collect()}
    assert got == dict(enumerate(cases.values()))


def grown(rng, depth):
    """A random expression's text and its (labels, grant), by recursion."""
    if not depth or rng.random() < 0.3:
        name = rng.choice(["MIT", "Apache-2.0", "GPL-3.0-or-later", "CC-BY-NC-4.0", "mpl-2.0", "AGPL-3.0-only"])
        label = label_of(name)
        if rng.random() < 0.2:
            return f"{name} WITH Some-exception-1.0", ({label}, grant_of(label)), 3
        return name, ({label}, grant_of(label)), 4
    op = rng.choice(["and", "OR"])
    level = 2 if op == "and" else 1
    sides = [grown(rng, depth - 1) for _ in range(2)]
    left, right = (t if own > level or (own == level and k == 0) else f"({t})" for k, (t, _, own) in enumerate(sides))
    (a, x), (b, y) = (s[1] for s in sides)
    text = f"{left} {op} {right}"
    return text, (a | b, min(x, y) if op == "and" else max(x, y)), level


def test_shunting_yard():
    for seed in range(2000):
        text, want, _ = grown(random.Random(seed), 4)
        tokens, end = postfix(text + " the rest")
        assert end == len(text) and evaluate(tokens) == want


def test_broken_expressions_end_early():
    """Every short run of tokens gives an expression that evaluates, or none."""
    for n in range(1, 6):
        for parts in itertools.product(["MIT", "gpl-3.0", "and", "with", "(", ")", "word"], repeat=n):
            text = " ".join(parts)
            tokens, end = postfix(text)
            assert not tokens and not end or evaluate(tokens)[0] and end <= len(text)


def test_every_notice_is_found(spark):
    texts = list(enumerate(f"Filler {phrase.upper()} words" for phrase in NOTICES))
    got = {r.doc_id: r.labels.split(",") for r in labelled(licences(table(spark, texts))).collect()}
    assert all(label in got[i] for i, label in enumerate(NOTICES.values()))
