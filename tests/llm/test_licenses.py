import random

import pytest

from lockfleet.llm import licenses as lic

SCHEMA = "family string, doc_id long, text string, paragraph int"
NOISE = ["the river runs by the old mill and on to the sea", "it was said that no one came", "mit der Zeit und mit dem Rad", "de la casa en el campo", "numbers 2 0 and version 3 of a song"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    words = sorted({w for x in NOISE for w in lic.words(x)})
    return lic.train([*NOISE, *(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(300))])


def test_keys_leave_nothing_out():
    chosen = set(lic.keys(0.5, NOISE))
    for _, text in lic.TEMPLATES:
        own = lic.bigrams(text)
        assert len(own - chosen) < 0.5 * len(own)  # half a template can't be held without one


def test_held_out_wordings(model):
    rng = random.Random(9)
    right = total = 0
    for family, text in lic.TEMPLATES:
        for _ in range(10):
            p = model.probabilities(f"{rng.choice(NOISE)} {text} Copyright {rng.randrange(1990, 2030)} Some Name")
            right += model.classes[p.argmax()] == family
            total += 1
    assert right / total > 0.95
    for text in ["Her driving licence was renewed in May.", "There is no warranty on used cars", *NOISE]:
        p = model.probabilities(text)
        assert model.classes[p.argmax()] == lic.UNKNOWN or p.max() < model.threshold


MIT = "Released under the MIT License."
WRAPPED = """# This program is free software: you can redistribute it and/or
# modify it under the terms of the GNU General Public License as
# published by the Free Software Foundation, either version 3 of
# the License, or (at your option) any later version."""


def test_scan(spark, model):
    long = next(t for f, t in lic.TEMPLATES if f == "mit" and len(t) > 300)
    texts = ["a\n" + MIT + "\nb", None, "", MIT, NOISE[2], "Licensed under CC BY-NC 4.0.\n" + "x " * 20000 + "\nAll rights reserved.", "a driving license\nlicense"]
    texts += ["This work is licensed under the GNU General Public License, version 3.", MIT, f"Title\n\n \t\n{WRAPPED}\n\nother words", "\n".join(long[i : i + 60] for i in range(0, len(long), 60)), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1: this library is licensed under the GNU Lesser General Public License, version 2.1."]
    rows = [("f", i, t, 7) for i, t in enumerate(texts)] + [("f", None, MIT, 7), ("f", 3, MIT, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = lic.scanned(docs, model=model)
    got = found.collect()
    named = sorted(((r.doc_id, r.paragraph, r.line, r.family) for r in got if r.family != lic.UNKNOWN), key=str)
    want = [(0, 0, 1, "mit"), (3, 0, 0, "mit"), (3, 0, 0, "mit"), (5, 0, 0, "cc-by-nc-4.0"), (5, 0, 2, "proprietary"), (7, 0, 0, "gpl-3.0"), (8, 0, 0, "mit"), (None, 0, 0, "mit"), (9, 1, None, "gpl-3.0"), (11, 0, 0, "lgpl-2.1")]
    assert [x for x in named if x[0] != 10] == sorted(want, key=str)
    assert {x[3] for x in named if x[0] == 10} == {"mit"}

    def expected():
        """All paragraphs and lines, by plain Python: what holds half of a template, and what the model says of it."""
        import re

        out = []
        for _, i, t, _ in rows:
            for k, block in enumerate(re.split(r"\n[ \t\r\x0b\f]*\n", t) if t is not None else []):
                lines = block.split("\n")
                own = [(None, block)] * (len(lines) > 1) + list(enumerate(lines))
                said = []
                for n, x in own:
                    held = {}
                    for f, text in lic.TEMPLATES:
                        held[f] = max(held.get(f, 0.0), len(lic.bigrams(text) & lic.bigrams(x)) / len(lic.bigrams(text)))
                    if max(held.values()) < 0.5:
                        continue
                    p = model.probabilities(x)
                    name = model.classes[p.argmax()]
                    sure = p.max() >= model.threshold and held.get(name, 0.0) >= 0.5
                    said.append((i, k, n, name if sure else lic.UNKNOWN, name, round(p.max(), 6), round(held.get(name, 0.0), 6)))
                by_line = any(x[2] is not None and x[3] != lic.UNKNOWN for x in said)
                out += [x for x in said if x[2] is not None or not by_line]
        return sorted(out, key=str)

    assert sorted(((r.doc_id, r.paragraph, r.line, r.family, r.predicted, round(r.probability, 6), round(r.coverage, 6)) for r in got), key=str) == expected()
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lic.scanned(docs.limit(0), model=model).count() == 0
