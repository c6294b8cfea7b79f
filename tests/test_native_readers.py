"""The readers in Catalyst against plain-Python ones, on whole, strange and mangled documents."""

import random

import pytest
from plain_readers import READERS
from pyspark.sql import functions as F
from test_sources import GO, NPM, YARN

from lockfleet.sources import npm
from lockfleet.sources.grammars import Refused
from lockfleet.sources.lockfiles import NATIVE, read

NPM_ODD = (
    '{"lockfileVersion":2.0,"packages":{"":{"dependencies":{"a":"1"},"devDependencies":{"z":1}},"apps/d":{"dependencies":{"x":"1"}},"apps/d/node_modules/x":{},"node_modules/x":{"version":5,"dev":true,"dev":false},'
    '"node_modules/a":{"dependencies":{"x":"1","y":"1"},"hasInstallScript":true,"integrity":null},"node_modules/a/node_modules/x":{"peerDependencies":{"x":"1","a":"1"},"version":"1.0"},"node_modules/l":{"link":true},'
    '"node_modules/@s/é\\u00e9😀":{"version":"\\"q\\\\"},"node_modules/￮":3}}'
)
GO_ODD = "module ex.org/m // c\n\ngo 1.22\r\nrequire (\n\ta.b/c v1.2.3\n\t\"d.e/f\" v0.0.0-2020-abc // indirect\n)\nrequire g.h/i v1.0.0 // indirect; x\nreplace (\n d.e/f v1 => ../local v2\n)\nreplace a.b/c => x.y/z v1.0.0\nretract (\n v1.0.0\n require (\n)\nexclude a.b/c v1.0.0\n"
YARN_ODD = '# yarn lockfile v1\n\n\n"@s/far@^1", far2@^1:\n  version "1.0.0"\n  resolved "https://registry.yarnpkg.com/x"\n  integrity sha512-x\n  dependencies:\n    oop "^2"\n    "@q/r" ">= 1 < 2"\n  optionalDependencies:\n    fs "*"\n  x y\n    z w\n  engines:\n    node "1"\n\n# margin\noop@^2, oop@^2.1:\n  version "2.1.0"\n  resolved "https://elsewhere/x"\n  peerDependencies:\n\tt "1"\n    far2 "^1"\n'
WHOLE = {"npm": [NPM % ("", ""), NPM % (',"x":1', ',"node_modules/b":{}'), NPM_ODD], "gomod": [GO, GO_ODD], "yarn": [YARN, YARN_ODD]}
BITS = {
    "npm": ["", "\0", "\\", '"', "[", "{", "é", "\n", ":", "=", "#", "]", "}", ",", "1", "null", "\\ud800", "\\u0041", " ", "\t", "﻿", "[[", "]]"],
    "gomod": ["", "\0", '"', "`", "(", ")", "\n", "//", " ", "\t", "=>", "require ", "module x\n", "\r", "\\", "replace ", ".", "v1.0.0", " (\n", "\n)\n"],
    "yarn": ["", "\0", '"', ":", "\n", "  ", "    ", "#", "\n# c\n", ",", "@", "dependencies:", "version x\n", "\r", "__metadata:", "\t"],
}
AROUND = '{"lockfileVersion":3,"packages":{}%s}'
STRANGE = [
    "", " ", "\n", "\n\n", "{}", "[]", "null", "# yarn lockfile v1", "module x", "﻿" + AROUND % "", "{} {}", AROUND % "" + ",{}", AROUND % "" + "],[1", AROUND % "" + "]", "[" + AROUND % "", '{"lockfileVersion":"3","packages":{}}', '{"lockfileVersion":true,"packages":{}}',
    '{"lockfileVersion":3,"packages":[]}', '{"lockfileVersion":1}', '{"lockfileVersion":1.5,"packages":{}}', AROUND % ',"x":NaN', AROUND % ',"x":01', AROUND % ',"x":"\t"', AROUND % ',"x":1e400', AROUND % ',"x":"]]]"', AROUND % ',"x":"\\"]"',
    *[AROUND % f',"x":{"[" * n}{"]" * n}' for n in (126, 127, 128, 1200)], *[AROUND % f',"x":"{x}"' for x in ("\\ud83d\\ude00", "\\ude00\\ud83d", "\\\\ud83d", "\\ud83d", "\\ud83d\\u0041")],
]


def plain(form, text):
    try:
        p = READERS[form](text)
    except Refused as e:
        return [], [], e.what, e.line, e.col
    return [(*list(vars(e).values())[:-2], e.aliases, sorted(map(tuple, e.deps), key=str)) for e in p.entries], sorted(p.roots), None, 0, 0


@pytest.mark.parametrize("form", sorted(WHOLE))
def test_equal_to_plain_readers(spark, form):
    rng, texts = random.Random(form), WHOLE[form] + STRANGE
    for _ in range(400):
        text = list(rng.choice(WHOLE[form]))
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 0, 1, 2, 6])] = rng.choice(BITS[form])
        texts.append("".join(text))
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")
    got = {int(r.source): r for r in NATIVE[form](rows).collect()}
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        r, want = got[i], plain(form, text)
        have = [(*tuple(e)[:-2], e.aliases, sorted(map(tuple, e.deps), key=str)) for e in r.entries], sorted(r.wanted), r.what, r.line, r.col
        if r.what == npm.NOT_JSON:
            assert want[2] is not None and not want[2].startswith(("of npm", "lockfileVersion", "`packages`")), text
        else:
            assert have == want, text


def test_refused_json_is_explained(spark):
    texts = {"a/package-lock.json": '{"a":\n  tru}', "b/package-lock.json": AROUND % "" + "]", "c/package-lock.json": AROUND % ',"x":"\\ud83d"', "d/package-lock.json": "{}", "e/package-lock.json": AROUND % ""}
    t = read(spark.createDataFrame(list(texts.items()), "source string, text string"))
    got = {r.source[0]: (r.kind, r.what, r.line, r.col) for r in t.errors.collect()}
    assert got == {"a": ("syntax", "Expecting value", 2, 3), "b": ("syntax", "Extra data", 1, 36), "c": ("usage", "lone surrogate", 0, 0), "d": ("usage", "lockfileVersion is missing, which npm always writes", 0, 0)}
    assert [r.source for r in t.lockfiles.collect()] == ["e/package-lock.json"]


def test_no_python_in_native_plans_and_no_setting_left(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    rows = spark.createDataFrame([("a", "")], "source string, text string")
    for parsed in NATIVE.values():
        plan = parsed(rows)._jdf.queryExecution().toString()
        assert "InPandas" not in plan and "InArrow" not in plan and "NestedLoop" not in plan
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


def test_only_the_named_formats_are_read(spark):
    t = read(spark.createDataFrame([("go.mod", GO)], "source string, text string"), ["gomod"])
    assert t.packages.count() == 3 and t.errors.count() == 0
    assert read(spark.createDataFrame([("r/requirements.txt", "a==1\n")], "source string, text string"), ["pip"]).packages.select(F.first("name")).first()[0] == "a"
