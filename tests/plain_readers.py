"""Plain-Python readers of the formats that the library reads in Catalyst, to hold it against."""

from __future__ import annotations

import re

from lockfleet.sources.grammars import Entry, Parsed, Refused, _dict, _str, strict_json

# npm ---------------------------------------------------------------------------------------


def npm(text: str) -> Parsed:
    """Entries with their paths as keys; the nearest-ancestor lookup of dependencies is a join."""
    doc = _dict(strict_json(text))
    version = doc.get("lockfileVersion")
    if isinstance(version, bool) or not isinstance(version, (int, float)):
        raise Refused("lockfileVersion is missing, which npm always writes")
    if version < 2:
        raise Refused(f"of npm's versions 2 and 3 are read, not {version}")
    packages = doc.get("packages")
    if not isinstance(packages, dict):
        raise Refused("`packages` is missing or no object")
    fields = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    wanted = lambda e: [d for k in fields for d in _dict(_dict(e).get(k))]
    out = []
    for key in sorted(packages, key=lambda k: k.encode("utf-8", "surrogatepass")):
        if not key:
            continue
        e = _dict(packages[key])
        resolved = _str(e.get("resolved")) or ""
        out.append(Entry(key.rpartition("node_modules/")[2], _str(e.get("version")) or "", key, dev=e.get("dev") is True, optional=e.get("optional") is True, first_party="node_modules/" not in key or e.get("link") is True, install_script=e.get("hasInstallScript") is True, has_integrity="integrity" in e, origin="registry" if resolved.startswith("https://registry.npmjs.org/") else "elsewhere", deps=[(d, None, None) for d in wanted(e)]))
    return Parsed(out, wanted(packages.get("")), install_scripts=True)


# go.mod ------------------------------------------------------------------------------------

# The directives of go.mod.
DIRECTIVES = ["module", "go", "toolchain", "require", "exclude", "replace", "retract", "godebug", "tool", "ignore"]
_GO_VERSION = re.compile(r"v[0-9]+\.[0-9]+\.[0-9]+([-+][A-Za-z0-9.+_-]*)?")


def gomod(text: str) -> Parsed:
    module = None
    requires: list[tuple[str, str, bool]] = []
    replaced: dict[str, str] = {}
    block: tuple[str, int, int] | None = None
    for n, raw in enumerate(_lines(text), 1):
        body, _, note = raw.partition("//")
        toks = [(_unquoted(m[0], n, m.start() + 1), m.start() + 1) for m in re.finditer(r"\S+", body)]
        if not toks:
            continue
        first, col = toks[0]
        if block and first == ")":
            if len(toks) > 1:
                raise Refused("text after the bracket that ends a block", n, toks[1][1])
            block = None
            continue
        if block:
            kind, args = block[0], toks
        else:
            if first not in DIRECTIVES:
                raise Refused(f"unknown directive {first}", n, col)
            kind, args = first, toks[1:]
            if args and args[0][0] == "(":
                if len(args) > 1:
                    raise Refused(f"text after the bracket that begins a block of {first}", n, args[1][1])
                block = (first, n, col)
                continue
        if kind == "module":
            if len(args) != 1:
                raise Refused("expected: module PATH", n, col)
            module = args[0][0]
        elif kind in ("require", "exclude"):
            if len(args) != 2:
                raise Refused(f"expected: {kind} PATH VERSION", n, col)
            if not _GO_VERSION.fullmatch(args[1][0]):
                raise Refused(f"a version begins with v and a digit, unlike {args[1][0]}", n, args[1][1])
            if kind == "require":
                said = note.strip()
                requires.append((args[0][0], args[1][0], said == "indirect" or said.startswith("indirect;")))
        elif kind == "replace":
            names = [t for t, _ in args]
            if "=>" not in names:
                raise Refused("expected: replace OLD => NEW", n, col)
            at = names.index("=>")
            if at == 0 or at + 1 >= len(names):
                raise Refused("a path is missing beside the arrow of replace", n, col)
            replaced[names[0]] = names[at + 1]
    if block:
        raise Refused(f"the file ends inside a block of {block[0]}", block[1], block[2])
    if module is None:
        raise Refused("the module directive is missing")
    return Parsed([Entry(p, v, p, first_party=(to := replaced.get(p)) is not None and to.startswith((".", "/")), origin="elsewhere" if p in replaced else "registry", direct=not indirect) for p, v, indirect in requires])


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def _unquoted(tok: str, line: int, col: int) -> str:
    if tok[0] not in "\"`":
        return tok
    if len(tok) < 2 or tok[-1] != tok[0]:
        raise Refused(f"a quoted string without its end: {tok}", line, col)
    if "\\" in tok:
        raise Refused(f"escapes in quoted strings are not read: {tok}", line, col)
    return tok[1:-1]


# yarn v1 -----------------------------------------------------------------------------------


def yarn(text: str) -> Parsed:
    """Entries with their header's specifiers as aliases and their dependencies as specifiers."""
    lines = _lines(text)
    if any(x.lstrip().startswith("__metadata:") for x in lines):
        raise Refused("written by Yarn 2 or later; version 1 is read")
    out: list[Entry] = []
    heads: list[int] = []
    in_deps = inside = False
    for n, raw in enumerate(lines, 1):
        body = raw.strip()
        if not body or body.startswith("#"):
            inside &= not body or raw[0] in " \t"  # a comment at the margin ends an entry
            continue
        if raw[0] not in " \t":
            if not raw.endswith(":"):
                raise Refused("a line of specifiers without its colon", n, len(raw) + 1)
            specs = [s for s in (_bare(p.strip()) for p in raw[:-1].split(",")) if s]
            if not specs:
                raise Refused("a line of specifiers without a specifier", n, 1)
            at = specs[0].rfind("@")
            out.append(Entry(specs[0][:at] if at > 0 else specs[0], aliases=specs))
            heads.append(n)
            in_deps, inside = False, True
        elif not inside:
            raise Refused("an indented line before the first entry", n, 1)
        elif body.endswith(":") and not re.search(r"\s", body[:-1]):
            in_deps = body[:-1] in ("dependencies", "optionalDependencies", "peerDependencies")
        else:
            pair = re.split(r"\s", body, maxsplit=1)
            if len(pair) < 2:
                raise Refused(f"expected a key and a value: {body}", n, 1)
            key, value = _bare(pair[0].strip()), _bare(pair[1].strip())
            own = out[-1]
            if in_deps and len(raw) - len(raw.lstrip()) >= 4:
                own.deps.append((f"{key}@{value}", None, None))
                continue
            in_deps = False
            if key == "version":
                own.version = value
            elif key == "resolved":
                own.origin = "registry" if value.startswith(("https://registry.yarnpkg.com/", "https://registry.npmjs.org/")) else "elsewhere"
            elif key == "integrity":
                own.has_integrity = True
    for e, n in zip(out, heads):
        if not e.version:
            raise Refused("an entry without a version", n, 1)
        e.key = f"{e.name}@{e.version}"
    if not out and not any(x.rstrip() == "# yarn lockfile v1" for x in lines):
        raise Refused("neither an entry nor Yarn's header line")
    return Parsed(out)


def _bare(x: str) -> str:
    return x[1:-1] if len(x) >= 2 and x[0] == x[-1] == '"' else x


READERS = {"npm": npm, "gomod": gomod, "yarn": yarn}
