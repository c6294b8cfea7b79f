"""The canonical tables. All are keyed by ``source``, the path of a lockfile."""

LOCKFILES = "source string, file_name string, format string, ecosystem string, records_edges boolean, records_install_scripts boolean"
PACKAGES = (
    "source string, idx int, name string, version string, key string, dev boolean, optional boolean, first_party boolean, "
    "install_script boolean, has_integrity boolean, pin_kind string, pin_spec string, origin string, is_root boolean"
)
EDGES = "source string, from_idx int, to_idx int"
CORPUS = "ecosystem string, name string"
FINDINGS = "source string, rule string, rule_rank int, severity string, sev_rank int, package string, version string, detail string"
#: What a file's reader found: its entries with what they refer to, what its manifests ask for, or what is wrong and where.
DEPS = "array<struct<name:string,version:string,src:string>>"
ENTRIES = (
    "array<struct<name:string,version:string,key:string,dev:boolean,optional:boolean,first_party:boolean,install_script:boolean,has_integrity:boolean,"
    f"origin:string,src:string,direct:boolean,aliases:array<string>,deps:{DEPS}>>"
)
PARSED = f"source string, format string, entries {ENTRIES}, wanted array<string>, scripts boolean, what string, line int, col int"
ERRORS = "source string, kind string, what string, line int, col int"

# Formats by the suffix of a file's name, their ecosystems, and what they record.
FORMATS = [
    # suffix, format, ecosystem, records edges, records install scripts
    ("package-lock.json", "npm", "npm", True, True),
    ("pnpm-lock.yaml", "pnpm", "npm", True, False),
    ("Cargo.lock", "cargo", "crates.io", True, False),
    ("requirements.txt", "pip", "pypi", False, False),
    ("poetry.lock", "poetry", "pypi", True, False),
    ("uv.lock", "uv", "pypi", True, False),
    ("go.mod", "gomod", "go", False, False),
    ("yarn.lock", "yarn", "npm", True, False),
]
# Lockfiles that are known by name but not read.
UNSUPPORTED = ["Gemfile.lock", "Pipfile.lock", "Podfile.lock", "bun.lock", "bun.lockb", "composer.lock", "conan.lock", "go.sum", "gradle.lockfile", "mix.lock", "packages.lock.json", "pdm.lock", "pubspec.lock"]
# Folders that discovery doesn't enter, and how deep it goes.
SKIPPED_DIRS = ["node_modules", ".git", "target", "vendor", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "dist", ".next", ".svelte-kit"]
MAX_DEPTH = 6

# Severities and rules in rank order.
SEVERITIES = ["low", "medium", "high", "critical"]
RULES = ["slopsquat", "install-script", "trivial", "drift", "pinning"]
ECOSYSTEMS = ["npm", "pypi", "crates.io", "go"]
