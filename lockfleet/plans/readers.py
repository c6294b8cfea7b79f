"""Queries that write lockfiles of every shape from the driver's parts, one a brand, and read them back with the library's readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockfleet.sources.lockfiles import Tables, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The parts of a brand in order: number, name, version, the next one's number and name, and whether a part is the first.
SQL = (
    "WITH x AS (SELECT p_brand AS brand, p_partkey AS k, 'm' || p_partkey AS name, p_size || '.0.' || (p_partkey % 10) AS version, "
    "lead(p_partkey) OVER w AS nx, lead(p_size || '.0.' || (p_partkey % 10)) OVER w AS nv, row_number() OVER w = 1 AS is_first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) "
)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = SQL + sql
        return f

    return add


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def only(test: Column, *parts) -> Column:
    return F.when(test, cat(*parts)).otherwise(F.lit(""))


def each(x: Column, f: Callable[[Column], Column], between: str = "") -> Column:
    return F.array_join(F.transform(x, f), between)


def listed(x: Column, test: Callable[[Column], Column], f: Callable[[Column], Column], between: str) -> Column:
    return F.array_join(F.transform(F.filter(x, test), f), between)


def _tables(spark: SparkSession, sf_dir: str, name: str, form: str, text: Callable[[Column], Column]) -> Tables:
    """What the reader of ``form`` finds in a file for each brand; ``text`` makes it from the brand's parts (k, name, version, nx, nv)."""
    k = F.col("p_partkey")
    version = cat(F.col("p_size").cast("string"), ".0.", (k % 10).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), version.alias("version")))).alias("x"))
    following = lambda i: F.get(F.col("x"), i + 1)
    rows = rows.withColumn("x", F.transform("x", lambda p, i: F.struct(p["k"].alias("k"), cat("m", p["k"].cast("string")).alias("name"), p["version"].alias("version"), following(i)["k"].alias("nx"), following(i)["version"].alias("nv"))))
    return read(rows.select(cat(F.col("p_brand"), "/" + name).alias("source"), text(F.col("x")).alias("text")), [form])


def _brand(df: DataFrame) -> DataFrame:
    return df.withColumn("brand", F.substring_index("source", "/", 1))


def _packages(t: Tables) -> DataFrame:
    return _brand(t.packages).select("brand", "key", "name", "version", "dev", "optional", "first_party", "install_script", "has_integrity", "origin", "is_root")


def _edges(t: Tables) -> DataFrame:
    keys = t.packages.select("source", "idx", "key", "version")
    end = lambda side: keys.select("source", F.col("idx").alias(f"{side}_idx"), F.concat_ws(" ", "key", "version").alias(f"{side}_key"))
    return _brand(t.edges.join(end("from"), ["source", "from_idx"]).join(end("to"), ["source", "to_idx"])).select("brand", "from_key", "to_key")


# npm: nested places, workspaces, links, peers, repeated keys ------------------------------


def _npm(x: Column) -> Column:
    n = lambda p: p["k"].cast("string")
    here = lambda p: cat("node_modules/", p["name"])
    package = lambda p: cat(
        ',"', here(p), '":{"version":"', p["version"], '","resolved":"https://', F.when(p["k"] % 4 == 0, "elsewhere.example").otherwise("registry.npmjs.org"), '/m.tgz"', only(p["k"] % 4 != 1, ',"integrity":"sha512-x"'),
        only(p["k"] % 3 == 0, ',"dev":true'), only(p["k"] % 7 == 0, ',"optional":true'), only(p["k"] % 23 == 0, ',"hasInstallScript":true'),
        ',"dependencies":{"dep":"1","absent":"1"', only(p["nx"].isNotNull() & (p["k"] % 2 == 0), ',"m', p["nx"].cast("string"), '":"1"'), "}", only(p["nx"].isNotNull(), ',"peerDependencies":{"m', p["nx"].cast("string"), '":"*"}'), "}",
        only(p["k"] % 5 == 0, ',"', here(p), '/node_modules/dep":{"version":"', n(p), '.0.0","dependencies":{"', p["name"], '":"1"}}'),
    )
    named = lambda p: cat('"', p["name"], '":"1"')
    return cat(
        '{"lockfileVersion":3,"packages":{"node_modules/dep":{"version":"0.0.1","dev":true},"":{"dependencies":{', named(x[0]), '},"devDependencies":{', listed(x, lambda p: p["k"] % 11 == 0, named, ","),
        '}},"node_modules/w":{"link":true,"resolved":"apps/w"},"apps/w":{"dependencies":{"dep":"1"', listed(x, lambda p: p["k"] % 13 == 0, lambda p: cat(",", named(p)), ""),
        '}},"apps/w/node_modules/dep":{"version":"7.0.0"}', each(x, package), ',"node_modules/dep":{"version":"1.0.0"}}}',
    )


_NPM_FLAGS = "false AS dev, false AS optional, {} AS first_party, false AS install_script, false AS has_integrity, 'elsewhere' AS origin, {} AS is_root"


@query(
    "SELECT brand, 'node_modules/' || name AS key, name, version, k % 3 = 0 AS dev, k % 7 = 0 AS optional, false AS first_party, k % 23 = 0 AS install_script, k % 4 <> 1 AS has_integrity, CASE WHEN k % 4 = 0 THEN 'elsewhere' ELSE 'registry' END AS origin, is_first OR k % 11 = 0 OR k % 13 = 0 AS is_root FROM x "
    f"UNION ALL SELECT brand, 'node_modules/' || name || '/node_modules/dep', 'dep', k || '.0.0', {_NPM_FLAGS.format('false', 'false')} FROM x WHERE k % 5 = 0 "
    f"UNION ALL SELECT DISTINCT brand, 'node_modules/dep', 'dep', '1.0.0', {_NPM_FLAGS.format('false', 'false')} FROM x "
    f"UNION ALL SELECT DISTINCT brand, 'apps/w/node_modules/dep', 'dep', '7.0.0', {_NPM_FLAGS.format('false', 'true')} FROM x "
    f"UNION ALL SELECT DISTINCT brand, 'apps/w', 'apps/w', '', {_NPM_FLAGS.format('true', 'false')} FROM x "
    f"UNION ALL SELECT DISTINCT brand, 'node_modules/w', 'w', '', {_NPM_FLAGS.format('true', 'false')} FROM x"
)
def npm_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(_tables(spark, sf_dir, "package-lock.json", "npm", _npm))


@query(
    "SELECT brand, 'node_modules/' || name || ' ' || version AS from_key, CASE WHEN k % 5 = 0 THEN 'node_modules/' || name || '/node_modules/dep ' || k || '.0.0' ELSE 'node_modules/dep 1.0.0' END AS to_key FROM x "
    "UNION ALL SELECT brand, 'node_modules/' || name || ' ' || version, 'node_modules/m' || nx || ' ' || nv FROM x WHERE nx IS NOT NULL "
    "UNION ALL SELECT brand, 'node_modules/' || name || '/node_modules/dep ' || k || '.0.0', 'node_modules/' || name || ' ' || version FROM x WHERE k % 5 = 0"
)
def npm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_tables(spark, sf_dir, "package-lock.json", "npm", _npm))


# yarn: repeated specifiers, sections of dependencies, sections that are none ---------------


def _yarn(x: Column) -> Column:
    spec = lambda n, p: cat('m', n, '@~', p)
    entry = lambda p: cat(
        '"', p["name"], '@^1", ', spec(p["k"].cast("string"), (p["k"] % 3).cast("string")), ':\n  version "', p["version"], '"\n  resolved "https://', F.when(p["k"] % 4 == 0, "elsewhere.example").otherwise("registry.yarnpkg.com"), '/m.tgz"\n',
        only(p["k"] % 4 != 1, "  integrity sha512-x\n"),
        only(p["nx"].isNotNull(), "  dependencies:\n    m", p["nx"].cast("string"), ' "^1"\n'), "  engines:\n    ", p["name"], ' "^1"\n',
        only(p["nx"].isNotNull(), "  optionalDependencies:\n    absent \"1\"\n    m", p["nx"].cast("string"), ' "~', (p["nx"] % 3).cast("string"), '"\n'),
        only(p["k"] % 5 == 0, "\n# again\n", p["name"], '@^1:\n  version "9.', p["k"].cast("string"), '"\n  resolved "https://registry.npmjs.org/m.tgz"\n'),
    )
    return cat("# yarn lockfile v1\n\n", each(x, entry, "\n"))


_YARN_FLAGS = "false AS dev, false AS optional, false AS first_party, false AS install_script"


@query(
    f"SELECT brand, name || '@' || version AS key, name, version, {_YARN_FLAGS}, k % 4 <> 1 AS has_integrity, CASE WHEN k % 4 = 0 THEN 'elsewhere' ELSE 'registry' END AS origin, is_first AS is_root FROM x "
    f"UNION ALL SELECT brand, name || '@9.' || k, name, '9.' || k, {_YARN_FLAGS}, false, 'registry', is_first FROM x WHERE k % 5 = 0"
)
def yarn_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(_tables(spark, sf_dir, "yarn.lock", "yarn", _yarn))


@query(
    "SELECT DISTINCT brand, name || '@' || version || ' ' || version AS from_key, unnest([CASE WHEN nx % 5 = 0 THEN 'm' || nx || '@9.' || nx || ' 9.' || nx ELSE 'm' || nx || '@' || nv || ' ' || nv END, 'm' || nx || '@' || nv || ' ' || nv]) AS to_key FROM x WHERE nx IS NOT NULL"
)
def yarn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_tables(spark, sf_dir, "yarn.lock", "yarn", _yarn))


# go.mod: blocks, quotes, comments that say indirect, replacements before and after ----------


def _gomod(x: Column) -> Column:
    path = lambda p: cat("ex.org/", p["name"])
    require = lambda p: cat("\t", F.when(p["k"] % 7 == 0, cat('"', path(p), '"')).otherwise(path(p)), " v1.", p["k"].cast("string"), ".0", F.when(p["k"] % 3 == 1, " // indirect").otherwise(F.lit(" // direct")), "\r\n")
    one = lambda p: cat("replace ", path(p), " v1.", p["k"].cast("string"), ".0 => ", F.when(p["k"] % 10 == 0, "./local").otherwise("ex.org/fork v1.0.0"), "\n")
    return cat(
        "module ex.org/app // the module\n\ngo 1.22\n", listed(x, lambda p: p["k"] % 5 == 0, one, ""), "require (\n", each(x, require), ")\n\nreplace (\n", listed(x, lambda p: p["k"] % 20 == 0, lambda p: cat("\t", path(p), " => ex.org/later v1.0.0\n"), ""),
        ")\nretract (\n\tv0.0.1 // a mistake\n)\n", listed(x, lambda p: p["k"] % 9 == 0, lambda p: cat("exclude ", path(p), " v0.0.1\n"), ""),
    )


@query(
    "SELECT brand, 'ex.org/' || name AS key, 'ex.org/' || name AS name, 'v1.' || k || '.0' AS version, false AS dev, false AS optional, k % 10 = 0 AND k % 20 <> 0 AS first_party, false AS install_script, false AS has_integrity, "
    "CASE WHEN k % 5 = 0 THEN 'elsewhere' ELSE 'registry' END AS origin, k % 3 <> 1 AND NOT (k % 10 = 0 AND k % 20 <> 0) AS is_root FROM x"
)
def gomod_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(_tables(spark, sf_dir, "go.mod", "gomod", _gomod))


# Cargo and uv: versions and sources asked for; pnpm: versions 6 and 9, peers ----------------


def _cargo(x: Column) -> Column:
    crate = lambda name, version, source, *more: cat('[[package]]\nname = "', name, '"\nversion = "', version, '"\nsource = "', source, '"\n', *more, "\n")
    dep = lambda p: F.when(p["nx"] % 4 != 0, cat("m", p["nx"].cast("string"))).when(p["k"] % 2 == 0, cat("m", p["nx"].cast("string"), " 9.9.9 (registry+other)")).otherwise(cat("m", p["nx"].cast("string"), " ", p["nv"]))
    entry = lambda p: cat(only(p["k"] % 4 == 0, crate(p["name"], "9.9.9", "registry+other")), crate(p["name"], p["version"], "git+https://x", only(p["k"] % 4 != 1, 'checksum = "c"\n'), only(p["nx"].isNotNull(), 'dependencies = ["', dep(p), '", "absent"]\n')))
    return cat('version = 3\n\n[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = ["', x[0]["name"], " ", x[0]["version"], '"]\n\n', each(x, entry))


@query("SELECT brand, name || ' ' || version || ' ' || version AS from_key, 'm' || nx || CASE WHEN nx % 4 = 0 AND k % 2 = 0 THEN ' 9.9.9 9.9.9' ELSE ' ' || nv || ' ' || nv END AS to_key FROM x WHERE nx IS NOT NULL")
def cargo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_tables(spark, sf_dir, "Cargo.lock", "cargo", _cargo))


def _uv(x: Column) -> Column:
    entry = lambda p: cat(
        '[[package]]\nname = "', p["name"], '"\nversion = "', p["version"], '"\nsource = { ', F.when(p["k"] % 6 == 0, 'git = "g"').otherwise('registry = "r"'), " }\n",
        only(p["nx"].isNotNull(), F.when(p["k"] % 3 == 0, "optional-dependencies = { more = [").otherwise("dependencies = ["), '{ name = "M', p["nx"].cast("string"), '"', only(p["k"] % 2 == 0, ', version = "9.9"'), " }", F.when(p["k"] % 3 == 0, "] }\n").otherwise("]\n")), "\n",
        only(p["k"] % 4 == 0, '[[package]]\nname = "', p["name"], '"\nversion = "9.9"\nsource = { registry = "r" }\n\n'),
    )
    return cat('version = 1\nrequires-python = ">=3.9"\n\n', each(x, entry))


@query(
    "SELECT brand, name || ' ' || version AS from_key, unnest(CASE WHEN nx % 4 <> 0 THEN ['m' || nx || ' ' || nv] WHEN k % 2 = 0 THEN ['m' || nx || ' 9.9'] ELSE ['m' || nx || ' ' || nv, 'm' || nx || ' 9.9'] END) AS to_key FROM x WHERE nx IS NOT NULL"
)
def uv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_tables(spark, sf_dir, "uv.lock", "uv", _uv))


def _pnpm(x: Column) -> Column:
    peer = lambda p: only(p["nx"].isNotNull(), "(m", p["nx"].cast("string"), "@", p["nv"], ")")
    resolution = lambda p: cat("    resolution: {integrity: sha512-x", only(p["k"] % 4 == 0, ", tarball: t"), "}\n")
    wants = lambda p: only(p["nx"].isNotNull(), "    dependencies:\n      m", p["nx"].cast("string"), ": ", p["nv"], "\n")
    optional = lambda p: only(p["k"] % 7 == 0, "    optional: true\n")
    flags = lambda p: cat(only(p["k"] % 3 == 0, "    dev: true\n"), only(p["k"] % 23 == 0, "    requiresBuild: true\n"))
    root = cat("    dependencies:\n      ", x[0]["name"], ":\n        specifier: ^1\n        version: ", x[0]["version"], peer(x[0]), "\n")
    nine = cat("lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n", root, "\npackages:\n\n", each(x, lambda p: cat("  ", p["name"], "@", p["version"], ":\n", resolution(p), flags(p)), "\n"), "\nsnapshots:\n\n", each(x, lambda p: cat("  ", p["name"], "@", p["version"], peer(p), ":\n", "    id: x\n", optional(p), wants(p)), "\n"))
    six = cat("lockfileVersion: '6.0'\n\ndependencies:\n  ", x[0]["name"], ":\n    specifier: ^1\n    version: ", x[0]["version"], peer(x[0]), "\n\npackages:\n\n", each(x, lambda p: cat("  /", p["name"], "@", p["version"], peer(p), ":\n", resolution(p), flags(p), optional(p), wants(p)), "\n"))
    return F.when(x[0]["k"] % 2 == 0, six).otherwise(nine)


@query(
    "SELECT brand, name || '@' || version AS key, name, version, k % 3 = 0 AS dev, k % 7 = 0 AS optional, false AS first_party, k % 23 = 0 AS install_script, true AS has_integrity, CASE WHEN k % 4 = 0 THEN 'elsewhere' ELSE 'registry' END AS origin, is_first AS is_root FROM x"
)
def pnpm_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(_tables(spark, sf_dir, "pnpm-lock.yaml", "pnpm", _pnpm))


@query("SELECT brand, name || '@' || version || ' ' || version AS from_key, 'm' || nx || '@' || nv || ' ' || nv AS to_key FROM x WHERE nx IS NOT NULL")
def pnpm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_tables(spark, sf_dir, "pnpm-lock.yaml", "pnpm", _pnpm))
