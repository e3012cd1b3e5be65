"""Rule files, advisories, API descriptions, storage rows and source maps to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.functions.text import matches

# Words of keys and values that hold credentials.
STORED = ["token", "auth", "secret", "key", "session", "password", "credential"]


def stored_values(rows: DataFrame) -> DataFrame:
    """Storage rows (value: key=value) long enough and named like a credential."""
    return rows.where((F.length("value") >= 20) & F.lower("value").rlike("|".join(STORED)))


def inline_maps(bundles: DataFrame) -> DataFrame:
    """The other columns, path and content of each source with content in the last inline map of bundles (bundle)."""
    last = F.get(F.reverse(F.regexp_extract_all("bundle", F.lit(r"sourceMappingURL=data:[^,]*;base64,([A-Za-z0-9+/=]+)"), F.lit(1))), F.lit(0))
    m = F.from_json(F.decode(F.unbase64(last), "utf-8"), "sources array<string>, sourcesContent array<string>")
    rest = [c for c in bundles.columns if c != "bundle"]
    rows = bundles.select(*rest, F.inline(F.arrays_zip(m["sources"].alias("path"), m["sourcesContent"].alias("content"))))
    return rows.toDF(*rest, "path", "content").where("content is not null")


def toml_rules(files: DataFrame) -> DataFrame:
    """The other columns, id (lower case, _ for -) and pattern of each [[rules]] block of files (text)."""
    rest = [c for c in files.columns if c != "text"]
    blocks = files.select(*rest, F.explode(F.slice(F.split("text", r"\[\[rules\]\]"), F.lit(2), F.lit(2_000_000_000))).alias("block"))
    return blocks.select(*rest, F.translate(F.lower(F.regexp_extract("block", 'id = "([^"]+)"', 1)), "-", "_").alias("id"), F.regexp_extract("block", "'''(.*?)'''", 1).alias("pattern"))


def malicious(advisories: DataFrame) -> DataFrame:
    """id, package, ecosystem, versions of advisories (text: JSON) of malicious packages, a row each package."""
    shape = "id string, affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>>>"
    a = advisories.select(F.from_json("text", shape).alias("a")).where(F.col("a.id").startswith("MAL-"))
    return a.select(F.col("a.id").alias("id"), F.inline("a.affected")).select("id", F.col("package.name").alias("package"), F.col("package.ecosystem").alias("ecosystem"), "versions")


#: Characters between a quoted package and the version it is given, and of the longest package name.
VERSION_GAP, LONGEST_NAME = 80, 214
_version = r'"version"\s*:\s*"([^"]*)"'
_quoted = rf'(?<=")[^"]*(?="[\s\S]{{0,{VERSION_GAP}}}\z)'
_bare_key = r'(?<=")[^"]*(?="\s*:\s*")'


def locked_versions(files: DataFrame) -> DataFrame:
    """file, package (lower case), version (lower case) of "package" ... "version": "x" with at most VERSION_GAP characters between, in lockfiles (file, text): every quoted text before a version stands for a package."""
    found = files.select("file", F.explode(matches(F.col("text"), _version, 1, around=VERSION_GAP + LONGEST_NAME + 2)).alias("m"))
    names = F.array_distinct(F.regexp_extract_all("m.before", F.lit(_quoted), F.lit(0)))
    return found.select("file", F.explode(names).alias("package"), F.col("m.value").alias("version")).select("file", F.lower("package").alias("package"), F.lower("version").alias("version")).distinct()


def bare_keys(files: DataFrame) -> DataFrame:
    """file, package of "package": " in lockfiles."""
    return files.select("file", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_bare_key), F.lit(0)), F.lower))).alias("package"))


def separated_versions(files: DataFrame) -> DataFrame:
    """file, package, version of package==version, package@version, package version and alike: what stands left and right of separators, from and to any word boundary.

    A package may hold one colon (group:artifact).
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s,=<>:@]+"), F.lit(0))
    gaps = F.regexp_extract_all(F.lower("text"), F.lit(r"[\s,=<>:@]+"), F.lit(0))
    # The gap before word i is gaps[i - 1], or gaps[i] where the text begins with a gap.
    shift = F.when(F.lower("text").rlike(r"^[\s,=<>:@]"), 1).otherwise(0)
    cut = files.select("file", words.alias("w"), gaps.alias("g"), shift.alias("s"))
    left = F.col("w")

    def pair(i: Column) -> Column:
        name = F.get(left, i - 1)
        group = F.when((i >= 2) & (F.get("g", i - 2 + F.col("s")) == ":"), F.concat(F.get(left, i - 2), F.lit(":"), name))
        return F.struct(name.alias("name"), group.alias("grouped"), F.get(left, i).alias("version"))

    each = cut.where("size(w) > 1").select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), pair)).alias("p")).select("file", "p.*").distinct()
    # Suffixes of the left part from each word's first letter, prefixes of the right part to each word's last.
    starts = lambda c: F.regexp_extract_all(c, F.lit(r"(?=((?<![\p{L}\p{N}_])[\p{L}\p{N}_][\s\S]*(?<=[\p{L}\p{N}_])\z))"), F.lit(1))
    names = F.concat(starts(F.col("name")), F.coalesce(starts(F.col("grouped")), F.array().cast("array<string>")))
    ends = F.transform(F.array_distinct(F.regexp_extract_all(F.reverse("version"), F.lit(r"(?=((?<![\p{L}\p{N}_])[\p{L}\p{N}_][\s\S]*\z))"), F.lit(1))), F.reverse)
    return each.select("file", F.explode(F.array_distinct(names)).alias("package"), ends.alias("vs")).select("file", "package", F.explode("vs").alias("version")).distinct()


def lockfile_matches(files: DataFrame, listed: DataFrame) -> DataFrame:
    """file, id, package, ecosystem, version of lockfiles (file, text) that name a package of listed (id, package, ecosystem, versions), compared without case.

    With versions, npm packages count as "package" ... "version": "x", others as package, separators, version; without
    any, "package": " alone counts, with a null version. A null ecosystem is npm. Advisories and what the files name
    meet by equal package and version: each text is read once a form, however many packages are listed. Null texts
    name nothing.
    """
    known = listed.where(F.col("package") != "").select("id", "package", F.coalesce("ecosystem", F.lit("npm")).alias("ecosystem"), F.coalesce("versions", F.array().cast("array<string>")).alias("versions"), F.lower("package").alias("p_"))
    each = known.select("id", "package", "ecosystem", "p_", F.explode("versions").alias("version")).withColumn("v_", F.lower("version"))
    npm = F.lower("ecosystem") == "npm"
    out = ["file", "id", "package", "ecosystem", "version"]
    met = lambda rows, some: rows.withColumnsRenamed({"package": "p_", "version": "v_"}).join(some, ["p_", "v_"]).select(*out)
    bare = bare_keys(files).withColumnRenamed("package", "p_").join(known.where("size(versions) = 0").withColumn("version", F.lit(None).cast("string")), "p_").select(*out)
    return met(locked_versions(files), each.where(npm)).unionByName(met(separated_versions(files), each.where(~npm))).unionByName(bare).distinct()


def relation(path: str) -> F.Column:
    """A path's relation, null where it is the root, deeper or has a parameter."""
    name = F.trim(path if isinstance(path, F.Column) else F.col(path), F.lit("/"))
    return F.when((name != "") & ~name.contains("/") & ~name.contains("{"), name)


def api_tables(described: DataFrame) -> DataFrame:
    """The other columns and the distinct names of relations that API descriptions (text: JSON) define or serve."""
    j = F.from_json("text", "definitions map<string,string>, paths map<string,string>")
    rest = [c for c in described.columns if c != "text"]
    served = F.array_compact(F.transform(F.coalesce(F.map_keys(j["paths"]), F.array().cast("array<string>")), relation))
    return described.select(*rest, F.explode(F.array_union(F.coalesce(F.map_keys(j["definitions"]), F.array().cast("array<string>")), served)).alias("name")).where("name <> ''")


def api_views(described: DataFrame) -> DataFrame:
    """The other columns and the names of relations that take no inserts: operations, but no post."""
    j = F.from_json("text", "paths map<string,map<string,string>>")
    rest = [c for c in described.columns if c != "text"]
    p = described.select(*rest, F.explode(j["paths"]).alias("path", "ops")).withColumn("name", relation("path"))
    return p.where((F.size("ops") > 0) & ~F.exists(F.map_keys("ops"), lambda o: F.lower(o) == "post") & F.col("name").isNotNull()).select(*rest, "name")
