"""Package manifests, workflows, split keys and the shapes of self-spreading code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.functions.text import matches
from siftgrid.operators import detect
from siftgrid.sources.scratch import Scratch

MOST_MANIFEST, MOST_MANIFESTS = 4 * 1024 * 1024, 5000
MANIFEST = "name string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>"
DEPENDENCIES = ["optionalDependencies", "dependencies", "devDependencies"]
GIT_REF = r"(?i)^(?:github:|gitlab:|bitbucket:|git\+|git://|[\w.-]+/[\w.-]+(?:#.+)?$|https?://.*\.(?:tgz|tar\.gz)(?:[?#].*)?$)"
URL_AUTH = r"(?i)\b(https?|git|ssh)://([^/@\s]+)@"


def manifests(files: DataFrame, most: int = MOST_MANIFESTS) -> DataFrame:
    """project, path, m (the manifest), truncated of package files (project, path, text): a project's own and those in node_modules.

    Files above 4 MiB and other JSON than objects go. The first `most` of a project are read, its own first;
    the limit is the feature, and truncated says that it acted.
    """
    own = ~F.col("path").contains("node_modules/")
    listed = files.where(F.col("path").rlike(r"(?:^|/)package\.json$") & (F.col("path").contains("node_modules/") | ~F.col("path").contains("/")))
    order = Window.partitionBy("project").orderBy(~own, "path")
    first = listed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1)
    counted = first.withColumn("truncated", F.max("k").over(Window.partitionBy("project")) > most).where(F.col("k") <= most)
    fine = counted.where((F.octet_length("text") <= MOST_MANIFEST) & F.ltrim("text").startswith("{"))
    read = fine.select("project", "path", F.from_json("text", f"{MANIFEST}, _corrupt_record string").alias("m"), "truncated")
    return read.where("m._corrupt_record is null")


def script_danger(command: Column) -> Column:
    """struct<label, severity> of an install script, null for a harmless one: a fetch with a run, else the first dangerous shape."""
    one = lambda label, severity: F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"))
    found = F.when(command.rlike(rules.HOOK_DOWNLOAD) & command.rlike(rules.HOOK_RUN), one(*rules.HOOK_FETCH_AND_RUN))
    for label, pattern, severity in rules.HOOK_DANGERS:
        found = found.when(command.rlike(pattern), one(label, severity))
    return found


def hooks(read: DataFrame) -> DataFrame:
    """project, path, package, hook, label, severity, confidence of dangerous install scripts of manifests."""
    package = F.coalesce(F.nullif("m.name", F.lit("")), F.nullif(F.regexp_extract("path", r"([^/]+)/package\.json$", 1), F.lit("")), F.lit("."))
    each = read.select("project", "path", package.alias("package"), F.explode("m.scripts").alias("hook", "command")).where(F.col("hook").isin(rules.HOOKS) & (F.trim("command") != ""))
    found = each.withColumn("d", script_danger(F.col("command"))).where("d is not null").select("project", "path", "package", "hook", "d.*")
    return found.withColumn("confidence", F.when(F.col("severity") == "high", 0.8).otherwise(0.6))


def git_dependencies(read: DataFrame) -> DataFrame:
    """project, path, field, name, spec, severity of dependencies outside the registry; credentials in them masked."""
    fields = read.select("project", "path", F.explode(F.create_map(*[x for f in DEPENDENCIES for x in (F.lit(f), F.col(f"m.{f}"))])).alias("field", "listed"))
    each = fields.select("project", "path", "field", F.explode("listed").alias("name", "spec")).where(F.trim("spec").rlike(GIT_REF))
    return each.select("project", "path", "field", "name", F.regexp_replace(F.trim("spec"), URL_AUTH, "$1://***@").alias("spec"), F.when(F.col("field") == "optionalDependencies", "high").otherwise("medium").alias("severity"))


def triggers(workflows: DataFrame) -> DataFrame:
    """file, event of workflows (file, text) whose `on:`, in one line or as a block, names a dangerous event."""
    on = F.concat(F.regexp_extract("text", rules.ON_INLINE, 1), F.lit("\n"), F.regexp_extract("text", rules.ON_BLOCK, 1))
    found = F.array_compact(F.array(*[F.when(on.rlike(rf"\b{t}\b"), t) for t in rules.WORKFLOW_TRIGGERS]))
    return workflows.select("file", F.explode(found).alias("event"))


# A step of a workflow, a local action, a full commit.
USES = r"^\s*-?\s*uses:\s*([^\s#]+)\s*(?:#.*)?$"
LOCAL_ACTION, COMMIT = r"^\.{1,2}/", "^[a-f0-9]{40}$"


def unpinned(workflows: DataFrame) -> DataFrame:
    """file, line, spec, problem of every step of workflows (file, text) whose action isn't fixed to a commit: no ref at all, or one that can be moved. Actions of the repository itself are fine, whatever stands in quotes counts without them."""
    found = workflows.select("file", F.explode(matches(F.col("text"), F.lit("(?m)" + USES), 1)).alias("m"))
    spec = F.regexp_replace(F.regexp_replace(F.col("m.value"), '^"+|"+$', ""), "^'+|'+$", "")
    each = found.select("file", F.col("m.line").alias("line"), spec.alias("spec"), F.col("m.whole").alias("whole"))
    # What stands before the step may be empty lines: they count as the match's.
    loose = each.where(~F.col("spec").rlike(LOCAL_ACTION) & (~F.col("spec").contains("@") | ~F.substring_index("spec", "@", -1).rlike(COMMIT)))
    return loose.select("file", "line", "spec", F.when(~F.col("spec").contains("@"), "no ref").otherwise("tag").alias("problem"))


FRAGMENT = r"[A-Za-z0-9_-]{12,}"
PREFIX = "^(?:" + "|".join(p.replace(".", "\\.") for p in rules.KEY_PREFIXES) + ")"


#: Fragments of a repository that meet as many leads in one cell.
CELL = 2000


def split_keys(files: DataFrame, cell: int = CELL) -> DataFrame:
    """repo, lead_file, lead_line, other_file, other_line, prefix, assembled: fragments of one repository that together would be a key.

    files: repo, file, text. A lead begins with a known prefix; every fragment of another file may follow it, so
    pairs are leads times fragments, and all are given. Leads and fragments of a repository are cut into blocks of
    about `cell`, and each block of leads meets each block of fragments by itself: a repository that holds most
    fragments spreads over all tasks. A null text has no fragments.
    """
    scratch = Scratch(files.sparkSession)
    found = detect.scan(files.withColumnRenamed("text", "content"), {"fragment": FRAGMENT}, case=True).select("repo", "file", "line", F.col("value").alias("part"))
    f = scratch.keep(found.withColumn("leads", F.col("part").rlike(PREFIX)), "fragments")
    # A repository without a lead gives nothing and moves nothing.
    sizes = f.groupBy("repo").agg(F.ceil(F.count_if("leads") / cell).cast("int").alias("lead_blocks"), F.ceil(F.count("*") / cell).cast("int").alias("part_blocks")).where("lead_blocks > 0")
    placed = f.join(sizes, "repo").withColumn("h", F.xxhash64("file", "line", "part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    leads = placed.where("leads").select("repo", F.col("file").alias("lead_file"), F.col("line").alias("lead_line"), F.col("part").alias("lead"), own("lead_blocks").alias("i"), every("part_blocks").alias("j"))
    parts = placed.select("repo", F.col("file").alias("other_file"), F.col("line").alias("other_line"), "part", own("part_blocks").alias("j"), every("lead_blocks").alias("i"))
    both = leads.join(parts, ["repo", "i", "j"]).where("lead_file <> other_file")
    prefix = F.coalesce(*[F.when(F.startswith("lead", F.lit(p)), p) for p in rules.KEY_PREFIXES])
    return both.select("repo", "lead_file", "lead_line", "other_file", "other_line", prefix.alias("prefix"), F.left(F.concat("lead", "part"), F.lit(80)).alias("assembled"))


def first_after(probes: DataFrame, hits: DataFrame, at: str, name: str) -> DataFrame:
    """probes (source, ...) with `name`, the first line of hits (source, line) at or after the column `at`: one sort of both by source and line, no pairs."""
    marked = probes.withColumn("probe_", F.struct(*probes.columns)).select("source", F.col(at).alias("x_"), "probe_", F.lit(None).cast("int").alias("line_"))
    lines = hits.select("source", F.col("line").alias("x_"), F.lit(None).cast(marked.schema["probe_"].dataType).alias("probe_"), F.col("line").alias("line_"))
    # From the last line on: a running least, where a frame that opens forward would be taken anew for each row.
    ahead = Window.partitionBy("source").orderBy(F.desc("x_")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.unionByName(lines).withColumn(name, F.min("line_").over(ahead))
    return found.where("probe_ is not null").select("probe_.*", name)


def worm_shapes(sources: DataFrame, span: int = 200) -> DataFrame:
    """source, env_line, net_line, write_line: the first (read, send, write) of a source (source, content) within `span` lines, by order of reads, then sends, then writes."""
    return worm_lines(detect.scan(sources, rules.WORM).select("source", "rule", "line"), span)


def worm_lines(hits: DataFrame, span: int = 200) -> DataFrame:
    """worm_shapes of hits (source, rule, line).

    For a read, the write that counts with any earlier send is the first from `span` lines before the read; of
    later sends only the next can do, as the first write that fits a later one comes later still. So each read
    looks up four lines, each by a window over the sorted hits: time is that of a sort, however many hits are near.
    """
    once = hits.where("line is not null").select("source", "rule", F.col("line").cast("int").alias("line")).distinct()
    kind = lambda k: once.where(F.col("rule") == k).select("source", "line")
    net, write = kind("net_egress"), kind("persistence_write")
    reads = kind("env_read").withColumnRenamed("line", "env_line").withColumn("from_", F.col("env_line") - span)
    reads = first_after(reads, write, "from_", "w_")
    reads = reads.withColumn("from_", F.greatest("env_line", F.coalesce("w_", "env_line")) - span)
    reads = first_after(reads, net, "from_", "n_").withColumn("from_", F.col("env_line") + 1)
    reads = first_after(reads, net, "from_", "later_").withColumn("from_", F.coalesce(F.col("later_"), F.col("env_line")) - span)
    reads = first_after(reads, write, "from_", "w_later_")
    before = (F.col("w_") <= F.col("env_line") + span) & (F.col("n_") <= F.col("env_line"))
    after = (F.col("later_") <= F.col("env_line") + span) & (F.col("w_later_") <= F.col("env_line") + span)
    found = F.when(before, F.struct("env_line", F.col("n_").alias("net_line"), F.col("w_").alias("write_line"))).when(after, F.struct("env_line", F.col("later_").alias("net_line"), F.col("w_later_").alias("write_line")))
    return reads.groupBy("source").agg(F.min(found).alias("b")).where("b is not null").select("source", "b.*")
