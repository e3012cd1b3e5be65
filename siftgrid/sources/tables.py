"""Input tables, and tables that Spark derives from them.

A derived table has a row for each row of its base table, so work on it grows
with the data. Each comes with the DuckDB SQL of the same rows, as the body of a
common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents above this many bytes aren't scanned.
MOST_BYTES = 5 * 1024 * 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out over all cores if it comes in fewer parts: scans by many rules cost far more than moving the text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, content of all documents that are scanned."""
    d = spread(read(spark, sf_dir, "documents")).where((F.octet_length("text") <= MOST_BYTES) & F.col("text").isNotNull())
    return d.select("doc_id", "source", F.col("text").alias("content"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(values: list[str], number: Column) -> Column:
    """One of the values by number; {h} in it is the hash of the number, {n} the number."""
    chosen = F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("{h}"), F.md5(number.cast("string").cast("binary"))), F.lit("{n}"), number.cast("string"))


def pick_sql(values: list[str], number: str) -> str:
    listed = ", ".join(map(sql_text, values))
    return f"replace(replace(list_extract([{listed}], ({number} % {len(values)} + 1)::int), '{{h}}', md5(({number})::varchar)), '{{n}}', ({number})::varchar)"


#: Lines put before documents: real-looking and harmless values for the rules. All are invented.
PLANTED = [
    "export KEY=sk-proj-{h}Qz",
    "aws_access_key_id = AKIAQ5Z7M2X9B4K8J3N{n}",
    "url: postgres://svc{n}:{h}@db.internal.net:5432/app",
    "url: postgres://postgres:postgres@db:5432/app",
    "Authorization: Bearer {h}.{h}",
    "token = 'ghp_{h}a1B2'",
    "const u = 'https://user{n}:pw-{h}@files.example.net/x'",
    "http://localhost:{h}@127.0.0.1/",
    "if (user.isAdmin === true) db.from('orders_{n}').select('*')",
    "curl https://hooks.slack.com/services/T{h}/B{n}/{h}",
    "//# sourceMappingURL=app.{n}.js.map",
    "query IntrospectionQuery { __schema }",
    "password = \"Zx9!{h}\"",
    "your_api_key = example_{n}",
    "AIza{h}abc firebaseConfig",
    "host 192.168.{n}.7 or 10.1.2.3",
    "nothing to see in line {n}",
]
#: Where a planted document comes from.
PATHS = ["src/app{n}.js", "tests/fixtures/a{n}.py", "docs/readme{n}.md", "config/prod.env", ".github/workflows/ci{n}.yml", "dist/bundle{n}.js.map", "logs/run.log", "node_modules/x/index.js", "Dockerfile", "image{n}.png"]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source (a path), content: documents with one planted line each."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", pick(PATHS, F.col("doc_id")).alias("source"), F.concat(pick(PLANTED, F.col("doc_id")), F.lit("\n"), "content").alias("content"))


PLANTED_SQL = f"planted as (select doc_id, {pick_sql(PATHS, 'doc_id')} as source, {pick_sql(PLANTED, 'doc_id')} || chr(10) || text as content from documents where text is not null and octet_length(encode(text)) <= {MOST_BYTES})"

# Type, severity, pack, status of derived findings.
KINDS = [
    ("openai_api_key", "critical", "leak", "validated"),
    ("database_url", "critical", "leak", "confirmed"),
    ("jwt_token", "medium", "leak", "validated"),
    ("sql_injection", "medium", "appsec", "lead"),
    ("xss", "medium", "appsec", "lead"),
    ("idor", "medium", "access-control", "lead"),
    ("dead_code", "info", "housekeeping", "lead"),
    ("private_ip", "low", "leak", "validated"),
    ("supabase_url", "medium", "baas", "lead"),
    ("baas_open_table", "high", "baas", "confirmed"),
    ("env_config_bug", "low", "correctness", "lead"),
    ("source_map_reference", "low", "leak", "validated"),
    ("baas_cors_wildcard", "low", "baas", "confirmed"),
    ("baas_service_role_exposed", "critical", "baas", "confirmed"),
    ("baas_writable_table", "critical", "baas", "confirmed"),
]
SEVERITY_CASE = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, type, severity, category, validation_status, source, line, value, url: one finding a document."""
    n = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    kind = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), (F.pmod(n * 7 + F.col("n_chars"), F.lit(len(KINDS))) + 1).cast("int"))
    return d.select(
        n.alias("ord"),
        kind(0).alias("type"),
        kind(1).alias("severity"),
        kind(2).alias("category"),
        kind(3).alias("validation_status"),
        pick(PATHS, F.pmod(n, F.lit(40))).alias("source"),
        (F.pmod(F.col("n_chars"), F.lit(5)) + 1).cast("int").alias("line"),
        F.concat(F.lit("v-"), F.md5(F.pmod(n, F.lit(90)).cast("string").cast("binary"))).alias("value"),
        F.when(F.pmod(n, F.lit(3)) == 0, "").otherwise(pick(["https://h{n}.shop.example.com/p?id=4&token={h}", "http://api.example.net/v{n}/x", "not a url {n}"], F.pmod(n, F.lit(25)))).alias("url"),
    )


def _kind_sql(i: int) -> str:
    return f"list_extract([{', '.join(sql_text(k[i]) for k in KINDS)}], ((doc_id * 7 + coalesce(n_chars, 0)) % {len(KINDS)} + 1)::int)"


FINDINGS_SQL = f"""findings as (select doc_id as ord, {_kind_sql(0)} as type, {_kind_sql(1)} as severity, {_kind_sql(2)} as category, {_kind_sql(3)} as validation_status,
  {pick_sql(PATHS, '(doc_id % 40)')} as source, (coalesce(n_chars, 0) % 5 + 1)::int as line, 'v-' || md5((doc_id % 90)::varchar) as value,
  case when doc_id % 3 = 0 then '' else {pick_sql(["https://h{n}.shop.example.com/p?id=4&token={h}", "http://api.example.net/v{n}/x", "not a url {n}"], '(doc_id % 25)')} end as url from documents)"""
