"""Monitored hosts: a versioned dimension table and the provider lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.session import is_there

SCHEMA = "host string, label string, enabled boolean, source string, created_at timestamp"

# --- fixed values: hosts monitored from the start ----------------------------
SEEDS = {
    "api.openai.com": "OpenAI",
    "chat.openai.com": "ChatGPT",
    "chatgpt.com": "ChatGPT",
    "api.anthropic.com": "Anthropic",
    "claude.ai": "Claude",
    "console.anthropic.com": "Anthropic Console",
    "generativelanguage.googleapis.com": "Google Gemini",
    "gemini.google.com": "Google Gemini",
    "api.cohere.ai": "Cohere",
    "api.mistral.ai": "Mistral",
    "api.perplexity.ai": "Perplexity",
    "api.together.xyz": "Together AI",
    "api.groq.com": "Groq",
    "api.deepseek.com": "DeepSeek",
    "api.x.ai": "xAI Grok",
    "openrouter.ai": "OpenRouter",
    "api.fireworks.ai": "Fireworks AI",
    "huggingface.co": "Hugging Face",
    "api-inference.huggingface.co": "Hugging Face Inference",
    "copilot.microsoft.com": "Microsoft Copilot",
    "api.replicate.com": "Replicate",
}


def seed_rows(spark: SparkSession, created_at: str) -> DataFrame:
    rows = spark.createDataFrame(list(SEEDS.items()), "host string, label string")
    return rows.select("host", "label", F.lit(True).alias("enabled"),
                       F.lit("seed").alias("source"),
                       F.lit(created_at).cast("timestamp").alias("created_at"))


def normalise_host(host: Column) -> Column:
    return F.lower(F.substring_index(F.trim(host), ":", 1))


def is_valid_host(host: Column) -> Column:
    return F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(" ")) & ~F.contains(
        host, F.lit("/"))


def ensure_seeded(registry: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert the seeds that are not there yet; existing rows stay as they are."""
    return registry.unionByName(seeds.join(registry, "host", "left_anti"))


def upsert(registry: DataFrame, requests: DataFrame, created_at: Column) -> DataFrame:
    """Add hosts; one that exists gets the new label and is enabled again, its source and
    creation time stay.  Invalid hosts are left out.  ``requests``: host, label."""
    wanted = requests.select(normalise_host(F.coalesce("host", F.lit(""))).alias("host"),
                             F.trim(F.coalesce("label", F.lit(""))).alias("new_label"))
    wanted = wanted.filter(is_valid_host(F.col("host"))).withColumn(
        "new_label", F.coalesce(F.nullif(F.col("new_label"), F.lit("")), F.col("host")))
    wanted = wanted.groupBy("host").agg(F.max("new_label").alias("new_label"))
    merged = registry.join(wanted, "host", "full_outer")
    asked = F.col("new_label").isNotNull()
    return merged.select(
        "host", F.coalesce("new_label", "label").alias("label"),
        (asked | F.coalesce("enabled", F.lit(False))).alias("enabled"),
        F.coalesce("source", F.lit("user")).alias("source"),
        F.coalesce("created_at", created_at).alias("created_at"))


def remove(registry: DataFrame, hosts: DataFrame) -> DataFrame:
    gone = hosts.select(F.lower(F.trim("host")).alias("host"))
    return registry.join(gone, "host", "left_anti")


def set_enabled(registry: DataFrame, host: str, enabled: bool) -> DataFrame:
    return registry.withColumn("enabled", F.when(
        F.col("host") == host.strip().lower(), F.lit(enabled)).otherwise(F.col("enabled")))


def enabled_hosts(registry: DataFrame) -> DataFrame:
    return registry.filter("enabled").select("host", "label")


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=<number>`` below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in names
                  if n.startswith(f"{kind}=") and is_there(spark, f"{path}/{n}/_SUCCESS"))


def publish(registry: DataFrame, path: str) -> int:
    """Write a registry as the next version below ``path``; earlier versions stay as they are."""
    done = _numbers(registry.sparkSession, path, "version")
    number = done[-1] + 1 if done else 0
    registry.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    return spark.read.parquet(f"{path}/version={_numbers(spark, path, 'version')[-1]}")


def published_for(spark: SparkSession, path: str, pins: str, batch: int) -> DataFrame:
    """The version for a micro-batch: the newest when it first asks, the same one on a retry."""
    pin = f"{pins}/batch={batch}"
    if not is_there(spark, f"{pin}/_SUCCESS"):
        newest = _numbers(spark, path, "version")[-1]
        spark.range(newest, newest + 1).coalesce(1).write.mode("overwrite").parquet(pin)
    return spark.read.parquet(f"{path}/version={spark.read.parquet(pin).first()['id']}")


def listing(registry: DataFrame) -> DataFrame:
    return registry.select("host", "label", "enabled", "source", "created_at").orderBy(
        "label", "host")


def resolve_hosts(hosts: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """host -> provider for distinct raw hosts: the longest monitored suffix wins.

    Suffixes are listed per distinct host and matched by equality, so the match is a plain
    equi join.  ``strict=False`` also accepts suffixes that do not start at a dot.
    """
    known = enabled_hosts(registry).withColumnRenamed("host", "suffix")
    named = hosts.select(F.col("host")).distinct().withColumn("_bare", F.lower(
        F.substring_index("host", ":", 1)))
    if strict:
        labels = F.split("_bare", r"\.", -1)
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
            F.slice(labels, i, F.size(labels)), "."))
    else:
        suffixes = F.transform(F.sequence(F.lit(1), F.length("_bare")),
                               lambda i: F.substring(F.col("_bare"), i, F.length("_bare")))
    exploded = named.filter(F.length("_bare") > 0).select(
        "host", F.explode(suffixes).alias("suffix"))
    return exploded.join(known, "suffix").groupBy("host").agg(
        F.max_by("label", F.length("suffix")).alias("provider"))


#: Registry rows up to which the lookup is a literal in the row.
LITERAL_HOSTS = 1000


def provider_of(host: str, known: dict[str, str], strict: bool = True) -> Column:
    """Label of the longest monitored suffix of a host, or null: no join, no shuffle."""
    bare = f"lower(substring_index({host}, ':', 1))"
    if strict:
        ends = (f"transform(sequence(1, size(split({bare}, r'[.]', -1))), "
                f"i -> substring_index({bare}, '.', -(size(split({bare}, r'[.]', -1)) - i + 1)))")
    else:
        ends = f"transform(sequence(1, greatest(length({bare}), 1)), i -> substring({bare}, i))"
    labels = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = F.transform(F.expr(ends), lambda end: labels[end])
    return F.get(F.filter(named, lambda label: label.isNotNull()), F.lit(0))


def with_provider(flows: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """Keep flows to monitored hosts and name their provider.

    A registry of up to LITERAL_HOSTS rows is looked up in the row, so flows, bodies included,
    are not moved and a busy host is no hot key.  A larger one is joined: matching runs on the
    distinct hosts, and the flows meet only the short result.
    """
    rows = enabled_hosts(registry).limit(LITERAL_HOSTS + 1).collect()
    if len(rows) > LITERAL_HOSTS:
        return flows.join(resolve_hosts(flows, registry, strict), "host")
    if not rows:
        return flows.limit(0).withColumn("provider", F.lit(None).cast("string"))
    known = {r["host"]: r["label"] for r in rows}
    return flows.withColumn("provider", provider_of("host", known, strict)).filter(
        F.col("provider").isNotNull())
