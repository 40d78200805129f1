"""Source files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorfold.operators import exclusions
from mirrorfold.sources.ignore import ignored, rules

# Extension to language
LANGUAGES = {
    "c": "c", "h": "c", "cs": "csharp", "dart": "dart", "fs": "fsharp", "fsx": "fsharp", "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "php": "php", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx", "osp": "osprey", "ospml": "osprey",
}


def scan(spark: SparkSession, root: str, below: str = "", ignore: dict[str, str] | None = None, dependencies: bool = False) -> DataFrame:
    """path, language, text, skipped: registered files below `root`; ignore maps a folder to its rules.

    Bytes that are no UTF-8, minified files and excluded paths carry their reason in `skipped` and no text.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{below}".rstrip("/"))
    base = root.split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")
    base = "/" + base.lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    named = read.select(path.alias("path"), "content").withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.col("extension")]
    known = named.withColumn("language", language).where(F.col("language").isNotNull())
    every = [r for folder, text in sorted((ignore or {}).items()) for r in rules(text, folder)]
    if every:
        out = F.udf(lambda p: ignored(p, every), T.BooleanType())
        known = known.where(~out("path"))  # a row a file, before any content is looked at
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    told = known.withColumn("text", decoded)
    reason = F.when(exclusions.excluded(F.col("path"), dependencies), "excluded").when(F.col("text").isNull(), "not_utf8").when(exclusions.minified(F.col("path"), F.col("text")), "minified")
    return told.withColumn("skipped", reason).select("path", "language", F.when(F.col("skipped").isNull(), F.col("text")).alias("text"), "skipped")
