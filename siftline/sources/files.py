"""Reading the files of a system's repository that tell how it is built."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftline.sources.reports import decoded

# Folders that are not looked into.
IGNORED = [".git", "target", "build", "out", "node_modules", ".idea", ".gradle"]
NAMES = "{*.java,*.xml,build.gradle,build.gradle.kts,application*.yml,application*.yaml,application*.properties,bootstrap*.yml,bootstrap*.yaml,bootstrap*.properties}"


@F.pandas_udf(StringType())
def _text(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else decoded(data))


def source_files(spark: SparkSession, folder: str, system: str | None = None) -> DataFrame:
    """``system, path, content`` of all sources, XML, build files and settings below a folder of any store, paths relative to it.

    Names are matched when the folder is listed, so no others are read; files below ignored folders or ``src/test`` are left out before they are
    decoded, as UTF-8 or the legacy code page. Without ``system`` the first folder below ``folder`` names it and paths begin after it.
    A folder without such files gives no rows; files of no bytes are passed over by Spark's reader.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = read.withColumn("below", F.substring_index("path", f"/{root}/", -1))
    if system is None:
        below = below.where(F.col("below").contains("/")).select(F.substring_index("below", "/", 1).alias("system"), F.regexp_replace("below", "^[^/]*/", "").alias("path"), "content")
    else:
        below = below.select(F.lit(system).alias("system"), F.col("below").alias("path"), "content")
    parts = F.split("path", "/")
    kept = ~F.concat(F.lit("/"), "path").contains("/src/test/") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED]))
    return below.where(kept).withColumn("content", _text("content"))
