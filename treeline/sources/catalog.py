"""Versions and embedded editions that files and listing pages name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources import fetch

#: How an index file is named: prefix, version, language, model slug.
NAME = r"^(?:.*/)?ipc_(\d{8})_([A-Za-z]{2})_(.+)\.parquet$"
#: Where versions are listed, a fixed value.
LISTING = "https://www.wipo.int/ipc/itos4ipc/ITSupport_and_download_area/"
SCHEME_NAME = r"_scheme_(\d{8})\.xml$"


def is_date(v: Column) -> Column:
    """Whether YYYYMMDD is a real date."""
    return F.try_to_date(v, "yyyyMMdd").isNotNull() & v.rlike(r"^\d{8}$")


def versions_in_html(pages: DataFrame, html: str) -> DataFrame:
    """(version): the distinct real dates among the /YYYYMMDD/ parts of listing pages."""
    v = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?<=/)(\d{8})(?=/)"), 1)).alias("version"))
    return v.where(is_date(F.col("version"))).distinct()


def local_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version) of the scheme files in a folder; empty where there is none."""
    return versions_named(_names(spark, folder, "*_scheme_*.xml"))


def remote_versions(spark: SparkSession, get: fetch.Get | None = None, url: str = LISTING) -> DataFrame:
    """(version) of the versions that the published listing names."""
    page = fetch.download(url, get=get).decode("utf-8", "replace")
    return versions_in_html(spark.createDataFrame([(page,)], "html string"), "html")


def versions_named(files: DataFrame) -> DataFrame:
    """(version) of the names (path) that are scheme files'."""
    return files.select(F.regexp_extract("path", SCHEME_NAME, 1).alias("version")).where("version <> ''").distinct()


def available_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """(version, lang, model, path) of the index files in a folder, by their names; other files are left out."""
    return indexes_named(_names(spark, folder, "ipc_*.parquet"))


def indexes_named(files: DataFrame) -> DataFrame:
    """(version, lang, model, path) of the names (path) that are index files'."""
    return files.where(F.col("path").rlike(NAME)).select(F.regexp_extract("path", NAME, 1).alias("version"), F.upper(F.regexp_extract("path", NAME, 2)).alias("lang"), F.regexp_extract("path", NAME, 3).alias("model"), "path")


def _names(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """File and folder names, listed by Hadoop, so that shared and object stores work as local folders do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(Path(folder) / pattern) if "://" not in folder else f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return spark.createDataFrame([(f.getPath().toString(),) for f in found or []], "path string")


def scheme_path(root: str, version: str, lang: str) -> str:
    return f"{root}/scheme/ipc_{version}_{lang.lower()}.parquet"


def index_path(root: str, version: str, lang: str, slug: str) -> str:
    return f"{root}/index/ipc_{version}_{lang.lower()}_{slug}.parquet"


def home(start: str, variable: str | None, marker: str = "pyproject.toml") -> str:
    """Where artifacts live: the value of an environment variable, else ``data`` beside the marker file above ``start``, else the user's cache."""
    import os

    if variable and os.environ.get(variable):
        return os.environ[variable]
    for folder in [Path(start), *Path(start).parents]:
        if (folder / marker).exists():
            return str(folder / "data")
    return str(Path(os.environ.get("XDG_CACHE_HOME", Path.home() / ".cache")) / "treeline")
