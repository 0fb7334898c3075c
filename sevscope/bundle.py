"""Model bundles: signal model, cluster model and classifier under one version
(S7), committed by a manifest that is written last.

A version is a folder ``v-<name>`` that is written once. Its manifest lists
every file of the version with its length and md5 (found by a Spark job over
the files). ``load`` takes the newest committed version, or the named one, and
refuses a version without a manifest or whose files are not those it lists, so
neither a half-written nor a mixed set is ever used.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fusion, logistic

MANIFEST = "manifest"


class BundleError(ValueError):
    """A version that may not be used."""


@dataclass
class Bundle:
    version: str
    signal_model: fusion.SignalModel
    classifier: logistic.TextClassifier


def _contents(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    """(name below the version, length, md5) of its data files, in order."""
    files: DataFrame = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
                        .select(F.regexp_extract("path", r"/(v-[^/]+/.*)$", 1).alias("name"), "length",
                                F.md5("content").alias("md5")))
    rows = files.where(~F.col("name").rlike(rf"/{MANIFEST}/|/_SUCCESS$|/\.|\.crc$")).orderBy("name").collect()
    return [(r["name"], r["length"], r["md5"]) for r in rows]


def save(spark: SparkSession, path: str, signal_model: fusion.SignalModel,
         classifier: logistic.TextClassifier) -> str:
    """Write a new version below ``path`` and commit it; its name."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/{version}"
    signal_model.save(f"{folder}/signal_model")
    classifier.save(spark, f"{folder}/classifier")
    commit(spark, folder, version)
    return version


def commit(spark: SparkSession, folder: str, version: str) -> None:
    manifest = json.dumps({"version": version, "files": _contents(spark, folder)})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("errorifexists").text(
        f"{folder}/{MANIFEST}")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions below ``path``, oldest first: those whose manifest's
    writer has finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/v-*/{MANIFEST}/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().getParent().getParent().getName() for f in found or [])


def load(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    done = versions(spark, path)
    if version is None:
        if not done:
            raise BundleError(f"no committed models in {path}")
        version = done[-1]
    elif version not in done:
        raise BundleError(f"{version} is not a committed version")
    folder = f"{path.rstrip('/')}/{version}"
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()[0])
    if manifest["version"] != version or [tuple(f) for f in manifest["files"]] != _contents(spark, folder):
        raise BundleError(f"the files of {version} are not those of its manifest")
    return Bundle(version, fusion.SignalModel.load(spark, f"{folder}/signal_model"),
                  logistic.TextClassifier.load(spark, f"{folder}/classifier"))
