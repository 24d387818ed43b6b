"""Copies of files and folders between Hadoop file systems, and the state of a dataset to resume from."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources import datasets


def _target(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _target(spark, path)
    return system.exists(p)


def copied(spark: SparkSession, source: str, folder: str, *, again: bool = False) -> str:
    """Copy a file or folder into `folder` under a name made from its path; says where. What is there is not copied again."""
    name = source.rstrip("/").rsplit("/", 1)[-1]
    path = f"{folder.rstrip('/')}/{hashlib.md5(source.encode()).hexdigest()}/{name}"
    system, to = _target(spark, path)
    if system.exists(to) and not again:
        return path
    origin, p = _target(spark, source)
    if not origin.exists(p):
        raise FileNotFoundError(source)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")  # whole or not at all under the final name
    for old in (part, to):
        system.delete(old, True)
    system.mkdirs(to.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(origin, p, system, part, False, spark._jsc.hadoopConfiguration())
    system.rename(part, to)
    return path


@dataclass
class DatasetState:
    """What makes a prompt dataset again: its files, order and options."""

    files: list[str]
    order: list[str]
    options: dict

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(files: str | list[str], order: list[str], options: datasets.PromptOptions | None = None) -> DatasetState:
        return DatasetState([files] if isinstance(files, str) else list(files), list(order), asdict(options or datasets.PromptOptions()))

    @staticmethod
    def from_json(text: str) -> DatasetState:
        return DatasetState(**json.loads(text))

    def resume(self, spark: SparkSession) -> DataFrame:
        """The dataset, read from its files again: the same rows with the same numbers."""
        missing = [f for f in self.files if not exists(spark, f)]
        if missing:
            raise FileNotFoundError(f"files of the dataset are gone: {missing}")
        return datasets.prompts(spark, self.files, self.order, datasets.PromptOptions(**self.options))
