"""Where trained models live: versions of fitted stages, models, metadata and metrics under one folder.

A version is written aside, whole, and published by one rename that fails if the name is taken. A reader lists what is
published and so never sees a version in part; versions already read stay as they are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import SparkSession


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # ---- versions ----------------------------------------------------------------------------

    def versions(self, name: str) -> list[int]:
        """Published versions of an artifact, oldest first."""
        folder = self._path(f"{self.root}/{name}")
        files = folder.getFileSystem(self._conf())
        found = files.listStatus(folder) if files.exists(folder) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v[0-9]{6}", n))

    def path(self, name: str, version: int | None = None) -> str:
        """Folder of a version, the newest one by default."""
        have = self.versions(name)
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"nothing saved at {self.root}/{name}" + (f", version {version}" if have else ""))
        return f"{self.root}/{name}/v{have[-1] if version is None else version:06d}"

    def _publish(self, name: str, write: Callable[[str], None]) -> str:
        aside = f"{self.root}/{name}/_writing-{uuid.uuid4().hex}"
        write(aside)
        plain = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(aside).toUri(), self._conf())
        while True:  # another writer may publish the same number first
            target = f"{self.root}/{name}/v{max(self.versions(name), default=0) + 1:06d}"
            try:
                files.rename(self._path(aside), self._path(target), plain)
                return target
            except Exception as e:  # noqa: BLE001
                if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                    raise

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    # ---- artifacts ---------------------------------------------------------------------------

    @property
    def model_path(self) -> str:
        return self.path("model")

    def save_pipeline(self, pipeline: PipelineModel) -> str:
        return self._publish("preprocessing", lambda path: pipeline.write().save(path))

    def load_pipeline(self, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(self.path("preprocessing", version))

    def save_model(self, model: Model) -> str:
        return self._publish("model", lambda path: model.write().save(path))

    def load_model(self, kind: type = GBTClassificationModel, version: int | None = None) -> Model:
        return kind.load(self.path("model", version))

    def save_json(self, name: str, content: dict) -> str:
        """Small documents: metadata, metrics. NaN is written as null; `saved_at` is added."""
        stamped = {**_plain(content), "saved_at": datetime.now(timezone.utc).isoformat()}
        row = self.spark.createDataFrame([(json.dumps(stamped),)], "value string")
        return self._publish(name, lambda path: row.coalesce(1).write.text(path))

    def load_json(self, name: str, version: int | None = None) -> dict:
        return json.loads(self.spark.read.text(self.path(name, version)).first().value)


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value
