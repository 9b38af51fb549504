"""Model store (S5): versions of a weights table under
``<root>/<name>/version=<n>``.

A version is claimed by creating its claim file (one writer wins), the weights
are written next to it, and a one-row manifest (priors' counts, vocabulary
size, alpha) is written last: a version without a manifest does not exist.
Listing reads manifests only, never weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.operators.naive_bayes import NBModel
from moodline.session import hadoop_path, shared_path

MODEL_NAME = "nb_sentiment"
MANIFEST = ("name string, version int, vocab_size long, alpha double, class_docs array<long>, "
            "class_tokens array<long>")


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def for_session(cls, spark: SparkSession) -> "ModelStore":
        """The store at its fixed place in the shared folder: what one
        application registers, another one finds."""
        return cls(spark, shared_path(spark, "models"))

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/version={version}"

    def _children(self, path: str) -> list[str]:
        fs, p = hadoop_path(self.spark, path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _claimed(self, name: str) -> list[int]:
        return sorted(int(c.split("=")[1]) for c in self._children(f"{self.root}/{name}") if c.startswith("version="))

    def versions(self, name: str) -> list[int]:
        """Complete versions of a model."""
        out = []
        for v in self._claimed(name):
            fs, p = hadoop_path(self.spark, f"{self._folder(name, v)}/manifest/_SUCCESS")
            if fs.exists(p):
                out.append(v)
        return out

    def register(self, name: str, model: NBModel) -> int:
        """Write ``model`` as the next version and return its number. Nothing
        that exists is overwritten; of two writers one takes the next number."""
        version = max([0, *self._claimed(name)]) + 1
        while True:
            fs, claim = hadoop_path(self.spark, f"{self._folder(name, version)}/_claim")
            if fs.createNewFile(claim):
                break
            version += 1
        folder = self._folder(name, version)
        model.weights.write.mode("errorifexists").parquet(f"{folder}/weights")
        row = (name, version, int(model.vocab_size), float(model.alpha), list(model.class_docs),
               list(model.class_tokens))
        (self.spark.createDataFrame([row], MANIFEST).coalesce(1)
         .write.mode("errorifexists").parquet(f"{folder}/manifest"))
        return version

    def manifests(self) -> DataFrame:
        """One row per complete version of every model."""
        paths = [f"{self._folder(n, v)}/manifest" for n in self._children(self.root) for v in self.versions(n)]
        if not paths:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*paths)

    def latest(self) -> DataFrame:
        """name, latest_version, n_versions, vocab_size, alpha of the latest."""
        return self.manifests().groupBy("name").agg(
            F.max("version").alias("latest_version"), F.count(F.lit(1)).alias("n_versions"),
            F.max_by("vocab_size", "version").alias("vocab_size"),
            F.max_by("alpha", "version").alias("alpha"))

    def exists(self, names: DataFrame) -> DataFrame:
        return names.join(F.broadcast(self.manifests().select("name").distinct()), "name", "left_semi")

    def load(self, name: str, version: int | None = None) -> NBModel:
        """A registered model, ready to score (the latest version by default)."""
        found = self.versions(name)
        if not found or (version is not None and version not in found):
            raise LookupError(f"no version {version or ''} of model {name!r} in {self.root}")
        folder = self._folder(name, version or found[-1])
        m = self.spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first()
        return NBModel(weights=self.spark.read.parquet(f"{folder}/weights"), vocab_size=m["vocab_size"],
                       class_docs=tuple(m["class_docs"]), class_tokens=tuple(m["class_tokens"]), alpha=m["alpha"])
