"""A newer model in a running stream: each batch pins its version."""

import uuid

import pytest

from moodline.operators import naive_bayes as nb
from moodline.operators.joins import materialize
from moodline.sources.model_store import ModelStore
from moodline.streaming import jobs as J

SCHEMA = "conv_id long, turn long, text string"
ROWS = [(1, t, x) for t, x in enumerate(["good", "hate it", None, "", "unknown", "ok fine bad", "good bad"])]


def model(spark, alpha):
    m = nb.fit(spark.createDataFrame([(1, "good fine", 2), (2, "bad hate", 0), (3, "ok", 1)],
                                     "doc_id long, text string, label int"), alpha=alpha)
    m.weights = materialize(m.weights)
    return m


class Job:
    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.name = spark, str(tmp_path / "in"), f"change-{uuid.uuid4().hex}"
        self.store = ModelStore(spark, str(tmp_path / "models"))

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, **kw):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        return {r["turn"]: r for r in J.score_latest_stream(stream, self.store, "m", self.name, **kw).collect()}

    @property
    def base(self):
        return J.shared_path(self.spark, f"streams/{self.name}")


def expected(spark, m, rows):
    batch = spark.createDataFrame(rows, SCHEMA)
    return {r["turn"]: tuple(r) for r in J.score_texts(m, batch).collect()}


def test_each_row_names_its_version(spark, tmp_path):
    job, models = Job(spark, tmp_path), [model(spark, a) for a in (1.0, 5.0)]
    job.store.register("m", models[0])
    job.arrive(ROWS[:3])
    job.run()
    job.store.register("m", models[1])
    job.arrive(ROWS[3:])
    got = job.run()
    assert {t: r["model_version"] for t, r in got.items()} == {t: 1 if t < 3 else 2 for t in range(7)}
    want = expected(spark, models[0], ROWS[:3]) | expected(spark, models[1], ROWS[3:])
    assert {t: tuple(r)[:-1] for t, r in got.items()} == want


def test_a_replayed_batch_uses_its_version(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.store.register("m", model(spark, 1.0))
    job.arrive(ROWS)
    first = job.run()
    job.store.register("m", model(spark, 5.0))
    # the batch failed after it was scored: its commit is gone, so it runs again
    from moodline.session import hadoop_path
    for commit in ("0", ".0.crc"):
        fs, p = hadoop_path(spark, f"{job.base}/checkpoint/commits/{commit}")
        fs.delete(p, False)
    assert job.run() == first and {r["model_version"] for r in first.values()} == {1}


def test_versions_are_looked_up_after_the_interval_only(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "models"))
    m = model(spark, 1.0)
    store.register("m", m)
    now = [0.0]
    monkeypatch.setattr(J.time, "monotonic", lambda: now[0])
    pins, folder = J.ModelPins(store, "m", 60), str(tmp_path / "pins")
    assert pins.version(0, folder) == 1
    store.register("m", m)
    now[0] = 59.0
    assert pins.version(1, folder) == 1
    now[0] = 60.0
    assert pins.version(2, folder) == 2
    assert [J.ModelPins(store, "m").version(b, folder) for b in (0, 1, 2, 10)] == [1, 1, 2, 2]


def test_without_a_complete_version_nothing_is_scored(spark, tmp_path):
    pins = J.ModelPins(ModelStore(spark, str(tmp_path / "models")), "m")
    with pytest.raises(LookupError):
        pins.version(0, str(tmp_path / "pins"))
