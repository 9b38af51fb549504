"""moodline: text moderation jobs (clean, label, split, train, score, report)
expressed as Spark DataFrame plans.

Every public function maps DataFrame -> DataFrame (usable with ``.transform``)
or (SparkSession, table dir) -> DataFrame for the named queries in
``moodline.plans``.
"""

__version__ = "0.1.0"
