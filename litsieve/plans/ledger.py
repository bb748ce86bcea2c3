"""Points of curves kept in a table, so that a sweep fits only what it has not fitted before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.operators.metrics import series
from litsieve.plans import sweep
from litsieve.plans.dataset import Dataset
from litsieve.sources.tables import fingerprint, is_written

PARAMETERS = ("sparselevel", "cost", "gamma", "k")
ROWS = (
    "sparselevel double, cost double, gamma double, k int, point double, xvar double, variable string, value double, "
    "fingerprint string, curve string, model string"
)
_AXES = {
    "feature_curve": (sweep.LEVELS, "sparselevel"),
    "learning_curve": (sweep.FRACTIONS, None),
    "cost_curve": (sweep.COSTS, "cost"),
    "gamma_curve": (sweep.GAMMAS, "gamma"),
    "k_curve": (sweep.NEIGHBOURS, "k"),
}
_READS = {"NB": ("sparselevel",), "kNN": ("sparselevel", "k"), "SVM": ("sparselevel", "cost", "gamma")}


class ResultLedger:
    """A parquet table below ``path``, partitioned by input fingerprint, curve and model.

    A row is one value of a series; the parameters that the point does not read or that are its axis are null. ``point``
    is the value asked for and ``xvar`` the value drawn, which differ for learning curves (fraction, rows). A point
    without any value, such as an empty prefix, leaves one row without variable, so it is not tried again. Points of
    another input have another fingerprint. A run that dies before its append is finished leaves no rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All rows so far; a point that two runs wrote at the same time counts once."""
        if not is_written(self.spark, self.path):
            return self.spark.createDataFrame([], ROWS)
        found = self.spark.read.schema(ROWS).parquet(self.path)
        return found.dropDuplicates(["fingerprint", "curve", "model", *PARAMETERS, "point", "variable"])

    def table(self) -> DataFrame:
        """(curve, model, parameters, point, xvar, variable, value) of every input."""
        return self.rows().filter(F.col("variable").isNotNull())

    def evaluate(
        self, data: Dataset, curve: str, model: str = "SVM", values: Sequence[float] | None = None,
        level: float = 0.92, cost: float = 2, gamma: float = 0.002, k: int = 1,
    ) -> DataFrame:
        """Rows of the asked points; only those that the table lacks are fitted, together, and appended."""
        points, axis = _AXES[curve]
        points = [float(v) for v in (points if values is None else values)]
        given = {"sparselevel": float(level), "cost": float(cost), "gamma": float(gamma), "k": int(k)}
        fixed = {p: given[p] if p in _READS[model] and p != axis else None for p in PARAMETERS}
        run = {"fingerprint": fingerprint(data.docs, data.counts), "curve": curve, "model": model}

        def own() -> DataFrame:
            same = F.lit(True)
            for name, value in {**run, **fixed}.items():
                same = same & F.col(name).eqNullSafe(F.lit(value))
            return self.rows().filter(same)

        known = {r["point"] for r in own().select("point").distinct().collect()}  # as many as were ever asked for
        missing = [p for p in points if p not in known]
        if missing:
            self._append(data, curve, model, missing, {"level": level, "cost": cost, "gamma": gamma, "k": k}, fixed, run)
        return own().filter(F.col("point").isin(points) & F.col("variable").isNotNull())

    def _append(self, data, curve, model, missing, options, fixed, run) -> None:
        drawn = sweep.prefix_sizes(data.docs, missing, data.weight) if curve == "learning_curve" else missing
        asked = self.spark.createDataFrame([(p, float(x)) for p, x in zip(missing, drawn, strict=True)], "point double, xvar double")
        # prefixes of equal size are the same rows and have the same values
        values = series(sweep.curve_metrics(data, curve, model, values=missing, **options)).dropDuplicates(["xvar", "variable"])
        types = {"k": "int"}
        columns = [F.lit(fixed[p]).cast(types.get(p, "double")).alias(p) for p in PARAMETERS]
        names = [F.lit(value).alias(name) for name, value in run.items()]
        found = asked.join(values, "xvar", "left").select(*columns, "point", "xvar", "variable", "value", *names)
        found.coalesce(1).write.mode("append").partitionBy("fingerprint", "curve", "model").parquet(self.path)
