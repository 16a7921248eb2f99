"""One labelled table through load, clean, process and export, for interactive use."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from classlens.operators import preparation, profiling
from classlens.params import JobParams
from classlens.plans import process as steps
from classlens.sources import readers, sinks


class FeatureJob:
    """Keeps the table, the splits and the fitted parameters of one job; every step is a DataFrame."""

    def __init__(self, spark: SparkSession, params: JobParams | None = None, key: str | None = None):
        self.spark = spark
        self.params = params or JobParams()
        self.key = key
        self.df: DataFrame | None = None
        self.splits: DataFrame | None = None
        self.fitted: DataFrame | None = None
        self.facts: dict[str, object] = {}
        self.path = ""

    def _note(self, name: str) -> None:
        self.facts[name] = datetime.now(timezone.utc).isoformat()

    def _table(self) -> DataFrame:
        if self.df is None:
            raise ValueError("no data loaded: call load() or use_table() first")
        return self.df

    def load(self, path: str) -> DataFrame:
        """Read a CSV file, label it by row order and keep the row number as key."""
        self.path, self.key = path, "row_number"
        self.df = readers.load_features(self.spark, path, self.params)
        self._note("load_timestamp")
        return self.df

    def use_table(self, df: DataFrame, path: str = "") -> DataFrame:
        """Take an already labelled table."""
        if self.params.target not in df.columns:
            raise ValueError(f"target column '{self.params.target}' not found")
        self.df, self.path = df, path
        self._note("load_timestamp")
        return df

    def clean(self) -> DataFrame:
        """Duplicates, sentinels and missing values; see ``plans.process.clean``."""
        self.df = steps.clean(self._table(), self.params.target, self.key, self.params.sentinel)
        self._note("clean_timestamp")
        return self.df

    def profile(self) -> DataFrame:
        return profiling.profile_features(self._table(), self.feature_names())

    def process(self, clean: bool = True, cache: str | None = None) -> DataFrame:
        """Clean, fit, scale, flag and split; with ``cache`` a stored result is reused."""
        source = self.clean() if clean else self._table()
        if cache:
            done = steps.process_cached(source, self.params, cache, self.key, clean_first=False)
        else:
            done = steps.process(source, self.params, self.key, clean_first=False)
        self.splits, self.fitted = done
        self._note("process_timestamp")
        return self.splits

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Apply the fitted parameters to new rows, batch or streaming."""
        if self.fitted is None:
            raise ValueError("nothing is fitted: call process() or load_params() first")
        return preparation.apply(df, self.fitted, keep)

    def split(self, name: str, as_vector: bool = False) -> DataFrame:
        return steps.select_split(self._splits(), name, as_vector)

    def _splits(self) -> DataFrame:
        if self.splits is None:
            raise ValueError("no splits: call process() first")
        return self.splits

    def feature_names(self) -> list[str]:
        return [c for c in self._table().columns if c not in (self.key, self.params.target)]

    def data_summary(self) -> DataFrame:
        table = self._table()
        return profiling.data_summary(
            table.drop(self.key) if self.key else table, self.params.target
        )

    def class_distribution(self) -> DataFrame:
        return profiling.class_distribution(self._table(), self.params.target)

    def class_count_check(self) -> DataFrame:
        p = self.params
        return profiling.class_count_check(
            self._table(), p.target, p.number_of_signals, p.number_of_background
        )

    def split_shapes(self) -> DataFrame:
        splits = self._splits()
        fixed = {self.key, "row_key", "split", self.params.target}
        return profiling.split_shapes(splits, len([c for c in splits.columns if c not in fixed]))

    def save_splits(self, path: str) -> str:
        return sinks.write_splits_csv(self._splits(), path)

    def export_params(self, path: str) -> str:
        if self.fitted is None:
            raise ValueError("nothing is fitted: call process() first")
        self.facts["params_path"] = path
        return sinks.write_params(self.fitted, path)

    def load_params(self, path: str) -> DataFrame:
        self.fitted = sinks.read_params(self.spark, path)
        return self.fitted

    def lineage(self) -> DataFrame:
        return sinks.lineage(self._table(), self.path, **self.facts)

    def export_lineage(self, path: str) -> str:
        return sinks.write_lineage(self.lineage(), path)
