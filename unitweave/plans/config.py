"""Settings of a condition: typed, checked, never executed; and which stored tables a change makes stale."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from unitweave.sources.tables import condition_name


@dataclass(frozen=True)
class Settings:
    """streams: (name, width); weights and truncations go stream by stream."""

    streams: tuple[tuple[str, int], ...] = (("mag", 60), ("real", 45), ("imag", 45), ("lf0", 1))
    target_weights: tuple[float, ...] = ()
    join_weights: tuple[float, ...] = ()
    join_cost_weight: float = 0.5
    truncate: tuple[int, ...] = ()
    representation: str = "epoch"
    multiepoch: int = 1
    candidates: int = 30
    preselection: str = "acoustic"
    holdout_percent: float = 0.0
    n_train: int | str = 0
    exclude: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        n = len(self.streams)
        for name in ("target_weights", "join_weights", "truncate"):
            if getattr(self, name) and len(getattr(self, name)) != n:
                raise ValueError(f"{name}: one for each of the {n} streams")
        if not 0 <= self.join_cost_weight <= 1 or not 0 <= self.holdout_percent < 100 or self.multiepoch < 1 or self.candidates < 1:
            raise ValueError("a setting is out of its range")
        if self.representation not in ("epoch", "onepoint", "twopoint", "threepoint", "sample") or self.preselection not in ("acoustic", "phone", "backoff"):
            raise ValueError("unknown representation or preselection")

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a plain dictionary; unknown names are an error."""
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        tupled = lambda v: tuple(map(tupled, v)) if isinstance(v, (list, tuple)) else v
        return cls(**{k: tupled(v) for k, v in values.items()})

    @property
    def name(self) -> str:
        return condition_name(asdict(self))


#: What has to be made anew when a setting changes; later tables follow from earlier ones.
STALE = {
    "units": {"streams", "representation", "n_train", "exclude"},
    "weighted": {"target_weights", "join_weights", "join_cost_weight", "truncate", "multiepoch", "holdout_percent"},
    "candidates": {"candidates", "preselection"},
}


def stale(old: Settings, new: Settings) -> list[str]:
    """The tables to build again, in order; nothing where nothing changed."""
    changed = {f.name for f in fields(Settings) if getattr(old, f.name) != getattr(new, f.name)}
    order = list(STALE)
    first = next((i for i, t in enumerate(order) if STALE[t] & changed), len(order))
    return order[first:]


class Project:
    """Stored tables that are made anew only where something they depend on has changed.

    A table's folder is named after the values of the settings it depends on and after the folders of the tables it is
    made from, so that a changed setting leads to other folders for what follows from it, and back to the old ones when it
    is changed back. A folder without the mark of a finished write is written again. ``built`` lists what was written."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.paths: dict[str, str] = {}
        self.built: list[str] = []

    def table(self, name: str, depends: Sequence[str], inputs: Sequence[str], build: Callable[..., DataFrame]) -> DataFrame:
        """The table ``name``: ``build`` of the tables ``inputs``, which have been asked for before, under the settings
        ``depends``."""
        if unknown := set(depends) - {f.name for f in fields(Settings)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        key = condition_name({"settings": {d: getattr(self.settings, d) for d in sorted(depends)}, "inputs": [self.paths[i] for i in inputs]})
        path = self.paths[name] = f"{self.root}/{name}-{key}"
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            build(*(self.spark.read.parquet(self.paths[i]) for i in inputs)).write.mode("overwrite").parquet(path)
            self.built.append(name)
        return self.spark.read.parquet(path)
