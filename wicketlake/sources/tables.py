"""Lazy access to the driver tables and the adapter views built on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wicketlake.session import emptied, ensure_checkpoint_dir, freed_shuffles, scratch_path
from wicketlake.sources import views
from wicketlake.sources.versioned import files_at, fingerprint

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders of written derived tables, by store folder, name and source state.
_DERIVED: dict[tuple[str, str, str], str] = {}
#: Layout and contents of the stored tables; a change of either takes a new name.
STORE_FORMAT = "silver-1"


class Tables:
    """Driver tables and the silver layer built from them.

    Driver tables are lazy scans. Silver tables are stored as Parquet under the
    shared checkpoint folder, one store per source folder, and scanned from
    there: later filters and column selections reach that scan, and no query
    derives the balls anew. Every ``Tables`` looks at the listing of the source
    files once: deliveries, match cards and match sums take in added files
    (``wicketlake.sources.layers``), and tables derived from them are written
    again when a source has changed. An unchanged store is found by the next
    application too.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._fingerprints: dict[str, str] = {}

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def store(self) -> str:
        """The folder of this source folder's stored tables."""
        name = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:16]
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/wicketlake/{STORE_FORMAT}-{name}"

    def fingerprint(self, *names: str) -> str:
        """The state of source tables: their files' paths, sizes and times."""
        for name in names:
            if name not in self._fingerprints:
                self._fingerprints[name] = fingerprint(files_at(self.spark, f"{self.sf_dir}/{name}.parquet"))
        return " ".join(f"{name}={self._fingerprints[name]}" for name in names)

    def layer(self, name: str, build: Callable[[], DataFrame], *sources: str) -> DataFrame:
        """The derived table ``name``, written for the present state of its
        ``sources`` (default: those of the silver layer) on first use."""
        key = (self.store, name, self.fingerprint(*(sources or ("lineitem", "orders"))))
        if key not in _DERIVED:
            path = f"{self.store}/derived/{name}-{hashlib.sha256(key[2].encode()).hexdigest()[:16]}"
            try:
                return self._found(key, path)
            except AnalysisException:  # not there yet
                scratch = scratch_path(self.spark, f"silver-{name}")
                rows = build()
                with freed_shuffles(self.spark):
                    rows.write.parquet(scratch)
                for spent in getattr(rows, "spent", ()):
                    emptied(spent)
                # The pointer comes last, so a failed build leaves none.
                self.spark.createDataFrame([(scratch,)], "folder string").coalesce(1).write.mode("overwrite").parquet(path)
                _DERIVED[key] = scratch
        return self.spark.read.parquet(_DERIVED[key])

    def _found(self, key: tuple[str, str, str], path: str) -> DataFrame:
        _DERIVED[key] = self.spark.read.schema("folder string").parquet(path).first()[0]
        return self.spark.read.parquet(_DERIVED[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def deliveries(self) -> DataFrame:
        from wicketlake.sources import layers
        return layers.current(self, "deliveries").drop(*views.ORDER_COLUMNS)

    @cached_property
    def matches(self) -> DataFrame:
        from wicketlake.sources import layers
        return views.matches_from_sums(layers.current(self, "match_sums"))

    @cached_property
    def live(self) -> DataFrame:
        return views.live(self.raw("events"))

    @cached_property
    def venues(self) -> DataFrame:
        return views.venues(self.matches)

    @cached_property
    def clean_matches(self) -> DataFrame:
        from wicketlake.plans import silver
        return self.layer("clean_matches", lambda: silver.transform_matches(self.matches))

    @cached_property
    def cards(self) -> DataFrame:
        from wicketlake.sources import layers
        return layers.current(self, "cards")

    @cached_property
    def players(self) -> DataFrame:
        from wicketlake.plans import silver
        return self.layer("players", lambda: silver.players_from_cards(self.cards, self.matches))

    @cached_property
    def team_stats(self) -> DataFrame:
        from wicketlake.operators import aggregates
        return self.layer("team_stats", lambda: aggregates.team_stats(self.deliveries, self.clean_matches))

    @cached_property
    def dirty_orders(self) -> DataFrame:
        return views.dirty_orders(self.raw("orders"))

    @cached_property
    def duplicated_orders(self) -> DataFrame:
        return views.duplicated_orders(self.raw("orders"))
