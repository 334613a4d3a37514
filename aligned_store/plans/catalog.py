"""The metadata tables: latest versions and marks of what is asked for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURE_METADATA
from ..sources.shared import local_frame


#: Up to so many names are told to the scan, which then skips files without them; more meet it in a join.
TOLD = 500


def named(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Rows with one of some names in a column."""
    names = list(dict.fromkeys(names))
    if len(names) <= TOLD:
        return df.where(F.col(column).isin(names))
    return df.join(local_frame(df.sparkSession, [(n,) for n in names], T.StructType([df.schema[column]])), column, "left_semi")


def latest_per_feature(metadata: DataFrame, names: Iterable[str]) -> dict[str, Row]:
    """The row of the highest version of each named feature, a null version counting lowest; no other rows are fetched."""
    fields = FEATURE_METADATA.fieldNames()
    newest = F.max_by(F.struct(*fields), F.coalesce("version", F.lit(-1))).alias("r")
    return {r.feature_name: r for (r,) in named(metadata, "feature_name", names).groupBy("feature_name").agg(newest).select("r").collect()}


def last_updated(metadata: DataFrame, tables: Iterable[str]) -> dict[str, object]:
    """High-water mark of the primary key of each named table: the highest ever written."""
    rows = named(metadata, "table_addr", tables).groupBy("table_addr").agg(F.max("last_updated").alias("mark"))
    return {r.table_addr: r.mark for r in rows.where("mark is not null").collect()}


def by_table(rows: Iterable[Row]) -> dict[tuple, list[Row]]:
    """Feature rows of one physical table and one way of alignment together, in order."""
    out: dict[tuple, list[Row]] = {}
    for r in rows:
        out.setdefault((r.table_addr, r.signal_type, r.feature_params), []).append(r)
    return out


@dataclass
class FeatureMetadata:
    """Names, and versions if they are to be pinned, as a metadata frame of a lake."""

    feature_names: list[str]
    feature_versions: list[int] | None = field(default=None)

    def get_metadata_frame(self, lake):
        if self.feature_versions is not None and len(self.feature_versions) != len(self.feature_names):
            raise ValueError("each feature needs a version")
        if self.feature_versions is None:
            found = latest_per_feature(lake.feature_metadata_frame(), self.feature_names)
            picked = [found.get(n) for n in self.feature_names]
        else:
            pairs = [(n, v) for n, v in zip(self.feature_names, self.feature_versions, strict=True)]
            kind = T.StructType([FEATURE_METADATA["feature_name"], FEATURE_METADATA["version"]])
            asked = local_frame(lake.spark, pairs, kind)
            rows = named(lake.feature_metadata_frame(), "feature_name", self.feature_names).join(asked, ["feature_name", "version"], "left_semi").collect()
            known = {(r.feature_name, r.version): r for r in rows}
            picked = [known.get(k) for k in zip(self.feature_names, self.feature_versions, strict=True)]
        if missing := [n for n, r in zip(self.feature_names, picked, strict=True) if r is None]:
            raise ValueError(f"not found: {', '.join(missing)}")
        return local_frame(lake.spark, picked, FEATURE_METADATA)
