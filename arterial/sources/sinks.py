"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_network(arcs: DataFrame, path: str) -> None:
    """``u v capacity t0`` rows in order of arc_id; one file, as line numbers
    are link numbers."""
    arcs.coalesce(1).sortWithinPartitions("arc_id").select("u", "v", "capacity", "t0").write.mode("overwrite").csv(path, sep=" ")


def write_log(log: DataFrame, path: str) -> None:
    """``iter gap change seconds`` rows, a folder for each run_id."""
    log.select("run_id", F.concat_ws(" ", "iter", "gap", "rel_change", "seconds").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


def write_flow(flow: DataFrame, path: str) -> None:
    """``from to flow`` rows, blank-separated."""
    flow.select("u", "v", "x").write.mode("overwrite").csv(path, sep=" ")


def write_demand(od: DataFrame, path: str) -> None:
    """``o d demand`` rows with six decimals, a folder for each scenario."""
    row = F.format_string("%d %d %.6f", "o", "d", "demand")
    od.select("scenario_id", row.alias("value")).write.mode("overwrite").partitionBy("scenario_id").text(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def write_percolation(frames: dict[str, DataFrame], path: str) -> None:
    """The result frames of a percolation run, by name."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").partitionBy("scenario_id").parquet(f"{path}/{name}")


def show(frame: DataFrame, rows: int = 20) -> None:
    frame.show(rows, truncate=False)
