"""Silent-shadow gate: decisions reach serving only after a recorded approval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import DEVICE_CLASS


@dataclass(frozen=True)
class ShadowGate:
    approval_id: str | None = None
    live_enabled: bool = False
    device_class: str = DEVICE_CLASS

    @property
    def live(self) -> bool:
        return bool(self.live_enabled and self.approval_id)

    @property
    def mode(self) -> str:
        return "live_closed_loop" if self.live else "silent_shadow"

    def stamp(self, df: DataFrame) -> DataFrame:
        return df.withColumn("mode", F.lit(self.mode)).withColumn("approval_id", F.lit(self.approval_id).cast("string")).withColumn(
            "device_class", F.lit(self.device_class))

    def router(self, log_path: str, serving_path: str | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function.

        Each batch overwrites its own ``batch_id`` folder, so a batch retried after a failure lands once.
        """
        def route(batch: DataFrame, batch_id: int) -> None:
            stamped = self.stamp(batch)
            stamped.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
            if self.live and serving_path:
                stamped.write.mode("overwrite").parquet(f"{serving_path}/batch_id={batch_id}")
        return route
