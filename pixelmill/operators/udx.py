"""User functions over batches of rasters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def map_rasters(rasters: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` gets batches of rasters as pandas frames and returns rows keyed by image_id."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return rasters.mapInPandas(run, schema)
