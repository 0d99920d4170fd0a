"""Array archives (``.npy``, ``.npz``) as rows of key, shape and values in chunks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, key string, shape array<long>, at long, values array<double>"


def read_arrays(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """Every array of the archives below ``path``: a row for each ``chunk`` of its values in row-major order, ``at`` the place of the first.

    A file is one task's work and, as Spark reads it, at most 2 GB; the rows it becomes are bounded by ``chunk``. An empty array has one row
    without values. Arrays that aren't numeric, and pickled ones, are an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")

    def arrays(name: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
        loaded = np.load(io.BytesIO(content), allow_pickle=False)
        if isinstance(loaded, np.ndarray):
            yield name.rsplit("/", 1)[-1].removesuffix(".npy"), loaded
        else:
            yield from ((key, loaded[key]) for key in loaded.files)  # one array at a time is unpacked

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for key, array in arrays(name, content):
                    flat = array.reshape(-1)
                    for at in range(0, max(1, flat.size), chunk):
                        yield pd.DataFrame({"path": [name], "key": [key], "shape": [list(array.shape)], "at": [at], "values": [flat[at : at + chunk].astype(np.float64)]})

    return files.mapInPandas(rows, SCHEMA)
