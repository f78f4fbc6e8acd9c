"""Any supported input becomes a DataFrame.

Spark's own readers take paths of any file system it knows. Formats that only single-machine libraries read (Excel,
Feather, pickle, HDF5) go through the driver and are meant for small files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import clean

#: Keys under which a JSON object may wrap its list of records.
WRAPPERS = ("data", "records", "rows", "results", "items")


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns become columns with dotted names, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        out = []
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            out += [c[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType] if isinstance(f.dataType, T.StructType) else [c]
        df = df.select(*out)
    return df


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    df = spark.read.options(multiLine=True, **options).json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            if isinstance(df.schema[key].dataType.elementType, T.StructType):
                return flatten(df.select(F.inline(key)))
            return df.select(F.explode(key).alias(key))
    return flatten(df)


#: Bytes of a file that are looked at to find its row tag.
HEAD = 1 << 16


def _head(spark: SparkSession, path: str) -> str:
    """The first ``HEAD`` bytes of a file, or of the first one that a pattern or folder holds, as text."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s for s in files.globStatus(p) or []), key=lambda s: s.getPath().toString())
    while found and found[0].isDirectory():
        found = sorted((s for s in files.listStatus(found[0].getPath()) if not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().toString())
    if not found:
        return ""
    stream = files.open(found[0].getPath())
    try:
        return bytes(stream.readNBytes(HEAD)).decode("utf-8-sig", "replace")
    finally:
        stream.close()


def read_xml(spark: SparkSession, path: str, **options) -> DataFrame:
    """Children of the root are rows; their tag is ``rowTag``, found in the first bytes of the file where not given."""
    if "rowTag" not in options:
        head = re.match(r"\s*(?:<\?.*?\?>\s*)?(?:<!(?:--.*?--|[^>]*)>\s*)*<[^>]+>\s*(?:<!--.*?-->\s*)*<([\w:.-]+)", _head(spark, path), re.S)
        options["rowTag"] = head[1] if head else "row"
    return spark.read.options(**options).xml(path)


def _pandas(read: str, needs: str) -> Callable[..., DataFrame]:
    def load(spark: SparkSession, path: str, **options) -> DataFrame:
        import pandas as pd

        try:
            frame = getattr(pd, read)(path, **options)
        except ImportError as e:
            raise ImportError(f"{needs} is needed to read {path}") from e
        if read == "read_pickle":
            frame = pd.DataFrame(frame)
        return spark.createDataFrame(frame)

    return load


def read_feather(spark: SparkSession, path: str, **options) -> DataFrame:
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path, **options))


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": lambda s, p, **o: s.read.options(**{"header": True, "inferSchema": True} | o).csv(p),
    ".tsv": lambda s, p, **o: s.read.options(**{"header": True, "inferSchema": True, "sep": "\t"} | o).csv(p),
    ".xlsx": _pandas("read_excel", "openpyxl"),
    ".xls": _pandas("read_excel", "xlrd"),
    ".parquet": lambda s, p, **o: s.read.options(**o).parquet(p),
    ".feather": read_feather,
    ".pkl": lambda s, p, unsafe=False, **o: _pickle(s, p, unsafe),
    ".pickle": lambda s, p, unsafe=False, **o: _pickle(s, p, unsafe),
    ".h5": _pandas("read_hdf", "tables"),
    ".hdf5": _pandas("read_hdf", "tables"),
    ".json": read_json,
    ".jsonl": lambda s, p, **o: flatten(s.read.options(**o).json(p)),
    ".xml": read_xml,
}


def _pickle(spark: SparkSession, path: str, unsafe: bool) -> DataFrame:
    if not unsafe:
        raise ValueError("reading a pickle runs code from it; pass unsafe=True for files you trust")
    return _pandas("read_pickle", "pandas")(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None


@dataclass
class Dataset:
    """A table with a name, an optional target, and where it came from."""

    df: DataFrame
    name: str = "dataset"
    target: str | None = None
    source: str | None = None
    options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, data, name: str | None = None, target: str | None = None, **options) -> Dataset:
        """A path, Spark or pandas frame, Arrow table, array, dict of columns or list of records."""
        if isinstance(data, DataFrame):
            return cls(clean(data), name or "dataset", target)
        if not isinstance(data, (str, os.PathLike)):
            import numpy as np
            import pandas as pd
            import pyarrow as pa

            if isinstance(data, np.ndarray):
                data = pd.DataFrame(data, columns=[f"column_{i}" for i in range(data.shape[1] if data.ndim > 1 else 1)])
            elif isinstance(data, (dict, list)):
                data = pd.DataFrame(data)
            if not isinstance(data, (pd.DataFrame, pa.Table)):
                raise TypeError(f"no way to read a {type(data).__name__}")
            return cls(clean(spark.createDataFrame(data)), name or "dataset", target)
        path = os.fspath(data)
        stem, suffix = os.path.splitext(os.path.basename(path.rstrip("/")))
        if suffix.lower() not in READERS:
            raise ValueError(f"no reader for {suffix or path!r}; there are {', '.join(READERS)}")
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        return cls(clean(READERS[suffix.lower()](spark, path, **options)), name or stem, target, path, options)
