"""Field transforms by name, and the recogniser plug-in contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .text import col

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "strip_html": text.strip_html,
    "trim": text.strip,
    "timestamp_ms_to_iso": text.epoch_to_iso,
}


def register_transform(name: str, builder: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = builder


def apply_transforms(value: Column | str, chain: str | None) -> Column:
    """Fold ``"a,b"`` into one expression. Unknown names are ignored and an
    empty value passes through."""
    start = col(value).cast("string")
    out = start
    for name in (chain or "").split(","):
        builder = TRANSFORMS.get(name.strip())
        if builder is not None:
            out = builder(out)
    return F.when(F.coalesce(start, F.lit("")) == "", start).otherwise(out)


def register_sql_functions(spark: SparkSession) -> None:
    """The same names for ``spark.sql``, as SQL expressions without Python."""
    # Fixed patterns: the ones the Column builders use.
    bodies = {
        "strip_html": "regexp_replace(v, '<[^>]+>', '')",
        "strip_ws": r"regexp_replace(v, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', '')",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")


WORD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("left", T.DoubleType()),
        T.StructField("top", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("conf", T.DoubleType()),
    ]
)

# What a recogniser returns for one image.
OCR_RESULT = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("plugin", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("quality_reasons", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(WORD)),
        T.StructField("grid_rows", T.ArrayType(T.IntegerType())),
        T.StructField("grid_columns", T.ArrayType(T.IntegerType())),
        T.StructField("table_cells", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

Recognizer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class RecognizerRegistry:
    """Recognisers by name. A member is either a ``mapInPandas`` function from
    image rows to ``OCR_RESULT`` rows or a ready table of such rows."""

    DEFAULT = "tesseract"

    def __init__(self) -> None:
        self._members: dict[str, Recognizer | DataFrame] = {}

    def register(self, name: str, member: Recognizer | DataFrame) -> None:
        self._members[name] = member

    def names(self) -> list[str]:
        return sorted(self._members)

    @classmethod
    def resolve_name(cls, config: dict | None) -> str:
        config = config or {}
        return config.get("plugin") or config.get("engine") or cls.DEFAULT

    def get(self, name: str) -> Recognizer | DataFrame:
        if name not in self._members:
            raise ValueError(f"unknown recogniser: {name}")
        return self._members[name]

    def recognize(self, images: DataFrame, config: dict | None = None) -> DataFrame:
        """OCR rows for ``images(image_id, ...)``."""
        member = self.get(self.resolve_name(config))
        if isinstance(member, DataFrame):
            return member.join(images.select("image_id").distinct(), "image_id", "left_semi")
        return images.mapInPandas(member, OCR_RESULT)
