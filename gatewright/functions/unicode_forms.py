"""The one step of normalisation that Spark lacks: Unicode's compatibility composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def nfkc(text: Column) -> Column:
    """NFKC in Arrow batches; ASCII texts cross to Python as nulls, for they don't change."""
    return F.coalesce(_nfkc(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)), text)
