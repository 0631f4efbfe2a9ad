"""Unicode forms that Spark has no function for, over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def full_casefold(text: pd.Series) -> pd.Series:
    """Full case folding of the compatibility composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")
