"""Names in compatibility form, for which Spark has no function; texts go to Python in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Text in normalisation form KC: compatibility characters as what they stand for, accents composed."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def file_key(stem: Column) -> Column:
    """What names of files are paired by: form KC, case folded, runs of anything but plain letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(_casefolded(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
