"""Text brought to one form for comparison; never before spans are sought, since offsets are those of the text itself."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("string")
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """Compatibility forms composed, runs of blanks and tabs one blank; null stays null. The engine has no such form of
    its own, so this runs in Arrow batches; texts of ASCII letters alone could do without."""
    return F.regexp_replace(_nfkc(text), r"[ \t]+", " ")


def casefolded(text: Column) -> Column:
    """Case aside as strictly as it gets (ß is ss); null stays null."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    return fold(text)
