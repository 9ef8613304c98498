"""Company profiles as JSON texts: every field typed, guarded and defaulted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col

#: Text fields and their defaults, beside the number fields that the caller names. Fixed values.
TEXTS = {"longName": None, "sector": "Unknown", "industry": "Unknown", "recommendationKey": "N/A", "longBusinessSummary": ""}


def parse_profiles(raw: DataFrame, numbers: list[str], text: str = "props", default: float | None = None) -> DataFrame:
    """Columns of ``raw`` but ``text``, then ``valid``, the text fields and ``numbers``.

    A number counts only where JSON gives a number: a string, a truth value, null or a missing key becomes ``default``.
    A missing or null text becomes its default (``longName``: null). A text that is no JSON object has ``valid`` false
    and defaults throughout. Each text is parsed once.
    """
    kept = [c for c in raw.columns if c != text]
    d = raw.withColumn("__v", F.try_parse_json(C(text)))
    valid = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    field = lambda f, kind: F.try_variant_get("__v", f"$.{f}", kind)
    typed = lambda f: F.schema_of_variant(field(f, "variant"))
    number = lambda f: F.when(typed(f).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), field(f, "double"))
    word = lambda f: F.when(typed(f) == "STRING", field(f, "string"))
    return d.select(*kept, valid.alias("valid"), *[F.coalesce(word(f), F.lit(v)).alias(f) for f, v in TEXTS.items()],
                    *[F.coalesce(number(f), F.lit(default).cast("double")).alias(f) for f in numbers])
