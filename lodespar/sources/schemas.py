"""Fixed schemas, so that a column of nulls still has its type and unknown keys are noticed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespar.functions.vocabulary import PERIODS, REMOTE, SENIORITY, SOURCES

_STRINGS = "array<string>"
COMMENT = "objectID string, author string, comment_text string, parent_id bigint, story_id bigint, created_at string"
THREAD = f"thread_id string, title string, created_at string, thread_date string, comments array<struct<{', '.join(c.replace(' ', ': ', 1) for c in COMMENT.split(', '))}>>"
EXTRACTION = f"company string, role_titles {_STRINGS}, location string, remote string, salary_min bigint, salary_max bigint, salary_currency string, salary_period string, skills {_STRINGS}, seniority string, visa_sponsor boolean"
POSTING = f"{EXTRACTION}, comment_id bigint, thread_date date, extracted_by string, thread_month string"
LABEL = f"comment_id string, split string, stratum string, company string, location string, remote string, salary_min bigint, salary_max bigint, salary_currency string, salary_period string, seniority string, skills {_STRINGS}, uncertain {_STRINGS}, note string, done boolean, drafted_by string, verified boolean"
COUNTED = ["company", "role_titles", "location", "remote", "salary_min", "salary_max", "salary_currency", "salary_period", "skills", "seniority", "visa_sponsor"]
HISTORY = "date string, thread_id string, total_posts bigint, " + ", ".join(f"{c} bigint" for c in COUNTED)
ENUMS = {"remote": REMOTE, "seniority": SENIORITY, "salary_period": PERIODS, "extracted_by": SOURCES}


def parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def conforms(df: DataFrame, schema: str = POSTING) -> DataFrame:
    """``df`` in the order and types of ``schema``. Missing or unknown columns raise at once; a value
    outside an enum, or a null where none may be, raises when the row is computed."""
    want = parsed(schema)
    missing, unknown = [f.name for f in want if f.name not in df.columns], [c for c in df.columns if c not in want.names]
    if missing or unknown:
        raise ValueError(f"missing columns {missing}, unknown columns {unknown}")
    out = []
    for f in want:
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        if f.name in ENUMS:
            c = F.when(c.isNull() | c.isin(*ENUMS[f.name]), c).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: "), c)).cast(f.dataType))
        if f.name in ("comment_id", "thread_date", "extracted_by"):
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
