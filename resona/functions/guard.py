"""Guard for ad-hoc SQL texts, as columns so that a whole log of texts can be audited."""

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from resona.functions.text import strip

# Words that refuse a text, patterns that look like an injection, and the reasons.
BANNED_WORDS = (
    "DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "GRANT", "REVOKE",
    "EXECUTE", "SHUTDOWN", "KILL",
)
INJECTIONS = (r"UNION\s+ALL", r"1\s*=\s*1", r"OR\s+1\s*=\s*1")
VALID = "Valid SQL query"
NOT_SELECT = "Only SELECT queries are allowed"
INJECTION = "Potential SQL injection detected"


def sql_reason(text: Column) -> Column:
    """Why a text is refused, or that it is valid; the first rule that applies wins.

    The test is on words, not syntax: a banned word inside a string literal refuses the text too.
    """
    upper = strip(F.upper(text))
    banned = [
        F.when(upper.rlike(rf"\b{word}\b"), rf"Dangerous operation detected: \b{word}\b")
        for word in BANNED_WORDS
    ]
    injected = reduce(Column.__or__, [upper.rlike(p) for p in INJECTIONS])
    return F.coalesce(
        *banned,
        F.when(~F.startswith(upper, F.lit("SELECT")), NOT_SELECT),
        F.when(injected, INJECTION),
        F.lit(VALID),
    )


def check_sql(spark: SparkSession, text: str) -> tuple[bool, str]:
    reason = spark.range(1).select(sql_reason(F.lit(text))).first()[0]
    return reason == VALID, reason
