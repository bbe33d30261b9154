"""Question sets as JSON, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A question with its sessions, as the long-memory question sets have them.
QUESTIONS = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_sessions array<array<struct<role:string,content:string>>>, "
    "haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of questions (or several files of them)."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def turns(questions: DataFrame) -> DataFrame:
    """question_id, session, date, turn, role and text: a row for each turn."""
    each = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    sessions = questions.select("question_id", F.explode(each).alias("s"))
    return sessions.select("question_id", F.col("s.id").alias("session"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("turn", "t")).select("question_id", "session", "date", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))


def question_day(x: F.Column) -> F.Column:
    """The day of "2023/05/20 (Sat) 02:21"; null for what is none."""
    return F.to_date(F.try_to_timestamp(F.trim(F.substring_index(x, " (", 1)), F.lit("yyyy/MM/dd")))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
