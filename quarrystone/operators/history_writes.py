"""Writes to the chat history, each as the table after it: users, sessions and messages (see ``history`` for their columns).

A caller stores the result as a table's next version.  Ids and times are given; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import chat_title

#: Schema constants: column types of the stored tables, and by what each is sorted when it is written.
USERS = "user_id bigint, email string, username string, role string, created_at timestamp_ntz"
SESSIONS = "session_id bigint, user_id bigint, title string, created_at timestamp_ntz, updated_at timestamp_ntz"
MESSAGES = "message_id bigint, session_id bigint, role string, content string, sources_json string, metadata_json string, created_at timestamp_ntz"
FEEDBACK = "feedback_id bigint, message_id bigint, session_id bigint, rating string, comment string, created_at timestamp_ntz"
SORTED_BY = {"users": ["user_id"], "sessions": ["updated_at", "session_id"], "messages": ["session_id", "created_at", "message_id"], "feedback": ["message_id"]}


def with_schema(table: DataFrame, schema: str) -> DataFrame:
    """A table of an older version with the columns of ``schema``: missing ones are added as null, others are dropped."""
    wanted = table.sparkSession.createDataFrame([], schema).schema
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def fold_case(name: Column) -> Column:
    """ASCII letters in lower case: names that differ in them only are one."""
    return F.translate(F.trim(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def add_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users with those of ``new`` whose id, e-mail and name are not taken; of new ones that clash the smallest id is added."""
    fields = {"user_id": F.col("user_id").cast("string"), "email": fold_case(F.col("email")), "username": fold_case(F.col("username"))}
    fresh = new.withColumns({f"own_{k}": v for k, v in fields.items()})
    for name in fields:
        taken = users.select(fields[name].alias(f"own_{name}")).filter(F.col(f"own_{name}").isNotNull()).distinct()
        first = Window.partitionBy(f"own_{name}").orderBy("user_id")
        fresh = fresh.join(taken, f"own_{name}", "left_anti").withColumn("nth", F.when(F.col(f"own_{name}").isNull(), 1).otherwise(F.row_number().over(first))).filter("nth = 1")
    return users.unionByName(fresh.select(*users.columns))


def find_users(users: DataFrame, names: DataFrame) -> DataFrame:
    """(name, user columns): the user whose e-mail or name is one of ``names`` (name), whatever the case of its letters."""
    told = users.withColumn("known", F.explode(F.array_distinct(F.array(fold_case(F.col("email")), fold_case(F.col("username"))))))
    return names.join(told, fold_case(F.col("name")) == F.col("known")).drop("known")


def set_roles(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with the roles of ``changes`` (user_id, role); a user that is named twice gets the greater role name."""
    new = changes.groupBy("user_id").agg(F.max("role").alias("new_role"))
    return users.join(new, "user_id", "left").withColumn("role", F.coalesce("new_role", "role")).select(*users.columns)


def add_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after ``new`` messages: those of unknown sessions are dropped, ids that exist are not added again, a
    session is as new as its latest message, and one without a title gets it from its first question."""
    fresh = new.join(sessions.select("session_id"), "session_id", "left_semi").join(messages.select("message_id"), "message_id", "left_anti").dropDuplicates(["message_id"])
    asked = F.min(F.when(F.col("role") == "user", F.struct("created_at", "message_id", "content")))["content"]
    touched = fresh.groupBy("session_id").agg(F.max("created_at").alias("latest"), asked.alias("asked"))
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", chat_title("asked")).otherwise(F.col("title"))
    after = sessions.join(touched, "session_id", "left").withColumns({"updated_at": F.greatest("updated_at", "latest"), "title": F.when(F.col("asked").isNotNull(), title).otherwise(F.col("title"))})
    return after.select(*sessions.columns), messages.unionByName(fresh.select(*messages.columns))


def rename_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions with the titles and times of ``changes`` (session_id, new_title, at); blank titles change nothing."""
    new = changes.filter(F.trim("new_title") != "").groupBy("session_id").agg(F.max(F.struct("at", "new_title")).alias("last"))
    after = sessions.join(new, "session_id", "left").withColumns({"title": F.coalesce("last.new_title", "title"), "updated_at": F.greatest("updated_at", "last.at")})
    return after.select(*sessions.columns)
