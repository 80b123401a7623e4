"""Lists and logs of an application, for all tenants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts shown for missing things.
DELETED, UNKNOWN_ERROR, NO_HISTORY = "（已删除）", "未知错误", "（无历史对话）"
USER_LABEL, OTHER_LABEL = "用户", "助手"


def page(rows: DataFrame, owner: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of each owner's rows, with place (from 1) and the owner's total.

    The filter on the rank lets Spark keep limit + offset rows of each owner before the shuffle; totals are an aggregate.
    """
    totals = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    cut = rows.withColumn("place", place).filter(F.col("place") <= limit + offset).filter(F.col("place") > offset)
    return cut.join(totals, owner)


def failed_queue(logs: DataFrame, docs: DataFrame, kinds: tuple[str, ...], n: int = 50) -> DataFrame:
    """The newest n failures of the given kinds; after that cut those without a document are left out.

    `logs`: id, event_type, is_success, ref_id, error_message, created_at; `docs`: id, file_name.
    """
    newest = logs.filter(F.col("event_type").isin(*kinds) & ~F.col("is_success")).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    named = newest.filter("ref_id is not null").join(docs.select(F.col("id").alias("ref_id"), "file_name"), "ref_id", "left")
    error = F.coalesce(F.expr("nullif(error_message, '')"), F.lit(UNKNOWN_ERROR))
    return named.select(F.col("id").alias("log_id"), "ref_id", F.coalesce("file_name", F.lit(DELETED)).alias("file_name"), error.alias("error"), "created_at")


def reset_requests(requests: DataFrame, users: DataFrame, n: int = 200) -> DataFrame:
    """The newest n requests not yet handled, with the user of their address. `users`: user_id, email."""
    open_ = requests.filter("not handled").orderBy(F.desc("created_at"), F.desc("request_id")).limit(n)
    return open_.join(users.select("email", "user_id"), "email", "left").select("request_id", "email", "user_id")


def history_text(messages: DataFrame, each: int = 200, limit: int = 600) -> DataFrame:
    """(session_id, history): role label and the start of each message, in order, and of that the last `limit` characters.

    A message adds a character or more and a line end, so the last `limit` messages of a session are enough.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    label = F.when(F.col("role") == "user", USER_LABEL).otherwise(OTHER_LABEL)
    line = F.concat(label, F.lit("："), F.substring(F.coalesce("content", F.lit("")), 1, each))
    lines = recent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("at"), line.alias("line")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return lines.select("session_id", F.when(F.length(joined) > 0, F.right(joined, F.lit(limit))).otherwise(NO_HISTORY).alias("history"))


def normalize_usage(raw: DataFrame) -> DataFrame:
    """Counts without nulls, success as 0 or 1, error texts of at most 512 characters."""
    return raw.withColumns({
        "tokens_used": F.coalesce("tokens_used", F.lit(0)),
        "duration_ms": F.coalesce("duration_ms", F.lit(0)),
        "is_success": F.coalesce("is_success", F.lit(False)).cast("int"),
        "error_message": F.substring("error_message", 1, 512),
    })


def message_log(messages: DataFrame, citations: str) -> DataFrame:
    """Messages with their place in the session and parsed citations (null where the text is no such JSON)."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    return messages.withColumns({"place": place, "citations": F.from_json("citations", citations)})


def _like(rows: DataFrame, col: str, keyword: str) -> DataFrame:
    return rows.filter(F.col(col).like(f"%{keyword.strip()}%")) if keyword.strip() else rows


def users_page(users: DataFrame, docs: DataFrame, owner: str, keyword: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """(owner, user_id, place, total, documents): a page of the users whose email holds the keyword, newest first; 0 for no documents.

    `users`: owner, user_id, email, created_at; `docs`: user_id. The total counts the owner's users that hold the keyword.
    """
    cut = page(_like(users, "email", keyword), owner, [F.desc("created_at"), F.desc("user_id")], limit, offset)
    n = docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"))
    return cut.join(n, "user_id", "left").select(owner, "user_id", "place", "total", F.coalesce("documents", F.lit(0)).alias("documents"))


def sessions_page(sessions: DataFrame, messages: DataFrame, owner: str, keyword: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """(owner, session_id, place, total, preview): a page of the sessions that are not deleted, last updated first.

    The keyword is looked up in titles; the preview is the start of the last assistant message in one line, or empty.
    `sessions`: owner, session_id, title, is_deleted, created_at, updated_at; `messages`: session_id, role, content, created_at, id.
    """
    order = [F.desc("updated_at"), F.desc("created_at"), F.desc("session_id")]
    cut = page(_like(sessions.filter("not is_deleted"), "title", keyword), owner, order, limit, offset)
    said = messages.filter("role = 'assistant'").withColumn("content", F.substring(F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 60))
    last = said.groupBy("session_id").agg(F.max(F.struct("created_at", "id", "content"))["content"].alias("preview"))
    return cut.join(last, "session_id", "left").select(owner, "session_id", "place", "total", F.coalesce("preview", F.lit("")).alias("preview"))
