"""Silver tables derived from the star-schema test tables, in the library's own shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions import text as tx


#: Each turn becomes a row for every word.
TURNS_PER_TASK = 4_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "conversations", "pages"):
        df = spread(df)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def spread(df: DataFrame) -> DataFrame:
    """Give every core text to work on when the input is too small for its splits to do so.

    A small file may be one row group, hence one task, however many cores wait. Inputs larger than one
    split per core are left alone: at scale this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (128 << 20) else df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, idx, role, text, tokens) of user and assistant turns with text."""
    c = load(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    c = scale.with_blocks(c, ["conv_id"], "turn").where(F.length(F.trim("text")) > 0)
    if scale.BLOCK not in c.columns:  # the words of a conversation are counted, ranked and joined where its turns are
        c = scale.grouped(c, ["conv_id"], spark.read.parquet(f"{sf_dir}/conversations.parquet").count(), TURNS_PER_TASK)
    c = scale.scan(c, ["conv_id"], ["turn"], idx=scale.row_index())
    return c.withColumn("tokens", tx.estimate_tokens("text"))


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turns with conversational moves written into the text by position, because the
    table's invented prose has none: thanks, corrections, questions, code, re-asked prompts."""
    t = turns(spark, sf_dir)
    t = scale.scan(t, ["conv_id"], ["idx"], first_text=scale.last_known(F.when(F.col("idx") == 0, F.col("text"))))
    n = F.pmod(F.col("conv_id") + F.col("idx"), F.lit(9))
    user = (F.when(n == 0, F.lit("Thanks!")).when(n == 1, F.lit("continue"))
            .when(n == 2, F.concat(F.lit("No, that's wrong. "), "text")).when(n == 3, F.concat(F.lit("Also "), "text"))
            .when(n == 4, F.concat("text", F.lit("?"))).when(n == 5, F.concat(F.lit("```py\n"), "text", F.lit("\n```")))
            .when(n == 6, F.col("first_text")).otherwise(F.col("text")))
    reply = (F.when(n == 0, F.concat(F.lit("Sorry, "), "text")).when(n == 1, F.concat(F.lit("I cannot do that. "), F.substring("text", 1, 80)))
             .when(n == 2, F.lit("Which one do you mean?")).when(n == 3, F.concat(F.lit("```py\nx = 1\n``` "), "text"))
             .otherwise(F.col("text")))
    t = t.withColumn("text", F.when(F.col("role") == "user", user).otherwise(reply)).drop("first_text")
    return t.withColumn("tokens", tx.estimate_tokens("text"))


TOOL_OF = {"view": "Read", "click": "Write", "purchase": "mcp__shop__buy", "error": "Bash", "signup": "Grep"}


def events(spark: SparkSession, sf_dir: str) -> int:
    """How many events there are; the files' footers tell."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event history read as one agent session: every event is a call with one tool use."""
    e = scale.with_blocks(load(spark, sf_dir, "events"), ["user_id"], "ts")
    names = F.create_map(*[F.lit(x) for kv in TOOL_OF.items() for x in kv])
    keep = [scale.BLOCK] if scale.BLOCK in e.columns else []
    e = scale.grouped(e, ["user_id", *keep], events(spark, sf_dir))
    e = e.select(
        *keep, F.col("user_id").alias("session_id"), "ts", "event_id", "event_type", F.col("props").alias("input_sig"),
        F.floor(F.col("value") * 100).cast("bigint").alias("growth"),
        F.floor(F.col("value") / 10).cast("bigint").alias("result_hash"),
        names[F.col("event_type")].alias("name"),
        ((F.col("event_type") == "error") | (F.col("event_id") % 13 == 0)).alias("is_error"),
        (F.col("event_type") == "signup").cast("bigint").alias("is_instr"),
        (F.col("event_id") % 50 == 0).cast("bigint").alias("is_compact"),
        F.floor("value").cast("bigint").alias("output"),
        F.when(F.col("event_id") % 40 == 0, "b").otherwise("a").alias("model"),
        F.lit(False).alias("is_side"), F.lit("main").alias("ctx_key"),
    )
    order = ["ts", "event_id"]
    e = scale.scan(e, ["session_id"], order, k=scale.row_index(), epoch=scale.running_sum(F.col("is_compact")),
                   instr=scale.running_sum(F.col("is_instr")))
    e = scale.scan(e, ["session_id", "epoch"], order, _sum=scale.running_sum(F.col("growth")))
    e = e.withColumn("context", F.col("_sum") + 5000).drop("_sum")
    e = scale.scan(e, ["session_id"], order, prev_ctx=scale.previous(F.col("context")), prev_ts=scale.previous(F.col("ts")))
    warm = F.col("ts") - F.col("prev_ts") < F.expr("INTERVAL '1' HOUR")
    read = F.when(F.col("prev_ctx").isNull() | (F.col("context") < F.col("prev_ctx")), 0).when(warm, F.col("prev_ctx")).otherwise(0)
    e = e.withColumn("cache_read", read.cast("bigint")).drop("prev_ctx", "prev_ts")
    e = e.withColumn("cache_write", F.col("context") - F.col("cache_read"))
    return e.withColumns({"cache_write_1h": F.when(F.col("event_id") % 3 == 0, F.col("cache_write")).otherwise(F.lit(0)),
                          "input": F.lit(0).cast("bigint")})


def calls_with_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls, every seventh event's being a sub-agent's. Each context counts its calls from 0."""
    c = calls(spark, sf_dir).withColumn("is_side", F.col("event_id") % 7 == 0)
    c = c.withColumn("ctx_key", F.when(F.col("is_side"), "side:a1").otherwise("main"))
    return scale.scan(c.drop("k"), ["session_id", "ctx_key"], ["ts", "event_id"], k=scale.row_index())


def tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return c.withColumns({
        "path": F.when(F.col("name").isin("Read", "Write"), F.concat(F.lit("/p/"), F.regexp_extract("input_sig", r"([0-9]+)", 1))),
        "has_result": F.col("event_id") % 17 != 0,
        "result_tokens": F.when(F.col("event_id") % 17 != 0, F.col("growth")).otherwise(F.lit(0)),
        "is_error": F.col("is_error") & (F.col("event_id") % 17 != 0),
        "has_text": F.col("event_id") % 5 == 0,
        "images": (F.col("event_id") % 19 == 0).cast("bigint"),
    }).withColumn("text_tokens", F.col("result_tokens")).withColumn("read_range", F.lit(""))


def chat_segments(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, call_terms, calls) of chats: each reply is a call that re-reads all earlier turns."""
    reply = F.col("role") == "assistant"
    t = t.withColumn("terms", tx.distinctive_terms("text"))
    t = scale.scan(t, ["conv_id"], ["idx"], replies=scale.running_sum(reply.cast("bigint")),
                   before=scale.running_sum(F.col("tokens"), inclusive=False))
    t = t.withColumnRenamed("conv_id", "session_id")
    keep = [scale.BLOCK] if scale.BLOCK in t.columns else []
    segs = t.select(*keep, "session_id", F.col("idx").alias("seg_id"), F.when(reply, "assistant_text").otherwise("user_prompt").alias("kind"),
                    F.col("tokens").cast("double").alias("tokens"), F.col("replies").alias("birth"), "terms")
    outs = t.where(reply)
    terms = outs.select("session_id", (F.col("replies") - 1).alias("k"), F.explode("terms").alias("term"))
    cs = outs.select(*keep, "session_id", (F.col("replies") - 1).alias("k"), F.col("before").alias("context"))
    return segs.where("tokens > 0"), terms, cs


def latest_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
