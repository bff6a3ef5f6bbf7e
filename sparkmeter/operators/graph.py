"""Property graph of conversations, turns and topics as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import latest_first

MIN_K = 3


def contribute_once(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Conversations not stored yet; one row per id."""
    return incoming.dropDuplicates(["conv_id"]).join(stored.select("conv_id"), "conv_id", "left_anti")


def topic_facts(topics: DataFrame, nodes: DataFrame, agenda: DataFrame) -> DataFrame:
    """(conv_id, word, tokens): what each conversation adds to a topic; agenda-only topics add 0 tokens."""
    t = topics.join(nodes.select("conv_id", "idx", "tokens"), ["conv_id", "idx"]).groupBy("conv_id", "word").agg(F.sum("tokens").alias("tokens"))
    only = agenda.select("conv_id", "word").join(t, ["conv_id", "word"], "left_anti").withColumn("tokens", F.lit(0).cast("bigint"))
    return t.unionByName(only)


def graph_edges(nodes: DataFrame, edges: DataFrame, topics: DataFrame, agenda: DataFrame) -> DataFrame:
    """(src, dst, type, rank)."""
    turn = lambda idx: F.concat_ws(":", F.lit("turn"), "conv_id", idx)
    topic = F.concat(F.lit("topic:"), "word")
    conv = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    none = F.lit(None).cast("bigint")
    has = nodes.select(conv.alias("src"), turn("idx").alias("dst"), F.lit("HAS_TURN").alias("type"), none.alias("rank"))
    about = topics.select(turn("idx").alias("src"), topic.alias("dst"), F.lit("ABOUT").alias("type"), F.col("rank").cast("bigint").alias("rank"))
    covers = agenda.select(conv.alias("src"), topic.alias("dst"), F.lit("COVERS").alias("type"), (F.col("rank") - 1).cast("bigint").alias("rank"))
    between = edges.select(turn("src").alias("src"), turn("dst").alias("dst"), "type", none.alias("rank"))
    return has.unionByName(about).unionByName(covers).unionByName(between)


def graph_nodes(metrics: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, label, props as JSON)."""
    conv = metrics.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("id"), F.lit("Conversation").alias("label"), F.to_json(F.struct(*metrics.columns)).alias("props"))
    keep = [c for c in ("idx", "role", "tokens", "intent", "depth", "branch", "redundant", "has_code") if c in nodes.columns]
    turn = nodes.select(F.concat_ws(":", F.lit("turn"), "conv_id", "idx").alias("id"), F.lit("Turn").alias("label"), F.to_json(F.struct(*keep)).alias("props"))
    t = topic_totals(facts)
    topic = t.select(F.concat(F.lit("topic:"), "word").alias("id"), F.lit("Topic").alias("label"), F.to_json(F.struct(*t.columns)).alias("props"))
    return conv.unionByName(turn).unionByName(topic)


def topic_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("word").agg(F.count(F.lit(1)).alias("conversations"), F.sum("tokens").alias("tokens"))


def cooccurrence(agenda: DataFrame) -> DataFrame:
    """(a, b, n) over pairs of one agenda, at most seven words per conversation."""
    a = agenda.groupBy("conv_id").agg(F.array_sort(F.collect_list("word")).alias("ws"))
    p = a.select(F.posexplode("ws").alias("i", "a"), "ws").select("a", F.explode(F.expr("slice(ws, i + 2, size(ws))")).alias("b"))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def public_topics(facts: DataFrame, k: int = MIN_K, limit: int = 100) -> DataFrame:
    """Topics at least k conversations share; k can be raised, never lowered below three."""
    return topic_totals(facts).where(F.col("conversations") >= max(k, MIN_K)).orderBy(F.desc("conversations"), F.desc("tokens"), "word").limit(limit)


def public_links(agenda: DataFrame, topics: DataFrame, k: int = MIN_K) -> DataFrame:
    w = topics.select("word")
    c = cooccurrence(agenda).where(F.col("n") >= max(k, MIN_K))
    return c.join(w.withColumnRenamed("word", "a"), "a", "left_semi").join(w.withColumnRenamed("word", "b"), "b", "left_semi")


def read_back(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Every turn with its topics in rank order."""
    t = topics.groupBy("conv_id", "idx").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_t"))
    return nodes.join(t, ["conv_id", "idx"], "left").withColumn("topics", F.coalesce(F.transform("_t", lambda e: e["word"]), F.array().cast("array<string>"))).drop("_t")


def withdraw(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """Conversations left after deletion requests with the right token. Aggregates are recomputed from
    facts, so there are no counters to undo. requests: (conv_id, token)."""
    r = requests.select("conv_id", F.sha2("token", 256).alias("delete_token_hash")).distinct()
    return conversations.join(r, ["conv_id", "delete_token_hash"], "left_anti")


def intents_before_deepest(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Average depth by prompt intent over turns about each topic."""
    t = topics.select("conv_id", "idx", "word").join(nodes.where("role = 'user'"), ["conv_id", "idx"])
    return t.groupBy("word", "intent").agg(F.count(F.lit(1)).alias("turns"), F.avg("depth").alias("avg_depth"))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key of both tables."""
    return latest_first(stored.unionByName(changes), keys, [version])


# ---------------------------------------------------------------- exports


def _lit(c: Column) -> Column:
    """String literal with JSON escaping."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def conversation_cypher(nodes: DataFrame, edges: DataFrame, topics: DataFrame, agenda: DataFrame) -> DataFrame:
    """(conv_id, kind, ord, sub, statement): MERGE statements, in order within a conversation."""
    conv = F.col("conv_id").cast("string")
    turn = lambda idx: _lit(F.concat_ws(":", conv, idx))
    c = nodes.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("sub"),
                                                  F.concat(F.lit("MERGE (c:Conversation {id: "), _lit(conv), F.lit("});")).alias("statement"))
    props = F.concat(F.lit("{index: "), F.col("idx").cast("string"), F.lit(", role: "), _lit(F.col("role")), F.lit(", tokens: "), F.col("tokens").cast("string"),
                     F.lit(", intent: "), _lit(F.col("intent")), F.lit(", depth: "), F.col("depth").cast("string"), F.lit(", branch: "), F.col("branch").cast("string"), F.lit("}"))
    t = nodes.select("conv_id", F.lit(1).alias("kind"), F.col("idx").alias("ord"), F.lit(0).cast("bigint").alias("sub"),
                     F.concat(F.lit("MERGE (t:Turn {id: "), turn("idx"), F.lit("}) SET t += "), props, F.lit(" WITH t MATCH (c:Conversation {id: "), _lit(conv), F.lit("}) MERGE (c)-[:HAS_TURN]->(t);")).alias("statement"))
    about = topics.select("conv_id", F.lit(1).alias("kind"), F.col("idx").alias("ord"), (F.col("rank") + 1).cast("bigint").alias("sub"),
                          F.concat(F.lit("MATCH (t:Turn {id: "), turn("idx"), F.lit("}) MERGE (p:Topic {label: "), _lit(F.col("word")), F.lit("}) MERGE (t)-[:ABOUT {rank: "), F.col("rank").cast("string"), F.lit("}]->(p);")).alias("statement"))
    e = edges.select("conv_id", F.lit(2).alias("kind"), F.col("src").alias("ord"), F.col("dst").alias("sub"),
                     F.concat(F.lit("MATCH (a:Turn {id: "), turn("src"), F.lit("}), (b:Turn {id: "), turn("dst"), F.lit("}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b);")).alias("statement"))
    cov = agenda.select("conv_id", F.lit(3).alias("kind"), F.col("rank").cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("sub"),
                        F.concat(F.lit("MATCH (c:Conversation {id: "), _lit(conv), F.lit("}) MERGE (p:Topic {label: "), _lit(F.col("word")), F.lit("}) MERGE (c)-[:COVERS {rank: "), (F.col("rank") - 1).cast("string"), F.lit("}]->(p);")).alias("statement"))
    return c.unionByName(t).unionByName(about).unionByName(e).unionByName(cov)


def topics_cypher(topics: DataFrame, links: DataFrame) -> DataFrame:
    n = topics.select(F.lit(0).alias("kind"), F.col("word").alias("key"), F.concat(
        F.lit("MERGE (p:Topic {label: "), _lit(F.col("word")), F.lit("}) SET p += {label: "), _lit(F.col("word")), F.lit(", conversations: "), F.col("conversations").cast("string"),
        F.lit(", tokens: "), F.col("tokens").cast("string"), F.lit("};")).alias("statement"))
    l = links.select(F.lit(1).alias("kind"), F.concat_ws("|", "a", "b").alias("key"), F.concat(
        F.lit("MATCH (a:Topic {label: "), _lit(F.col("a")), F.lit("}), (b:Topic {label: "), _lit(F.col("b")), F.lit("}) MERGE (a)-[r:CO_OCCURS]->(b) SET r.count = "), F.col("n").cast("string"), F.lit(";")).alias("statement"))
    return n.unionByName(l)


def node_link_rows(nodes: DataFrame, edges: DataFrame, topics: DataFrame, agenda: DataFrame) -> DataFrame:
    """(conv_id, part, item): node and link objects as JSON rows, one conversation's graph being the rows of
    its id. Rows, not one document, so a long conversation stays distributed."""
    t = nodes.select("conv_id", F.lit("node").alias("part"), F.to_json(F.struct(F.concat(F.lit("t"), "idx").alias("id"), F.lit("turn").alias("kind"), "role", "tokens", "intent", "depth", "branch")).alias("item"))
    words = topics.select("conv_id", "word", F.lit(False).alias("g")).unionByName(agenda.select("conv_id", "word", F.lit(True).alias("g"))).groupBy("conv_id", "word").agg(F.bool_or("g").alias("agenda"))
    p = words.select("conv_id", F.lit("node").alias("part"), F.to_json(F.struct(F.concat(F.lit("p:"), "word").alias("id"), F.lit("topic").alias("kind"), F.col("word").alias("label"), "agenda")).alias("item"))
    e = edges.select("conv_id", F.lit("link").alias("part"), F.to_json(F.struct(F.concat(F.lit("t"), "src").alias("source"), F.concat(F.lit("t"), "dst").alias("target"), "type")).alias("item"))
    a = topics.select("conv_id", F.lit("link").alias("part"), F.to_json(F.struct(F.concat(F.lit("t"), "idx").alias("source"), F.concat(F.lit("p:"), "word").alias("target"), F.lit("ABOUT").alias("type"))).alias("item"))
    return t.unionByName(p).unionByName(e).unionByName(a)
