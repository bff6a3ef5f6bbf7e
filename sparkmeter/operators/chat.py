"""Conversation analysis: keywords, intents, re-asked prompts, threads, and the billed receipt."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions import intent as it
from ..functions import text as tx
from ..functions.numbers import compute_units, energy_wh, percent
from ..llm.shared import save
from . import alike

AGENDA_SIZE = 7
USER_TOPICS, REPLY_TOPICS = 5, 3
TOP_KEYWORDS = 40
REPLY_CUES = 8
RETRY_SIMHASH_BITS = 6  # similarity 0.9 of 64 bits
RETRY_JACCARD = 4, 5
TURN = ["conv_id", "idx"]


# ---------------------------------------------------------------- words and keywords


def turn_words(turns: DataFrame) -> DataFrame:
    """Adds words (content words in order), wset (distinct, sorted) and has_code."""
    t = turns.withColumn("words", tx.content_words("text"))
    return t.withColumns({"wset": F.array_sort(F.array_distinct("words")), "has_code": tx.has_code("text")})


def word_counts(features: DataFrame) -> DataFrame:
    """(conv_id, idx, role, word, n, first_at): occurrences per turn."""
    w = features.select(*TURN, "role", F.posexplode("words").alias("p", "word"))
    return w.groupBy(*TURN, "role", "word").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first_at"))


def keywords(turns: DataFrame, counts: DataFrame, top: int = TOP_KEYWORDS) -> DataFrame:
    """(conv_id, word, score, rank). User words count most; replies only add logarithmically; words seen
    once, or only in replies fewer than three times, are left out."""
    user = F.col("role") == "user"
    ends = turns.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("user_turns"), F.min("idx").alias("first_idx"))
    c = counts.join(ends, "conv_id")
    s = c.groupBy("conv_id", "word").agg(
        F.sum(F.when(user, F.col("n")).otherwise(0)).alias("u"), F.count(F.when(user, 1)).alias("u_docs"),
        F.sum(F.when(user, 0).otherwise(F.col("n"))).alias("a"), F.first("user_turns").alias("user_turns"),
        F.bool_or(user & (F.col("idx") == F.col("first_idx"))).alias("in_first"))
    s = s.where(~((F.col("u") == 0) & (F.col("a") < 3)))
    s = s.where(~((F.col("u") == 1) & (F.col("a") == 0) & (F.col("user_turns") > 3) & ~F.col("in_first")))
    s = s.withColumn("score", 2.0 * F.col("u") + 1.5 * F.col("u_docs") + F.log1p(F.col("a").cast("double")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "word")  # top ranks are cut before the shuffle
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("conv_id", "word", "score", "rank")


def agenda(kw: DataFrame, size: int = AGENDA_SIZE) -> DataFrame:
    return kw.where(F.col("rank") <= size)


def topics(counts: DataFrame, kw: DataFrame) -> DataFrame:
    """(conv_id, idx, word, rank 0-based): scored words of each turn, five per prompt, three per reply.

    A conversation has few scored words, so they go to its turns as one map: the join is by conversation, as all before it.
    """
    scores = kw.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("_scores"))
    c = counts.join(scores, "conv_id").withColumn("score", F.try_element_at("_scores", F.col("word"))).drop("_scores").where("score IS NOT NULL")
    w = Window.partitionBy(*TURN).orderBy(F.desc("score"), "word")
    c = c.withColumn("rank", F.row_number().over(w) - 1)
    return c.where(F.col("rank") < F.when(F.col("role") == "user", USER_TOPICS).otherwise(REPLY_TOPICS)).select(*TURN, "word", "rank")


def cues(counts: DataFrame) -> DataFrame:
    """(conv_id, idx, word): all words of a prompt, the eight most frequent of a reply."""
    w = Window.partitionBy(*TURN).orderBy(F.desc("n"), "first_at")
    c = counts.withColumn("_r", F.row_number().over(w))
    return c.where((F.col("role") == "user") | (F.col("_r") <= REPLY_CUES)).select(*TURN, "word")


def language(turns: DataFrame) -> DataFrame:
    """(conv_id, language) from character counts over the first 2000 characters of every turn."""
    head = F.substring("text", 1, 2000)
    counts = [F.sum(F.length(head) - F.length(F.regexp_replace(head, chars, ""))).alias(lang) for lang, chars, _ in tx.LANGUAGE_WEIGHTS]
    c = turns.groupBy("conv_id").agg(*counts)
    scores = [(lang, F.col(lang) * F.lit(w)) for lang, _, w in tx.LANGUAGE_WEIGHTS]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best <= 0, F.lit("und"))
    for lang, s in scores:
        out = out.when(s == best, F.lit(lang))
    return c.select("conv_id", out.alias("language"))


# ---------------------------------------------------------------- re-asked prompts


def fingerprints(features: DataFrame, salt: bytes = b"") -> DataFrame:
    return features.withColumn("fp", tx.simhash64("words", tx.fallback_tokens("text"), salt))


def retries(features: DataFrame, use_simhash: bool = True) -> DataFrame:
    """(conv_id, idx, retry_of): the latest earlier prompt of the conversation that is nearly the same.

    Prompts are first collapsed to classes of equal word set (and fingerprint), so copies cost nothing.
    Pairs of similar classes come from signatures with no false negatives. The latest earlier member is an
    as-of lookup along the turn order.
    """
    keep = [scale.BLOCK] if scale.BLOCK in features.columns else []
    fp = ["fp"] if use_simhash else []
    u = features.where("role = 'user'").select(
        *keep, *TURN, *fp, F.xxhash64("conv_id").alias("group"), F.xxhash64("conv_id", "wset", *fp).alias("cls"),
        F.transform("wset", lambda w: F.xxhash64(w)).alias("words"))
    u = save(u, "prompts")  # read for signatures, for words to compare, and by the lookup; a compressed file takes less room than a checkpoint
    pairs = alike.pairs_by_words(u.select("group", F.col("cls").alias("node"), "words"), *RETRY_JACCARD)
    if use_simhash:
        prints = u.select("group", F.col("cls").alias("node"), "fp").distinct()
        pairs = pairs.unionByName(alike.pairs_by_bits(prints, RETRY_SIMHASH_BITS)).distinct()
    pairs = save(pairs.select(F.inline(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("cls2")), F.struct(F.col("b").alias("cls"), F.col("a").alias("cls2"))))), "similar")
    askers = u.where(F.size("words") >= 3)
    # a class that is alone needs only its own prompts in order
    own = askers.select(*keep, *TURN, F.col("cls").alias("cls2"), F.lit(False).alias("member"))
    other = askers.join(pairs, "cls").select(*keep, *TURN, "cls2", F.lit(False).alias("member"))
    members = u.select(*keep, *TURN, F.col("cls").alias("cls2"), F.lit(True).alias("member"))
    line = scale.scan(own.unionByName(other).unionByName(members), ["conv_id", "cls2"], ["idx", "member"],
                      j=scale.last_known(F.when(F.col("member"), F.col("idx")), inclusive=False))
    return line.where("NOT member AND j IS NOT NULL").groupBy(*TURN).agg(F.max("j").alias("retry_of"))


def intents(features: DataFrame, retry: DataFrame | None = None) -> DataFrame:
    """Adds intent (and is_first, retry_of)."""
    keep = features
    if retry is not None:
        keep = keep.join(retry, TURN, "left")
    else:
        keep = keep.withColumn("retry_of", F.lit(None).cast("bigint"))
    keep = scale.scan(keep, ["conv_id"], ["idx"], _u=scale.running_sum((F.col("role") == "user").cast("bigint")))
    keep = keep.withColumn("is_first", (F.col("role") == "user") & (F.col("_u") == 1)).drop("_u")
    user = it.user_intent("text", "tokens", F.col("retry_of").isNotNull(), "has_code", "is_first")
    return keep.withColumn("intent", F.when(F.col("role") == "user", user).otherwise(it.reply_intent("text", "tokens", "has_code")))


# ---------------------------------------------------------------- threads


THREAD_SCHEMA = "conv_id {key}, idx bigint, branch bigint, depth bigint, edge string, edge_to bigint"


#: Edge of a prompt that stays where the one before it is.
STAYS = {"correct": "CORRECTS", "continue": "CONTINUES", "ack": "REVISITS"}
CLINGING_TOKENS = 40


class _Agenda:
    """Threads of one conversation as an index from words to the threads that hold them.

    A turn costs its own words, whatever the number of threads. Kept are words by thread and, for retries, the
    place of each prompt.
    """

    def __init__(self):
        self.holders, self.known = defaultdict(set), set()
        self.depth, self.last, self.prompts = [], [], {}
        self.now = self.before = None

    def absorb(self, thread: int, topics, words) -> bool:
        """Give a thread these words; whether one of the topics is new to it."""
        new = {(thread, t) for t in topics} - self.known
        self.known |= new
        for w in words:
            self.holders[w].add(thread)
        return bool(new)

    def opened(self, idx: int, topics, words) -> int:
        self.depth.append(0)
        self.last.append(idx)
        self.absorb(len(self.depth) - 1, topics, words)
        return len(self.depth) - 1

    def chosen(self, words, clings: bool) -> int | None:
        """The thread that a prompt's words belong to: the present one if it holds any, else the one that holds most, the earliest of equals."""
        votes = Counter(t for w in words for t in self.holders.get(w, ()))
        if clings or self.now in votes:
            return self.now
        return min(votes, key=lambda t: (-votes[t], t), default=None)

    def reply(self, topics, cues) -> tuple:
        if self.before is None:
            return 0, 0, None, None
        place = self.prompts[self.before]
        self.absorb(place[0], topics, cues)
        return *place, "ANSWERS", self.before

    def prompt(self, idx: int, move: str, intent: str, clings: bool, topics, words, back) -> tuple:
        edge, to = None, self.before
        if to is None:
            self.now = self.opened(idx, topics, words)
            place = (self.now, 0)
        elif move == "topic":
            thread = self.chosen(words, clings)
            if thread is None:
                self.now, edge = self.opened(idx, topics, words), "PIVOTS"
            else:
                deeper = self.absorb(thread, topics, words)
                edge = "RETURNS" if thread != self.now else "DEEPENS" if deeper else "REVISITS"
                self.now, to, self.last[thread] = thread, self.last[thread], idx
                self.depth[thread] += deeper
            place = (self.now, self.depth[self.now])
        else:
            if move == "retry":
                to, edge = back if back in self.prompts else to, "RETRIES"
                self.now = self.prompts[to][0]
            else:
                edge = STAYS.get(intent, "REVISITS")
            place = self.prompts[to]
            if intent == "correct":
                self.absorb(place[0], topics, words)
        self.prompts[idx], self.before = place, idx
        return *place, edge, to


def threads(nodes: DataFrame, topic_rows: DataFrame, cue_rows: DataFrame) -> DataFrame:
    """(conv_id, idx, branch, depth, edge, edge_to) of every turn.

    What kind of move a turn makes is said by columns. Which thread it then joins depends on all earlier turns, so
    conversations are spread by key, sorted, and read as a stream: a task holds the words of the threads of the
    conversation it is in and its prompts' places, not its rows.
    """
    sets = topic_rows.groupBy(*TURN).agg(F.collect_list("word").alias("topics"))
    cue = cue_rows.groupBy(*TURN).agg(F.collect_list("word").alias("cues"))
    rows = nodes.select(*TURN, "role", "intent", "tokens", "retry_of").join(sets, TURN, "left").join(cue, TURN, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("topics", F.coalesce("topics", none)).withColumn("cues", F.coalesce("cues", none)).withColumn("words", F.array_union("topics", "cues"))
    move = F.when(F.col("role") != "user", "reply").when(F.col("intent") == "retry", "retry").when(F.col("intent").isin(*STAYS) | (F.size("words") == 0), "stay").otherwise("topic")
    clings = F.coalesce((F.col("intent") == "clarify") & (F.col("tokens") < CLINGING_TOKENS), F.lit(False))
    rows = rows.select(*TURN, move.alias("move"), "intent", clings.alias("clings"), "topics", "cues", "words", "retry_of")
    rows = rows.repartition("conv_id").sortWithinPartitions(*TURN)
    key = nodes.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, agenda = None, None
        for pdf in batches:
            out = []
            for c, idx, move, intent, clings, topics, cues, words, back in zip(*(pdf[x] for x in pdf.columns)):
                if agenda is None or c != conv:
                    conv, agenda = c, _Agenda()
                said = agenda.reply(topics, cues) if move == "reply" else agenda.prompt(idx, move, intent, clings, topics, words, None if pd.isna(back) else int(back))
                out.append((c, idx, *said))
            res = pd.DataFrame(out, columns=["conv_id", "idx", "branch", "depth", "edge", "edge_to"])
            yield res.astype({"edge_to": "Int64"})

    return rows.mapInPandas(run, THREAD_SCHEMA.format(key=key))


def edges(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv_id, src, dst, type). NEXT and ANSWERS follow from the order; the rest from the threads."""
    structural = placed.where("edge IS NOT NULL AND edge <> 'ANSWERS'").select("conv_id", F.col("idx").alias("src"), F.col("edge_to").alias("dst"), F.col("edge").alias("type"))
    return order_edges(nodes).unionByName(structural)


def order_edges(nodes: DataFrame) -> DataFrame:
    n = scale.scan(nodes, ["conv_id"], ["idx"], p=scale.previous(F.col("idx")), u=scale.last_known(F.when(F.col("role") == "user", F.col("idx"))))
    nxt = n.where("p IS NOT NULL").select("conv_id", F.col("p").alias("src"), F.col("idx").alias("dst"), F.lit("NEXT").alias("type"))
    ans = n.where("role = 'assistant' AND u IS NOT NULL").select("conv_id", F.col("idx").alias("src"), F.col("u").alias("dst"), F.lit("ANSWERS").alias("type"))
    return nxt.unionByName(ans)


# ---------------------------------------------------------------- receipt


def paired(turns: DataFrame) -> DataFrame:
    """Prompts, and the replies that directly follow one; later replies to the same prompt are not billed."""
    t = scale.scan(turns, ["conv_id"], ["idx"], _pr=scale.previous(F.col("role")))
    return t.where("role = 'user' OR _pr = 'user'").drop("_pr")


def receipt(turns: DataFrame) -> DataFrame:
    """(conv_id, billed_input, billed_output): every reply re-reads everything before it."""
    b = scale.scan(paired(turns), ["conv_id"], ["idx"], ctx=scale.running_sum(F.col("tokens"), inclusive=False))
    reply = F.col("role") == "assistant"
    return b.groupBy("conv_id").agg(F.sum(F.when(reply, F.col("ctx")).otherwise(0)).alias("billed_input"),
                                    F.sum(F.when(reply, F.col("tokens")).otherwise(0)).alias("billed_output"))


def exchanges(nodes: DataFrame) -> DataFrame:
    """One row per prompt with its reply, what the reply re-read, and the next prompt's intent.

    nodes need branch and intent. drag: history of other threads that the reply re-read.
    """
    p = paired(nodes)
    p = scale.scan(p, ["conv_id"], ["idx"], read=scale.running_sum(F.col("tokens"), inclusive=False),
                   n_idx=scale.following(F.col("idx")), n_role=scale.following(F.col("role")), n_tokens=scale.following(F.col("tokens")))
    # a reply belongs to its prompt's thread
    p = scale.scan(p, ["conv_id"], ["idx"], home=scale.last_known(F.when(F.col("role") == "user", F.col("branch"))))
    p = scale.scan(p, ["conv_id", "home"], ["idx"], read_home=scale.running_sum(F.col("tokens"), inclusive=False))
    replied = F.col("n_role") == "assistant"
    u = p.where("role = 'user'").withColumns({
        "reply_idx": F.when(replied, F.col("n_idx")), "reply_tokens": F.when(replied, F.col("n_tokens")),
        "reply_input": F.when(replied, F.col("read") + F.col("tokens")),
        "drag": F.when(replied, F.col("read") - F.col("read_home"))})
    u = scale.scan(u, ["conv_id"], ["idx"], next_intent=scale.following(F.col("intent")))
    keep = [scale.BLOCK] if scale.BLOCK in u.columns else []
    answered = F.col("reply_idx").isNotNull()
    u = u.select(*keep, "conv_id", "idx", "tokens", "intent", "branch", "reply_idx", "reply_tokens", "reply_input", "drag", "next_intent")
    return u.withColumns({
        "is_ack": F.col("intent") == "ack",
        "superseded": answered & (F.col("intent") != "ack") & F.coalesce(F.col("next_intent").isin("correct", "retry"), F.lit(False))})


def redundant_turns(x: DataFrame) -> DataFrame:
    """(conv_id, idx): acknowledged exchanges, superseded replies, re-asked prompts."""
    answered = F.col("reply_idx").isNotNull()
    rows = F.array_compact(F.array(
        F.when((F.col("is_ack") & answered) | (F.col("intent") == "retry"), F.col("idx")),
        F.when(answered & (F.col("is_ack") | F.col("superseded")), F.col("reply_idx"))))
    return x.select("conv_id", F.explode(rows).alias("idx"))


def optimised(x: DataFrame) -> DataFrame:
    """Replay per thread without acknowledgements and superseded answers: (conv_id, opt_input, opt_output,
    useful_user, useful_output)."""
    k = x.where(~F.col("is_ack") & ~(F.col("superseded") & (F.col("next_intent") == "retry")))
    k = k.withColumn("kept", F.when(~F.col("superseded"), F.col("reply_tokens")))
    spent = F.col("tokens") + F.coalesce("kept", F.lit(0))
    k = scale.scan(k, ["conv_id", "branch"], ["idx"], before=scale.running_sum(spent, inclusive=False))
    return k.groupBy("conv_id").agg(
        F.sum(F.when(F.col("kept").isNotNull(), F.col("before") + F.col("tokens")).otherwise(0)).alias("opt_input"),
        F.sum(F.coalesce("kept", F.lit(0))).alias("opt_output"), F.sum("tokens").alias("useful_user"))


def metrics(nodes: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """One row per conversation: everything the receipt shows, unrounded."""
    x = exchanges(nodes) if x is None else x
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    n = nodes.groupBy("conv_id").agg(
        F.count(F.when(user, 1)).alias("user_turns"), F.count(F.when(reply, 1)).alias("assistant_turns"),
        F.sum("tokens").alias("visible_tokens"), F.sum(F.when(user, F.col("tokens")).otherwise(0)).alias("user_tokens"),
        F.sum(F.when(reply, F.col("tokens")).otherwise(0)).alias("assistant_tokens"), F.max("depth").alias("max_depth"),
        F.count_distinct(F.when(user, F.col("branch"))).alias("branches"))
    units = compute_units("reply_input", "reply_tokens")
    w = x.groupBy("conv_id").agg(
        F.coalesce(F.sum("reply_input"), F.lit(0)).alias("billed_input"), F.coalesce(F.sum("reply_tokens"), F.lit(0)).alias("billed_output"),
        F.coalesce(F.sum(F.when(F.col("is_ack"), units)), F.lit(0.0)).alias("ack_units"),
        F.coalesce(F.sum(F.when(F.col("superseded"), units)), F.lit(0.0)).alias("superseded_units"),
        F.coalesce(F.sum("drag"), F.lit(0)).alias("offtopic_tokens"))
    m = n.join(w, "conv_id").join(optimised(x), "conv_id", "left").fillna(0)
    m = m.withColumns({"units": compute_units("billed_input", "billed_output"), "opt_units": compute_units("opt_input", "opt_output"),
                       "one_shot_units": compute_units("useful_user", "opt_output")})
    saved = lambda c: F.when(F.col("units") > 0, 100 * (1 - F.col(c) / F.col("units"))).otherwise(0.0)
    return m.withColumns({
        "verbosity_ratio": F.try_divide("assistant_tokens", "user_tokens"),
        "savings_pct": saved("opt_units"), "one_shot_savings_pct": saved("one_shot_units"),
        "ack_pct": percent("ack_units", "units"), "superseded_pct": percent("superseded_units", "units"),
        "offtopic_pct": percent(F.col("offtopic_tokens") * 0.25, "units"),
        "depth_efficiency": F.coalesce(F.try_divide("max_depth", "user_turns"), F.lit(0.0)),
        "energy_wh": energy_wh("units"), "energy_wh_avoidable": energy_wh(F.col("units") - F.col("opt_units"))})


def intent_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("conv_id", "intent").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- advice


def tip_inputs(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """Metrics plus the counts the tips look at."""
    def count(*names):
        return F.count(F.when(F.col("intent").isin(*names), 1))

    c = nodes.groupBy("conv_id").agg(
        count("ack").alias("n_ack"), count("correct", "retry").alias("n_redo"), count("continue").alias("n_continue"),
        count("followup_question").alias("n_followup"), F.sum(F.when(F.col("intent") == "context", F.col("tokens")).otherwise(0)).alias("paste_tokens"),
        F.min(F.when((F.col("role") == "user") & (F.col("intent") == "context"), F.col("idx"))).alias("paste_idx"))
    later = nodes.join(c.select("conv_id", "paste_idx"), "conv_id").where("role = 'assistant' AND idx > paste_idx") \
        .groupBy("conv_id").agg(F.count(F.lit(1)).alias("later_replies"))
    return m.join(c, "conv_id").join(later, "conv_id", "left").fillna(0, ["later_replies"])


def tips(t: DataFrame) -> DataFrame:
    """(conv_id, code, weight, n), to be shown heaviest first."""
    paste = F.least(F.lit(60.0), F.col("paste_tokens") * F.col("later_replies") / F.greatest(F.lit(1), "billed_input") * 100)
    rows = [
        ("ack", F.col("ack_pct"), F.col("n_ack"), F.col("n_ack") > 0),
        ("redo", F.col("superseded_pct"), F.col("n_redo"), F.col("n_redo") > 0),
        ("pivot", F.col("offtopic_pct"), F.col("branches"), F.col("branches") > 1),
        ("paste", paste, F.col("later_replies"), F.col("paste_idx").isNotNull()),
        ("verbose", F.lit(10.0), F.col("assistant_tokens"), (F.coalesce("verbosity_ratio", F.lit(0.0)) > 8) & (F.col("assistant_tokens") > 1500)),
        ("continue", F.lit(5.0), F.col("n_continue"), F.col("n_continue") >= 2),
        ("underspecified", F.lit(5.0), F.col("n_followup"), F.col("n_followup") >= 2),
        ("long", F.lit(5.0), F.col("user_turns"), F.col("user_turns") > 20),
    ]
    a = F.array(*[F.struct(F.lit(code).alias("code"), w.cast("double").alias("weight"), n.cast("bigint").alias("n"), show.alias("show")) for code, w, n, show in rows])
    return t.select("conv_id", F.inline(a)).where("show").drop("show")


def _ordered_distinct(df: DataFrame, keys: list[str], order: list[str], limit: int, name: str) -> DataFrame:
    """First ``limit`` distinct words per key in order of first appearance, as an array of that size."""
    first = df.groupBy(*keys, "word").agg(F.min(F.struct(*order)).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_o", "word")
    top = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "word"))), lambda e: e["word"]).alias(name))


def prompt_skeleton(nodes: DataFrame, topic_rows: DataFrame, agenda_rows: DataFrame, redundant: DataFrame, languages: DataFrame) -> DataFrame:
    """(conv_id, goal, details, constraints, wants_code, target_tokens, prompt_template)."""
    by_branch = nodes.groupBy("conv_id", "branch").agg(F.sum("tokens").alias("t"), F.min("idx").alias("i"))
    main = by_branch.groupBy("conv_id").agg(F.max_by("branch", F.struct("t", -F.col("i"))).alias("main"))
    users = nodes.where("role = 'user'").select(*TURN, "intent", "branch").join(main, "conv_id")
    first = users.where("branch = main").groupBy("conv_id").agg(F.min("idx").alias("first_idx"))
    t = topic_rows.join(users, TURN).join(first, "conv_id")
    opening = t.where("idx = first_idx").select("conv_id", "word", F.lit(0).alias("o"), F.col("rank").cast("bigint").alias("rank"))
    tail = agenda_rows.select("conv_id", "word", F.lit(1).alias("o"), F.col("rank").cast("bigint").alias("rank"))
    goal = _ordered_distinct(opening.unionByName(tail), ["conv_id"], ["o", "rank"], 3, "goal")
    words = F.coalesce("goal", F.array().cast("array<string>"))
    t = t.join(goal, "conv_id", "left")
    new = ~F.array_contains(words, F.col("word"))
    details = _ordered_distinct(t.where((F.col("branch") == F.col("main")) & (F.col("idx") > F.col("first_idx")) & (F.col("intent") != "correct") & new), ["conv_id"], ["idx", "rank"], 6, "details")
    limits = _ordered_distinct(t.where(F.col("intent").isin("correct", "clarify") & new), ["conv_id"], ["idx", "rank"], 5, "constraints")
    others = _ordered_distinct(t.where("branch <> main"), ["conv_id", "branch"], ["idx", "rank"], 3, "words")
    others = others.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("branch", "words"))), lambda e: F.array_join(e["words"], ", ")).alias("others"))
    useful = nodes.where("role = 'assistant'").join(redundant.select(*TURN).distinct(), TURN, "left_anti")
    ranks = scale.value_ranks(useful, ["conv_id"], "tokens")
    mid = F.floor(F.col("total") / 2)
    target = ranks.where((mid >= F.col("before")) & (mid < F.col("before") + F.col("copies"))).select("conv_id", F.col("tokens").alias("mid"))
    code = nodes.where("role = 'assistant'").groupBy("conv_id").agg(F.bool_or("has_code").alias("wants_code"))
    s = main.select("conv_id").join(goal, "conv_id", "left").join(details, "conv_id", "left").join(limits, "conv_id", "left") \
        .join(others, "conv_id", "left").join(target, "conv_id", "left").join(code, "conv_id", "left").join(languages, "conv_id", "left")
    s = s.withColumns({"target_tokens": F.greatest(F.lit(100), F.floor(F.coalesce("mid", F.lit(0)) / 2)), "wants_code": F.coalesce("wants_code", F.lit(False))})
    ko = F.col("language") == "ko"
    join = lambda c, sep: F.array_join(F.col(c), sep)
    say = lambda k, e: F.when(ko, F.lit(k)).otherwise(F.lit(e))
    goal_text = F.when(F.coalesce(F.size("goal"), F.lit(0)) > 0, join("goal", ", ")).otherwise("…")
    lines = F.array_compact(F.array(
        F.concat(say("[목표] ", "[Goal] "), goal_text),
        F.when(F.size("details") > 0, F.concat(say("[세부 범위] ", "[Scope] "), join("details", " → "))),
        F.when(F.size("constraints") > 0, F.concat(say("[제약·조건] ", "[Constraints] "), join("constraints", ", "), say(" (처음부터 명시)", " (state up front)"))),
        F.concat(say("[출력 형식] ", "[Output] "), F.when(F.col("wants_code"), say("코드 포함, ", "include code, ")).otherwise(""),
                 say("핵심 위주로 약 ", "essentials only, ~"), F.col("target_tokens").cast("string"), say(" 토큰 이내", " tokens"))))
    rest = F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda o: F.concat(say("[별도 대화로] ", "[Separate chat] "), o))
    return s.select("conv_id", "goal", "details", "constraints", "wants_code", "target_tokens", F.array_join(F.concat(lines, rest), "\n").alias("prompt_template"))


def impact(m: DataFrame, dims: list[str]) -> DataFrame:
    """Totals over conversations, overall and by each dimension, in one pass of grouping sets."""
    sums = ["visible_tokens", "billed_input", "billed_output", "units", "opt_units", "ack_units", "superseded_units", "offtopic_tokens"]
    g = m.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count(F.lit(1)).alias("conversations"), *[F.sum(c).alias(c) for c in sums])
    return g.withColumns({"avoidable_units": F.col("units") - F.col("opt_units"),
                          "avoidable_pct": F.when(F.col("units") > 0, 100 * (1 - F.col("opt_units") / F.col("units"))).otherwise(0.0)})


# ---------------------------------------------------------------- everything at once


def analyse(turns: DataFrame, salt: bytes = b"", use_simhash: bool = True) -> dict[str, DataFrame]:
    """All tables of the analysis over every conversation: nodes, edges, topics, agenda, metrics, tips."""
    turns = turns.join(turns.where("role = 'user'").select("conv_id").distinct(), "conv_id", "left_semi")
    feats = turn_words(turns)
    if use_simhash:
        feats = fingerprints(feats, salt)
    feats = scale.materialize(feats)
    counts = word_counts(feats)
    kw = scale.materialize(keywords(feats, counts))
    topic_rows = topics(counts, kw)
    n = scale.materialize(intents(feats, retries(feats, use_simhash)).drop("text", "words", "wset"))
    placed = scale.materialize(threads(n, topic_rows, cues(counts)))
    nodes = n.join(placed.select(*TURN, "branch", "depth"), TURN)
    x = exchanges(nodes)
    m = metrics(nodes, x)
    red = redundant_turns(x).distinct().withColumn("redundant", F.lit(True))
    return {"nodes": nodes.join(red, TURN, "left").fillna(False, ["redundant"]), "edges": edges(n, placed), "topics": topic_rows,
            "agenda": agenda(kw), "metrics": m, "tips": tips(tip_inputs(nodes, m)),
            "skeleton": prompt_skeleton(nodes, topic_rows, agenda(kw), red, language(turns)), "language": language(turns)}


def conversation_ids(nodes: DataFrame, salt: str) -> DataFrame:
    """(conv_id, public_id): salted digest over role, fingerprint and size of each turn, built turn by turn
    in blocks so that no conversation becomes one string."""
    part = F.concat_ws(":", "role", F.lower(F.lpad(F.hex("fp"), 16, "0")), F.col("tokens").cast("string"))
    rows = nodes.select("conv_id", F.floor(F.col("idx") / 4096).alias("b"), F.struct("idx", part.alias("p")).alias("e"))

    def digest(df, keys, name):
        ordered = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["p"])
        return df.groupBy(*keys).agg(F.sha2(F.concat(F.lit(salt), F.array_join(ordered, "|")), 256).alias(name))

    blocks = digest(rows, ["conv_id", "b"], "d").select("conv_id", F.struct(F.col("b").alias("idx"), F.col("d").alias("p")).alias("e"))
    return digest(blocks, ["conv_id"], "d").select("conv_id", F.substring("d", 1, 20).alias("public_id"))
