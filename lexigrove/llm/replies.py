"""Reply trees, written as conversations; with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import components
from lexigrove.session import Scratch, cut

#: Marks around a turn, which no escaped text holds, and the roles whose texts are learnt.
START, END, LEARNT = "<|im_start|>", "<|im_end|>", ("assistant",)
#: Branches of a tree that are written, the best ones.
BEST = 1


def escaped(text: Column) -> Column:
    """The text with a backslash more in each `<|`, `<\\|`, `<\\\\|`, ...: no mark is left in it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role that takes one line: backslashes are doubled, a line's end is written as one and an n."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(role), F.lit("\n"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    marked = F.split(formatted, r"<\|im_end\|>\n")
    lines = F.transform(F.filter(marked, lambda t: t != ""), lambda t: F.substring(t, len(START) + 1, 2147483647))
    return F.transform(lines, lambda t: F.struct(unescaped_role(F.substring_index(t, "\n", 1)).alias("role"), unescaped(F.substring(t, F.locate("\n", t) + 1, F.lit(2147483647))).alias("text")))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a mask of (start, length) in UTF-8 bytes, read back: array of strings."""
    of = lambda b, s: unescaped(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return F.flatten(F.transform(F.array(formatted.cast("binary")), lambda b: F.transform(mask, lambda s: of(b, s))))


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Where the path from each message up to its root ends: (id, root, steps, total); the tables (id, anc) of its
    ancestors 1, 2, 4, ... above it; the ids that are answered, (id).

    nodes: (id, up, own), each id once. Rounds join the table with itself, each doubling the way that all paths have
    gone, so that there are as many as the binary digits of the deepest reply. A message is a root if nothing has the id
    that it answers. Replies that go round in a circle begin at its smallest id. nodes must be a written table.
    """
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    at = nodes.where("up is null or up <> id").join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("anc"), "own")
    at = at.unionByName(nodes.where("up = id").select("id", F.lit(None).cast(nodes.schema["up"].dataType).alias("anc"), "own"))
    first = cut(at)
    n = nodes.count()
    while True:
        state = cut(first.select("id", "anc", F.when(F.col("anc").isNull(), F.col("id")).alias("root"), F.lit(1).cast("long").alias("steps"), F.col("own").alias("total")))
        levels: list[DataFrame] = []
        while 2 ** len(levels) <= 2 * n and not state.where("anc is not null").isEmpty():
            levels.append(state.where("anc is not null").select("id", "anc"))
            above = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("root").alias("end"), F.col("steps").alias("more"), F.col("total").alias("rest"))
            on = state.where("anc is not null").join(above, "anc").select("id", F.col("next").alias("anc"), F.col("end").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("rest")).alias("total"))
            state = cut(on.unionByName(state.where("anc is null")))
        circling = state.where("anc is not null")
        if circling.isEmpty():
            return state.drop("anc"), levels, first.where("anc is not null").select(F.col("anc").alias("id")).distinct()
        # after n steps and more, every path that has not ended is on its circle, and every message of a circle is met
        circle = cut(circling.select(F.col("anc").alias("id")).distinct())
        starts = components(first.join(circle, "id").select(F.col("id").alias("a"), F.col("anc").alias("b"))).select(F.col("component_id").alias("id")).distinct()
        begun = first.join(starts.withColumn("begins", F.lit(True)), "id", "left")
        first = cut(begun.select("id", F.when(F.col("begins").isNull(), F.col("anc")).alias("anc"), "own"))


def best_paths(nodes: DataFrame, best: int = BEST) -> tuple[DataFrame, DataFrame]:
    """The `best` root-to-leaf paths of each tree by the sum of their messages' scores, ties by the smaller leaf:
    (leaf, root, rank, score, steps), and their messages (leaf, id, pos), pos from 0 at the root."""
    ends, levels, answered = branches(nodes)
    leaves = ends.join(answered, "id", "left_anti")
    order = Window.partitionBy("root").orderBy(F.col("total").desc(), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    chosen = cut(chosen.select(F.col("id").alias("leaf"), "root", "rank", F.col("total").alias("score"), "steps"))
    path = chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("away"))
    for k in reversed(range(len(levels))):  # each distance is one sum of powers of two, so that no message comes twice
        up = path.join(levels[k], "id").select("leaf", F.col("anc").alias("id"), (F.col("away") + 2**k).alias("away"))
        path = cut(path.unionByName(up))
    return chosen, path.join(chosen.select("leaf", "steps"), "leaf").select("leaf", "id", (F.col("steps") - 1 - F.col("away")).alias("pos"))


def format_paths(nodes: DataFrame, texts: DataFrame, best: int = BEST, learnt=LEARNT) -> DataFrame:
    """Each chosen path as one conversation: root, leaf, rank, score, n_turns, formatted, mask.

    nodes: (id, up, own, tid), each id once; texts: (tid, role, text). `formatted` marks turns with START and END;
    control strings in texts and roles are escaped (escaped()); `mask` tells the texts of the learnt roles as (start,
    length) in UTF-8 bytes of it. Only ids go through the rounds; texts are shuffled once to the paths' messages and
    once to the paths, of which each is one row in the end.
    """
    nodes = cut(nodes)
    chosen, path = best_paths(nodes.select("id", "up", "own"), best)
    once = texts.dropDuplicates(["tid"])  # counted before the shuffle, so that a text told often travels once a task
    turns = path.join(nodes.select("id", "tid"), "id").select("leaf", "pos", "tid").join(once, "tid")
    turns = turns.select("leaf", "pos", *_pieces(learnt))
    before = Window.partitionBy("leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("head") + F.octet_length("body") + len(END) + 1).over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.withColumn("start", at.cast("long")).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "body", "learn", "start"))).alias("t"))
    return _joined(chosen.join(turns, "leaf"))


def _pieces(learnt) -> list[Column]:
    return [_head(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role").isin(*learnt), F.lit(False)).alias("learn")]


def _joined(paths: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), F.octet_length(x["body"]).cast("long").alias("length")))
    return paths.select("root", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"), said.alias("formatted"), mask.alias("mask"))


def _alone(texts: DataFrame, root: Column, learnt) -> DataFrame:
    """Rows (role, text, score) that are conversations by themselves, without a shuffle."""
    one = texts.select(root.alias("root"), root.alias("leaf"), F.lit(1).alias("rank"), "score", *_pieces(learnt))
    return _joined(one.withColumn("t", F.array(F.struct(F.lit(0).alias("pos"), "head", "body", "learn", F.octet_length("head").cast("long").alias("start")))))


def reply_trees(messages: DataFrame, best: int = BEST, learnt=LEARNT) -> DataFrame:
    """The best branches of each reply tree as conversations: root, leaf (message ids), rank, score, n_turns, formatted,
    mask, from rows (message_id, parent_id, role, text, score).

    Cases: a null or unknown parent_id begins a tree; a null message_id is a conversation by itself, with null ids; of rows
    of one message_id that with the smallest parent, score and digest speaks (equal rows are one message); null scores
    and NaN count as 0; null texts and roles are empty; ties go to the smaller leaf; an empty table gives no rows; other columns are
    not read. A path is one row in the end, as long as all its texts.
    """
    score = F.when(F.isnan(F.col("score").cast("double")), 0.0).otherwise(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    said = messages.select("message_id", F.col("parent_id").alias("up"), "role", "text", score.alias("score"))
    digest = F.sha2(F.to_json(F.struct("role", "text")), 256)
    tid = F.struct(F.col("message_id").alias("id"), digest.alias("h"))
    with Scratch(messages.sparkSession) as scratch:
        some = said.where("message_id is not null")
        one = some.select("message_id", F.struct("up", "score", digest.alias("h")).alias("m")).groupBy("message_id").agg(F.min("m").alias("m"))
        nodes = one.select(F.col("message_id").alias("id"), "m.up", F.col("m.score").alias("own"), F.struct(F.col("message_id").alias("id"), F.col("m.h").alias("h")).alias("tid"))
        out = format_paths(nodes, some.select(tid.alias("tid"), "role", "text"), best, learnt)
        null = F.lit(None).cast(messages.schema["message_id"].dataType)
        return scratch.keep(cut(out.unionByName(_alone(said.where("message_id is null"), null, learnt))))


def format_conversations(turns: DataFrame, learnt=LEARNT) -> DataFrame:
    """Conversations told as rows (conv_id, turn, role, text): conv_id, n_turns, formatted, mask.

    Each turn answers the one before it, so that a conversation is a tree of one branch. Cases: turns go by (turn, role,
    digest of the text), null turns last; rows that agree in all four columns are one turn; rows without a conv_id
    are conversations by themselves; null texts and roles are empty; an empty table gives no rows; other columns are not read.
    """
    said = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    with Scratch(turns.sparkSession) as scratch:
        some = said.where("conv_id is not null")
        k = F.row_number().over(Window.partitionBy("tid.conv_id").orderBy(F.col("tid.turn").asc_nulls_last(), "tid.role", "tid.h"))
        rows = some.select(key.alias("tid")).distinct().withColumn("k", k)
        number = lambda k: F.struct(F.col("tid.conv_id").alias("conv_id"), k.alias("k"))
        nodes = rows.select(number(F.col("k")).alias("id"), F.when(F.col("k") > 1, number(F.col("k") - 1)).alias("up"), F.lit(0.0).alias("own"), "tid")
        out = format_paths(nodes, some.select(key.alias("tid"), "role", "text"), 1, learnt).withColumn("conv_id", F.col("root.conv_id"))
        alone = _alone(said.where("conv_id is null").withColumn("score", F.lit(0.0)), F.col("conv_id"), learnt).withColumn("conv_id", F.col("root"))
        cols = ["conv_id", "n_turns", "formatted", "mask"]
        return scratch.keep(cut(out.select(cols).unionByName(alone.select(cols))))
