"""Chat formatting: quoted passages linked to the messages they come from, and conversations in reply order.

A line's leading '>' marks (spaces between them allowed) are its quote level; lines of one level that
follow each other are a passage. Passages, their paragraphs and their lines are normalised (A-Z
lower-cased, marks off, white space collapsed), hashed (128 bits of BLAKE2), and joined to the own
(unquoted) passages, paragraphs, lines and whole own text of earlier messages of the same conversation:
each quoted line comes from the latest earlier message that has the longest quoted part around it which
any message has. A message replies to the message that most of its level-1 lines come from (ties: the
latest). Replies form trees; a conversation is ordered by the first turn of each tree, and a tree as it
is walked: a message, then each of its replies with all that follows from it, by turn. Quoted lines, and
a line that only says that someone wrote, are left out of the text.

The join is as-of, by windows over keys of (conversation, hash, chunk of turns) with what earlier
chunks hold carried over, so neither a long conversation nor a line that everyone repeats meets in one
task, and no pair of equal lines is ever formed. Trees of at most `small` messages are walked in one
task each; larger ones by doubling over their tour (enter and leave a message), whatever their shape.

A null text counts as empty. Rows of one conv_id and turn are one message for linking: they share the
links and stand side by side, by role and text. Rows with a null conv_id or turn get no links and no
position. A very long text is parsed whole in one task. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._shared import written
from pagewarden.llm._text import bounded_batches, texts, units

CHUNK, SMALL = 256, 10_000
_MARKS = r"^([ \t]*>)+"
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
_LEAD, _BLANKS, _SAID = re.compile(_MARKS), re.compile(r"[ \t\x0B\f\r]+"), re.compile(r"^[^\n]{0,200}\bwrote:[ \t\r]*$", re.I)
UNIT_SCHEMA = "conv_id long, turn long, level int, line int, size int, a long, b long"


def quote_level(line: Column) -> Column:
    """The number of leading '>' marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and, where there are any, without lines that announce them; no blank ends."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    own = F.filter(lines, lambda x: quote_level(x) == 0)
    said = F.filter(own, lambda x: ~x.rlike(r"(?i)^[^\n]{0,200}\bwrote:[ \t\r]*$"))
    return F.regexp_replace(F.array_join(F.when(F.size(own) < F.size(lines), said).otherwise(own), "\n"), r"^\s+|\s+$", "")


def passages(text: str) -> list[tuple[int, int, int, str]]:
    """(level, first line, lines, normalised text): passages, paragraphs and lines, each part once, and the whole own text."""
    lines = []
    for raw in text.split("\n"):
        marks = _LEAD.match(raw)
        level = marks[0].count(">") if marks else 0
        lines.append((level, _BLANKS.sub(" ", raw[marks.end() if marks else 0 :].translate(_LOWER)).strip(" ")))
    quoting = any(level for level, _ in lines)
    own = [(i, said) for i, (level, said) in enumerate(lines) if not level and said and not (quoting and _SAID.match(said))]
    out = {(0, own[0][0], len(own), " ".join(said for _, said in own))} if own else set()
    i = 0
    while i < len(lines):
        level, j = lines[i][0], i
        while j < len(lines) and lines[j][0] == level:
            j += 1
        parts: list[list[int]] = [[]]
        for k in range(i, j):
            if lines[k][1]:
                parts[-1].append(k)
            elif parts[-1]:
                parts.append([])
        paragraphs = [p for p in parts if p]
        for part in [sum(paragraphs, []), *paragraphs, *([k] for p in paragraphs for k in p)]:
            if part:
                out.add((level, part[0], part[-1] - part[0] + 1, " ".join(lines[k][1] for k in part)))
        i = j
    return sorted(out)


def quoted_parts(messages: DataFrame) -> DataFrame:
    """UNIT_SCHEMA: all parts of all messages; a and b are the hash of a part's text."""
    bounded_batches(messages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]
        for unit in units(batches):
            rows = []
            for conv, turn, text in zip(unit.column("conv_id").to_pylist(), unit.column("turn").to_pylist(), texts(unit).to_pylist()):
                for level, line, size, said in passages(text):
                    digest = hashlib.blake2b(said.encode(), digest_size=16).digest()
                    rows.append((conv, turn, level, line, size, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "text").mapInArrow(run, UNIT_SCHEMA)


def quote_sources(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, level, line, source): each quoted line and the turn that it comes from, or null."""
    rows = quoted_parts(messages).withColumn("chunk", F.floor(F.col("turn") / chunk))
    key = ["conv_id", "a", "b", "chunk"]
    own = F.when(F.col("level") == 0, F.col("turn"))
    near = rows.withColumn("near", F.max(own).over(Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))).filter("level > 0")
    last = rows.groupBy(*key).agg(F.max(own).alias("last"))
    before = last.withColumn("far", F.max("last").over(Window.partitionBy("conv_id", "a", "b").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    parts = near.join(before.select(*key, "far"), key).select("conv_id", "turn", "level", "line", "size", F.coalesce("near", "far").alias("source"))
    # A line's own row stands for it; larger parts that were found speak for all their lines.
    lines = parts.select("conv_id", "turn", "level", F.explode(F.when(F.col("source").isNull(), F.array("line")).otherwise(F.sequence("line", F.col("line") + F.col("size") - 1))).alias("line"), "size", "source")
    best = F.max(F.when(F.col("source").isNotNull(), F.struct("size", "source")))
    return lines.groupBy("conv_id", "turn", "level", "line").agg(best["source"].alias("source"))


def reply_links(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, n_quoted, levels, reply_to, links): one row per message that quotes."""
    sources = quote_sources(messages, chunk)
    votes = sources.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    best = F.max(F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.struct("n", "source")))
    pairs = F.array_sort(F.collect_set(F.when(F.col("source").isNotNull(), F.struct("level", "source"))))
    said = F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["level"], x["source"])), ",")
    return votes.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_quoted"), F.max("level").alias("levels"), best["source"].alias("reply_to"), said.alias("links"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): for messages that reply, the first message of their thread; by pointer jumping."""
    at = written(links.filter("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("thread")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"))
        new = written(at.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), F.col("up").isNotNull().alias("moved")), "threads")
        at = new.select("conv_id", "turn", "thread")
        if new.filter("moved").isEmpty():
            return at


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, ahead) from messages sorted by conv_id, thread and turn: rows that stand before each in its tree."""
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        place = {turn: i for i, (_, _, turn, _, _) in enumerate(rows)}
        up = [place[r[3]] if r[3] is not None else -1 for r in rows]
        size = [r[4] for r in rows]
        for i in range(len(rows) - 1, 0, -1):  # a reply comes after what it answers
            if up[i] >= 0:
                size[up[i]] += size[i]
        ahead, used = [0] * len(rows), [r[4] for r in rows]
        for i, p in enumerate(up):
            if p >= 0:
                ahead[i] = ahead[p] + used[p]
                used[p] += size[i]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(ahead, pa.int64())], ["conv_id", "turn", "ahead"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "thread", "turn", "reply_to", "n"))):
            if rows and rows[0][:2] != row[:2]:
                yield done()
                rows = []
            rows.append(row)
    if rows:
        yield done()


def _toured(nodes: DataFrame, chunk: int) -> DataFrame:
    """The same for trees too large for a task: sums to the end of the tour, by doubling."""
    key = ["conv_id", "reply_to"]
    kids = nodes.filter("reply_to is not null").withColumn("chunk", F.floor(F.col("turn") / chunk))
    near = kids.withColumn("near", F.lead("turn").over(Window.partitionBy(*key, "chunk").orderBy("turn")))
    firsts = kids.groupBy(*key, "chunk").agg(F.min("turn").alias("first"))
    later = firsts.withColumn("far", F.lead("first").over(Window.partitionBy(*key).orderBy("chunk"))).select(*key, "chunk", "far")
    beside = near.join(later, [*key, "chunk"]).select("conv_id", "turn", F.coalesce("near", "far").alias("sibling"))
    first = firsts.groupBy(*key).agg(F.min("first").alias("child")).withColumnRenamed("reply_to", "turn")
    of = written(nodes.join(beside, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left"), "tours")
    enter, leave = lambda t: F.col(t) * 2, lambda t: F.col(t) * 2 + 1
    steps = F.array(
        F.struct(enter("turn").alias("arc"), F.coalesce(enter("child"), leave("turn")).alias("to"), F.col("n").alias("sum")),
        F.struct(leave("turn").alias("arc"), F.coalesce(enter("sibling"), leave("reply_to")).alias("to"), F.lit(0).cast("long").alias("sum")),
    )
    state = written(of.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.arc", "s.to", "s.sum"), "tours")
    while not state.filter("to is not null").isEmpty():
        on = state.select("conv_id", F.col("arc").alias("to"), F.col("to").alias("then"), F.col("sum").alias("more"))
        state = written(state.join(on, ["conv_id", "to"], "left").select("conv_id", "arc", F.col("then").alias("to"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")), "tours")
    left = state.filter("arc % 2 = 0").select("conv_id", (F.col("arc") / 2).cast("long").alias("turn"), "sum")
    total = nodes.groupBy("conv_id", "thread").agg(F.sum("n").alias("total"))
    return nodes.select("conv_id", "turn", "thread").join(left, ["conv_id", "turn"]).join(total, ["conv_id", "thread"]).select("conv_id", "turn", (F.col("total") - F.col("sum")).alias("ahead"))


def places_in_trees(nodes: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, ahead): for messages (conv_id, turn, thread, reply_to, n rows) of trees of several, the rows before each."""
    sizes = nodes.groupBy("conv_id", "thread").agg(F.count("*").alias("messages")).filter("messages > 1")
    nodes = written(nodes.join(sizes, ["conv_id", "thread"]), "trees")
    walked = nodes.filter(F.col("messages") <= small).drop("messages").repartition("conv_id", "thread").sortWithinPartitions("conv_id", "thread", "turn").select("conv_id", "thread", "turn", "reply_to", "n").mapInArrow(_walked, "conv_id long, turn long, ahead long")
    large = nodes.filter(F.col("messages") > small).drop("messages")
    return walked if large.isEmpty() else walked.union(_toured(large, chunk))


def conversations_in_order(messages: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, levels, reply_to, links, thread, position."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    links = written(reply_links(messages, chunk), "links")
    rows = messages.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    rows = rows.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("levels", F.lit(0)).alias("levels"), "reply_to", F.coalesce("links", F.lit("")).alias("links"), F.coalesce("thread", "turn").alias("thread"))
    rows = written(rows, "messages")
    nodes = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", "thread", "reply_to").agg(F.count("*").alias("n"))
    ahead = places_in_trees(nodes, small, chunk)
    trees = nodes.groupBy("conv_id", "thread").agg(F.sum("n").alias("n")).withColumn("chunk", F.floor(F.col("thread") / chunk))
    sizes = trees.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"))
    before = sizes.select("conv_id", "chunk", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = (F.sum("n").over(Window.partitionBy("conv_id", "chunk").orderBy("thread")) - F.col("n")).alias("inside")
    trees = trees.select("conv_id", "thread", "chunk", inside).join(before, ["conv_id", "chunk"]).select("conv_id", "thread", (F.col("inside") + F.col("before")).alias("begin"))
    at = nodes.select("conv_id", "turn", "thread").join(trees, ["conv_id", "thread"]).join(ahead, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("begin") + F.coalesce("ahead", F.lit(0))).alias("at"))
    same = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", F.xxhash64("text"))) - 1
    names = ["conv_id", "turn", "role", "text", "n_quoted", "levels", "reply_to", "links", "thread"]
    ordered = rows.withColumn("same", same).join(at, ["conv_id", "turn"]).select(*names, (F.col("at") + F.col("same")).alias("position"))
    rest = rows.filter("conv_id is null or turn is null").select(*names, F.lit(None).cast("long").alias("position"))
    return ordered.union(rest)


def op1_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
