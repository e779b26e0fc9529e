"""Chat formatting by quotation linking.

A line that starts with one or more ">" is quoted, as deep as it has marks. A
passage is a run of lines of one depth. Passages are normalised (lower case,
letters and digits, single spaces) and hashed; so is every run of a message's
own words that a reply can quote: the whole, its paragraphs, its lines, its
sentences. A quoted passage, or else a line or sentence of it, joins the latest
earlier message of its conversation that says it; a reply's parent is the latest
message that its shallowest matched passage comes from. Passages of fewer than
``MIN_WORDS`` words count only where they are all that is quoted at their place,
and after all others.

Chains of parents give each message its root and depth by pointer doubling. The
order of a thread is the walk through its tree, replies to one message by turn:
each linked message is entered and left once, every step names the next one, and
pointer doubling over the steps gives each message its ``position``. Rows by
(conversation, root_turn, position) are the reply-ordered conversation, their
quotes removed.

Per-message work is a small Python helper in Arrow batches. What a message quotes
meets what others say in time spans of ``SPAN`` turns, and the latest of each
earlier span: no pair is listed, and no (conversation, passage) is gathered whole.

Nulls: a null text is an empty message; rows without a conversation or turn stay,
unlinked, as roots. Rows that repeat a conversation and turn are one message for
linking and each keep a row. Ties between passages go to the first. Conversations
may be named by any type that sorts; turns are whole numbers, negative ones too.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.llm import common

MIN_WORDS, SPAN = 4, 1024
MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
INTRO = re.compile(r"^(?:on .{1,200} wrote|am .{1,200} schrieb .{1,200}|le .{1,200} a écrit|el .{1,200} escribió) ?:\s*$", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PARSED = "body string, depth int, own array<string>, quoted array<struct<words:string,level:int,place:int,rank:int>>"


def normalise(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def levels(text: str) -> list[tuple[int, str]]:
    """(quote depth, line without its marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(lines: list[str]) -> list[str]:
    """Lines and sentences, normalised; sentences may run over lines."""
    return list(dict.fromkeys(filter(None, map(normalise, [*lines, *SENTENCE.split(" ".join(lines))]))))


def parse(text: str | None) -> tuple[str, int, list[str], list[dict]]:
    """(text without quotes and their introductions, deepest level, own passages, quoted passages).

    A quoted passage's rank: 0 a whole run of lines, 1 a part of one, 2 a whole run of few words.
    """
    lines = levels(text or "")
    body = [line for k, (depth, line) in enumerate(lines) if not depth and not (INTRO.match(line.strip()) and any(d for d, x in lines[k + 1 : k + 3]))]
    kept = "\n".join(body).strip("\n")
    paragraphs = re.split(r"\n\s*\n", kept)
    own = dict.fromkeys(filter(None, [normalise(kept), *map(normalise, paragraphs), *(x for p in paragraphs for x in passages(p.split("\n")))]))
    quoted, run, place = [], [], 0

    def close(depth: int) -> None:
        nonlocal place
        words = normalise(" ".join(run))
        many = words.count(" ") + 1 >= MIN_WORDS
        if words:
            quoted.append({"words": words, "level": depth, "place": place, "rank": 0 if many else 2})
        for part in passages(run) if many else []:
            if part != words and part.count(" ") + 1 >= MIN_WORDS:
                quoted.append({"words": part, "level": depth, "place": place, "rank": 1})
        place += 1
        run.clear()

    last = 0
    for depth, line in [*lines, (0, "")]:
        if last and depth != last:
            close(last)
        if depth:
            run.append(line)
        last = depth
    return kept, max(d for d, _ in lines), list(own), quoted


def parsed(messages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every message with what ``parse`` finds."""
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(PARSED)
    schema = StructType([*messages.select(*keep).schema.fields, *extra.fields])
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("words", pa.string()), ("level", pa.int32()), ("place", pa.int32()), ("rank", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = list(zip(*map(parse, part.column("_text").to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(found, kinds))], names=schema.names)

    return messages.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def latest_before(asked: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, turn, more) with ``said``, the latest turn of ``said`` (keys, turn) before its own; rows without one go.

    Within a span of turns by a window over the span; from earlier spans by a
    window over one row a span.
    """
    span = F.floor(F.col("turn") / SPAN)
    own = said.select(*keys, "turn", span.alias("span")).distinct()
    rows = asked.withColumn("span", span).unionByName(own.withColumn("own", F.col("turn")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("here", F.max("own").over(inside)).where("own IS NULL").drop("own")
    spans = own.groupBy(*keys, "span").agg(F.max("turn").alias("top")).unionByName(asked.select(*keys, span.alias("span")).distinct(), allowMissingColumns=True)
    spans = spans.groupBy(*keys, "span").agg(F.max("top").alias("top"))
    earlier = spans.withColumn("earlier", F.max("top").over(Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "span", "earlier")
    return here.join(earlier, [*keys, "span"]).withColumn("said", F.coalesce("here", "earlier")).where("said IS NOT NULL").drop("span", "here", "earlier")


def doubled(steps: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """``steps`` (keys, at, to, n) with ``to`` the end of the chain from ``at`` and ``n`` the sum on the way, by pointer doubling."""
    steps = common.written(steps, "steps")
    for _ in range(max_rounds):
        ahead = steps.select(*keys, F.col("at").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
        further = steps.join(ahead, [*keys, "to"], "left").select(*keys, "at", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("next").isNotNull().alias("moved"))
        old, further = steps, common.written(further, "steps")
        steps = further.drop("moved")
        common.drop_written(old)
        if not further.where("moved").head(1):
            return steps
    raise RuntimeError(f"chains go on after {max_rounds} doublings")


def walk(parent: DataFrame, roots: DataFrame, max_rounds: int) -> DataFrame:
    """(conv_id, turn, position): each linked message's place in the walk through its thread, its root at 0.

    ``parent``: (conv_id, turn, parent_turn); ``roots``: (conv_id, turn) of threads.
    A step is a message entered (twice its turn) or left (twice its turn and one).
    """
    enter, leave = F.col("turn") * 2, F.col("turn") * 2 + 1
    siblings = parent.select("conv_id", "parent_turn", "turn", F.floor(F.col("turn") / SPAN).alias("span"))
    inside = Window.partitionBy("conv_id", "parent_turn", "span").orderBy("turn")
    spans = siblings.groupBy("conv_id", "parent_turn", "span").agg(F.min("turn").alias("low"))
    after = spans.select("conv_id", "parent_turn", "span", F.lead("low").over(Window.partitionBy("conv_id", "parent_turn").orderBy("span")).alias("after"))
    following = siblings.withColumn("next", F.lead("turn").over(inside)).join(after, ["conv_id", "parent_turn", "span"]).withColumn("next", F.coalesce("next", "after"))
    left = following.select("conv_id", leave.alias("at"), F.coalesce(F.col("next") * 2, F.col("parent_turn") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("n"))
    first = spans.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("low").alias("child"))
    nodes = parent.select("conv_id", "turn").unionByName(roots).join(first, ["conv_id", "turn"], "left")
    entered = nodes.select("conv_id", enter.alias("at"), F.coalesce(F.col("child") * 2, leave).alias("to"), F.lit(1).cast("long").alias("n"))
    # From each step to the end of its thread there are as many messages as come after it, and itself.
    ends = doubled(entered.unionByName(left), ["conv_id"], max_rounds).where("at % 2 = 0").select("conv_id", (F.col("at") / 2).cast("long").alias("turn"), F.floor(F.col("to") / 2).alias("root"), "n")
    total = ends.where("turn = root").select("conv_id", "root", F.col("n").alias("total"))
    return ends.join(total, ["conv_id", "root"]).select("conv_id", "turn", (F.col("total") - F.col("n")).alias("position"))


def threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", max_rounds: int = 64) -> DataFrame:
    """Every message with parent_turn, root_turn, reply_depth, position, quote_depth, quoted passages and body."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    base = common.written(parsed(rows, ["conv_id", "turn", "role"]), "messages")
    named = base.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    hashes = lambda words: [F.xxhash64(words).alias("h0"), F.xxhash64(words, F.lit(1)).alias("h1")]
    keys = ["conv_id", "h0", "h1"]
    quoted = named.select("conv_id", "turn", F.explode("quoted").alias("p")).select(*["conv_id", "turn"], *hashes("p.words"), "p.rank", "p.level", "p.place")
    quoted = quoted.groupBy(*keys, "turn").agg(F.min(F.struct("rank", "level", "place")).alias("at"))
    own = named.select("conv_id", "turn", F.explode("own").alias("p")).select("conv_id", "turn", *hashes("p"))
    # Only conversations that quote anything have messages to look up.
    own = own.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    match = latest_before(quoted, own, keys)
    parent = match.groupBy("conv_id", "turn").agg(F.min(F.struct("at.rank", "at.level", "at.place", (-F.col("said")).alias("late"))).alias("best"), F.countDistinct("h0").cast("int").alias("n_linked"))
    parent = common.written(parent.select("conv_id", "turn", (-F.col("best.late")).alias("parent_turn"), "n_linked"), "parents")
    chains = doubled(parent.select("conv_id", F.col("turn").alias("at"), F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("n")), ["conv_id"], max_rounds)
    chains = chains.select("conv_id", F.col("at").alias("turn"), F.col("to").alias("root_turn"), F.col("n").alias("reply_depth"))
    place = walk(parent, chains.select("conv_id", F.col("root_turn").alias("turn")).distinct(), max_rounds)
    linked = chains.join(parent, ["conv_id", "turn"]).join(place, ["conv_id", "turn"])
    return base.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("reply_depth", F.lit(0)).cast("int").alias("reply_depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        F.col("depth").alias("quote_depth"),
        F.size(F.filter("quoted", lambda q: q["rank"] != 1)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "body",
    )


def op8_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered messages of all ``conversations``, without quotes."""
    return threads(common.table(spark, sf_dir, "conversations"))
