"""Personal data by patterns, and by contexts that patterns bootstrap. Spark SQL functions only.

Base spans are what four fixed expressions find. Their positions come from
cutting the text at the matches: the pieces between matches and the matches
themselves, laid end to end, give every match's start in code points. The
expressions are written so that Java's matcher neither recurses nor rescans on
long texts (possessive groups; a match may not start inside a run that has
failed); they match what the plain ones match.

Bootstrapping then looks for identifiers that no expression knows. A mention is a
word outside the base spans that has ``MIN_DIGITS`` digits or more, or letters
and a digit, ``MIN_MIXED`` characters of them; or a base span (the seeds). Its
contexts are patterns of three words (runs of letters, in lower case, from all
the text before and after it): the three before, the three after, and two before
with one after; a mark of the text's start or end stands for each that is
missing. Marks alone are no pattern, nor is a single word after. Patterns and instances (distinct
strings) form a bipartite graph. A mention of another shape (``NO_ID``: years,
dates, times, amounts, percentages, numbers with a short unit or ending) is a
counterexample and never an identifier. In each round a pattern's confidence is the mean of its
distinct known instances (seeds 1, counterexamples 0, identifiers found their
best accepted pattern's), counted with one doubtful instance more; unknown ones
neither help nor harm. Patterns need ``SUPPORT`` distinct identifiers and a
confidence of ``ACCEPT``; instances of accepted patterns are known in the next
round, so a pattern can be reached through found identifiers alone. After
``ROUNDS`` rounds the unknown mentions in accepted patterns are added as spans
of the kind "id".

Only mentions are shuffled, never texts. Counts are partial aggregates by
pattern and instance; a common pattern is one row in each join.

Nulls: a null text is empty. Rows that share id and text get the same spans;
repeated rows stay. Texts of any length are read whole. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common

KINDS = ["email", "ip", "card", "phone", "id"]
#: What each kind's text has at least; the expression; and the run in which a match may not start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORDS, MIN_DIGITS, MIN_MIXED, SUPPORT, ACCEPT, ROUNDS = 3, 4, 5, 3, 0.7, 3
MENTION = r"(?:\G|(?<!\S))[^\s0-9]*+[0-9]\S*+"
#: Years and their ranges; dates; times; grouped or decimal numbers; percentages and amounts of money. Of at most NO_ID_LENGTH characters.
NO_ID = (
    r"^[^\p{L}\p{N}$\u20ac\u00a3\u00a5]*+(?:(?:19|20)[0-9]{2}s?(?:[/\u2013-](?:[0-9]{2}){1,2})?"
    r"|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}(?:T[0-9:.Z+-]+)?"
    r"|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{1,3}(?:[,.'][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+[.,][0-9]+"
    r"|[0-9]{1,4}\p{L}{1,3}|[0-9][0-9.,]*%|[$\u20ac\u00a3\u00a5][0-9][0-9.,]*|[0-9][0-9.,]*[$\u20ac\u00a3\u00a5])[^\p{L}\p{N}]*$"
)
NO_ID_LENGTH = 40
START, END = "^", "$"  # no runs of letters
SPANS = "array<struct<kind:int,start:int,end:int>>"
#: Documents with added spans that may be broadcast; more are joined by a shuffle.
MANY = 100_000


def cut(text: Column, pattern: str, keep) -> Column:
    """(start, end, match) of the pattern's matches that ``keep`` keeps, as an array."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Without the limit split() would take a trailing empty piece away.
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.zip_with(gaps, matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"), F.coalesce(F.length(m), F.lit(0)).alias("n")))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def lay(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("m"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), lay, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' weighted sum is a multiple of 10, doubling every second from the right."""
    d = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_ok(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(13, 19) & luhn(F.when(F.length(d).between(13, 19), d).otherwise(F.lit("1")))


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's spans (start, end, m) in a non-null text."""
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), cut(text, EMAIL, lambda m: F.lit(True))).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), cut(text, IP, _ip_ok)).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), cut(text, CARD, _card_ok)).otherwise(none),
        "phone": F.when(text.rlike(r"\+[0-9]"), cut(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15))).otherwise(none),
    }


def in_context(text: Column, mentions: Column) -> Column:
    """``mentions`` (in order of start) with ``patterns``, hashes of the words around each.

    The text is read once forward: each stretch from one mention's start to the
    next hands its last words on. What follows a mention, up to the next one, is
    its own stretch; where that has too few words it ends with marks.
    """
    words = lambda a, n: F.filter(F.split(F.lower(F.substring(text, a + 1, F.greatest(n, F.lit(0)))), r"[^\p{L}]+"), lambda w: w != "")
    at = F.transform(mentions, lambda s: s["start"])
    since = F.concat(F.array(F.lit(0)), at)
    stretches = F.zip_with(at, F.slice(since, 1, F.size(at)), lambda b, a: words(a, b - a))
    marks = lambda m: F.array(*[F.lit(m)] * WORDS)
    none = F.array().cast("array<array<string>>")

    def read(acc: Column, found: Column) -> Column:
        last = F.slice(F.concat(acc["last"], found), -WORDS, WORDS)
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    before = F.aggregate(stretches, F.struct(marks(START).alias("last"), none.alias("out")), read, lambda acc: acc["out"])
    until = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.length(text)))
    after = F.zip_with(mentions, until, lambda s, b: F.slice(F.concat(words(s["end"], b - s["end"]), marks(END)), 1, WORDS))

    def patterns(left: Column, right: Column) -> Column:
        l, r_ = (lambda k: F.element_at(left, k)), (lambda k: F.element_at(right, k))
        kinds = [([l(1), l(2), l(3)], l(3) != START), ([r_(1), r_(2), r_(3)], r_(2) != END), ([l(2), l(3), r_(1)], (l(3) != START) & (r_(1) != END))]
        return F.filter(F.array(*(F.when(real, F.xxhash64(F.lit(k), *three)) for k, (three, real) in enumerate(kinds))), lambda p: p.isNotNull())

    around = F.zip_with(before, after, patterns)
    return F.zip_with(mentions, around, lambda s, p: F.struct(s["seed"].alias("seed"), s["start"].alias("start"), s["end"].alias("end"), s["instance"].alias("instance"), p.alias("patterns")))


def joined(spans: Column) -> Column:
    """Spans (kind's rank, start, end) as kind:start:end, by rank and then start, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    """A document's id and a hash of its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def tagged(text: Column) -> Column:
    """Base spans (kind's rank, start, end) of a non-null text."""
    tag = lambda rank: lambda s: F.struct(F.lit(rank).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.concat(*(F.transform(s, tag(i)) for i, s in enumerate(base_spans(text).values())))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: row_key, doc_id, base, mentions with their patterns; a written table without texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.select("doc_id", text.alias("text"), *(s.alias(k) for k, s in base_spans(text).items()))
    tag = lambda rank: lambda s: F.struct(F.lit(rank).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = found.withColumn("base", F.concat(*(F.transform(k, tag(i)) for i, k in enumerate(KINDS[:4]))))
    other = F.when(
        F.col("text").rlike("[0-9]"),
        F.filter(cut(F.col("text"), MENTION, lambda m: (F.length(_digits(m)) >= MIN_DIGITS) | (m.rlike(r"\p{L}") & (F.length(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")) >= MIN_MIXED))), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
    ).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))
    mention = lambda seed: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), seed(s["m"]).alias("seed"), F.xxhash64(s["m"]).alias("instance"))
    shape = lambda m: F.when((F.length(m) <= NO_ID_LENGTH) & m.rlike(NO_ID), F.lit(-1.0)).otherwise(F.lit(0.0))
    seeds = (F.transform(k, mention(lambda m: F.lit(1.0))) for k in KINDS[:4])
    found = found.withColumn("mentions", F.array_sort(F.concat(*seeds, F.transform(other, mention(shape)))))
    found = found.select(
        "doc_id",
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        "base",
        in_context(F.col("text"), F.col("mentions")).alias("mentions"),
    )
    return common.written(found, "spans")


def added_spans(found: DataFrame) -> DataFrame:
    """(row_key, added) of the documents in which the bootstrap finds spans."""
    mentions = found.select("row_key", F.explode("mentions").alias("s")).select("row_key", "s.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    return bootstrap(mentions).groupBy("row_key").agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: row_key, doc_id, base (spans of the fixed expressions), added (spans of the bootstrap)."""
    found = found_spans(docs, id_col, text_col)
    return found.drop("mentions").join(added_spans(found), "row_key", "left").withColumn("added", F.coalesce("added", F.array().cast(SPANS)))


def bootstrap(mentions: DataFrame) -> DataFrame:
    """(row_key, start, end) of mentions that accepted patterns and instances agree on."""
    graph = common.written(mentions.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    # Patterns that can never be accepted leave the graph at once: without them it holds little.
    live = graph.where("seed >= 0").groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern")
    graph = common.written(graph.join(live, "pattern"), "graph")
    # 1 for seeds, -1 for counterexamples, 0 for what isn't known, else the confidence that has been reached.
    belief = graph.groupBy("instance").agg(F.max("seed").alias("belief"))
    accepted = None
    for _ in range(ROUNDS):
        known = graph.join(belief.where("belief <> 0"), "instance").groupBy("pattern")
        # Rounded, so that the order of a sum decides nothing.
        score = known.agg(F.round(F.sum(F.greatest("belief", F.lit(0.0))) / (F.count("*") + 1), 9).alias("score"), F.count_if(F.col("belief") > 0).alias("found"))
        accepted = common.written(score.where((F.col("found") >= SUPPORT) & (F.col("score") >= ACCEPT)).select("pattern", "score"), "accepted")
        reached = graph.join(accepted, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.max("score").alias("score"))
        belief = common.written(reached.select("instance", F.when(F.col("seed") != 0, F.col("seed")).otherwise(F.coalesce("score", F.lit(0.0))).alias("belief")), "belief")
    return mentions.where("seed = 0").join(accepted, "pattern").select("row_key", "start", "end").distinct()


def merged(spans: Column) -> Column:
    """Spans by start, those that overlap joined under the first one's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def lay(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, none, lay)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; null texts stay null.

    Base spans are found again where the text is, so no text is shuffled for
    them; documents with added spans are few, and joined.
    """
    added = common.hinted(added_spans(found_spans(docs, id_col, text_col)), MANY).withColumnsRenamed({"row_key": "_row_key", "added": "_added"})
    text = F.col(text_col)
    rows = docs.withColumn("_row_key", row_key(F.col(id_col), text)).join(added, "_row_key", "left")
    rows = rows.withColumn("_base", tagged(F.coalesce(text.cast("string"), F.lit(""))))
    rows = rows.withColumn("_spans", merged(F.concat("_base", F.coalesce("_added", F.array().cast(SPANS)))))
    kinds, n = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.size("_spans")
    # The text up to the first span, then each span's kind and the text up to the next.
    ends = F.transform("_spans", lambda s, i: F.coalesce(F.try_element_at("_spans", i + 2)["start"], F.length(text)))
    clean = F.concat(F.substring(text, F.lit(1), F.try_element_at("_spans", F.lit(1))["start"]), F.array_join(F.zip_with("_spans", ends, lambda s, e: F.concat(F.element_at(kinds, s["kind"] + 1), F.substring(text, s["end"] + 1, e - s["end"]))), ""))
    return rows.withColumn(text_col, F.when(n > 0, clean).otherwise(text)).select(docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and bootstrapped spans of every document."""
    rows = find(common.table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["kind"] == rank)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").alias("n_added"))
