"""Personal data: fixed patterns as seeds, and contextual patterns that the seeds induce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.llm.common import written

#: Kinds in order. Fixed patterns, written so that no place is tried twice: possessive, and starting where a run does.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without one of these a text has no match.
NEEDS = {"email": "@", "phone": "+"}
#: Words that may be identifiers: with an at sign, or with seven digits or more.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+|[^\x20\x09-\x0D0-9]*+(?:[0-9][^\x20\x09-\x0D0-9]*+){7,}+)"
#: Digits in groups, joined by single blanks, dots, hyphens or brackets; from the start of a word, up to a group's end.
RUN = r"(?<![^\x20\x09-\x0D(\[:\"'])\(?[0-9](?:(?:\)[\x20.-]?|[\x20.-]\(?)?[0-9]){%s}(?![0-9])"
#: Identifiers that need not be one word, or have few digits, by kind.
RUNS = {
    "phone": RUN % "6,14",
    "card": RUN % "13,18",
    "ip": r"(?<![^\x20\x09-\x0D(\[\"'])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,34}?::)[0-9A-Fa-f:]{2,39}(?:\.[0-9]{1,3}){0,3})(?![0-9A-Za-z:])",
}
#: The two words before a match, or as many as the text between has.
BEFORE = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.try_to_number(F.substring(number(p), 1, 3), F.lit("999")) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(F.when(F.length(digits(value)) <= 19, digits(value)).otherwise("1"))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches, left to right: structs of (start, end, before, value); offsets in code points.

    What lies between the matches has the offsets: a match starts after all earlier text and matches."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<start:long,end:long,before:string,value:string>>")
    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = F.regexp_extract(F.right(x["gap"], F.lit(80)), BEFORE, 0)
        one = F.struct(start.alias("start"), end.alias("end"), F.lower(F.trim(F.regexp_replace(before, r"[\x20\x09-\x0D]+", " "))).alias("before"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

    found = F.aggregate(F.filter(both, lambda x: x["value"].isNotNull()), first, step, lambda s: s["found"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def shape(value: Column) -> Column:
    """The kind that a word could be of."""
    n = F.length(digits(value))
    by_digits = F.when(F.regexp_count(value, F.lit("[.:]")) >= 3, "ip").when(n >= 14, "card").when(n.between(7, 15), "phone")
    return F.when(F.contains(value, F.lit("@")), "email").otherwise(by_digits)


def candidates(text: Column) -> Column:
    """What trusted contexts may find: structs of (start, end, before, value, kind). Of a run of digits that starts with
    a word of the same kind, the word."""

    def one(x: Column, value: Column, kind: Column) -> Column:
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), x["before"].alias("before"), value.alias("value"), kind.alias("kind"))

    bare = lambda x: F.regexp_replace(x["value"], r"""[.,;:!?"')\]]+$""", "")
    words = F.transform(matches(text, CANDIDATE), lambda x: one(x, bare(x), shape(bare(x))))
    run = lambda kind: F.transform(matches(text, RUNS[kind]), lambda x: one(x, x["value"], F.lit(kind)))
    runs = F.concat(*map(run, RUNS))
    return F.concat(words, F.filter(runs, lambda r: ~F.exists(words, lambda w: (w["start"] == r["start"]) & (w["kind"] == r["kind"]))))


def holds_span(o: Column, s: Column) -> Column:
    """Whether ``s`` lies in ``o``; of two kinds over the same place, the first stays."""
    more = (o["start"] < s["start"]) | (o["end"] > s["end"]) | (o["order"] < s["order"])
    return (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & more


def trusted_patterns(mentions: DataFrame, rounds: int, confidence: float, seeds: int) -> DataFrame:
    """The (kind, before) that lead to instances of their kind. ``mentions``: (kind, before, value, seed).

    Seeds count 1. A pattern's score is its distinct instances' mean score, with one instance of score 0 added; an
    instance that is no seed has the mean score of its patterns. After some rounds, a pattern is trusted if its score
    is high enough and it has several distinct seeds, so that copies of a text prove nothing."""
    edges = written(mentions.groupBy("kind", "before", "value").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        patterns = edges.join(scores, ["kind", "value"]).groupBy("kind", "before").agg((F.sum("score") / (F.count("*") + 1)).alias("score"), F.sum("seed").alias("seeds"))
        patterns = written(patterns, "patterns")
        scores = edges.join(patterns, ["kind", "before"]).groupBy("kind", "value").agg(F.when(F.max("seed") == 1, 1.0).otherwise(F.avg("score")).alias("score"))
    return patterns.where((F.col("score") >= confidence) & (F.col("seeds") >= seeds)).select("kind", "before")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, rounds: int = 3, confidence: float = 0.6, seeds: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (id, n_email, n_ip, n_card, n_phone, base, spans, n_found); the numbers and ``base`` are of the
    fixed patterns alone. ``base`` and ``spans`` are arrays of (start, order of the kind, end), ``spans`` with what
    trusted contexts add: words, and groups of digits over several words, that could be of a kind and follow two words
    which mostly precede that kind. An added span overlaps none of the fixed ones and is in no other added one. Null texts are empty. Rows that share id and text have the same spans. Ids
    may be null. Texts are read once and never moved; the graph has the matches and candidates alone, in narrow rows."""
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = []
    for order, kind in enumerate(KINDS):
        m = F.filter(matches(F.col("_t"), PATTERNS[kind]), lambda x: holds(kind, x["value"]))
        m = F.transform(m, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), x["before"].alias("before"), x["value"].alias("value")))
        if kind in NEEDS:
            m = F.when(F.contains("_t", F.lit(NEEDS[kind])), m).otherwise(F.expr("array()").cast("array<struct<start:long,order:int,end:long,before:string,value:string>>"))
        found.append(m)
    table = rows.select("_id", F.xxhash64("_t").alias("_h"), F.concat(*found).alias("_seed"), candidates(F.col("_t")).alias("_may"))
    free = F.filter("_may", lambda c: ~F.exists("_seed", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    table = written(table.withColumn("_may", free), "matches")
    kind = lambda order: F.element_at(F.array(*map(F.lit, KINDS)), order + 1)
    seed = table.select(F.explode("_seed").alias("s")).select(kind(F.col("s.order")).alias("kind"), "s.before", F.lower("s.value").alias("value"), F.lit(1).alias("seed"))
    may = table.select("_id", "_h", F.explode("_may").alias("c"))
    may = may.select("_id", "_h", "c.start", "c.end", "c.before", F.lower("c.value").alias("value"), "c.kind").where("kind is not null and before <> ''")
    mentions = seed.where("before <> ''").unionByName(may.select("kind", "before", "value", F.lit(0).alias("seed")))
    trusted = trusted_patterns(mentions, rounds, confidence, seeds)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = may.join(trusted, ["kind", "before"], "left_semi").select("_id", "_h", F.struct("start", order.alias("order"), "end").alias("s"))
    added = added.distinct().groupBy("_id", "_h").agg(F.collect_list("s").alias("_added"))
    added = added.withColumn("_added", F.filter("_added", lambda s: ~F.exists("_added", lambda o: holds_span(o, s)))).withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    base = F.transform("_seed", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    out = table.select("_id", "_h", base.alias("base")).join(added, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    none = F.expr("array()").cast("array<struct<start:long,order:int,end:long>>")
    return out.select(F.col("_id").alias(id), *map(count, range(4)), "base", F.concat("base", F.coalesce("_added", none)).alias("spans"), F.coalesce(F.size("_added"), F.lit(0)).cast("long").alias("n_found"))
