"""Document fingerprints: a homomorphic multiset hash over paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.llm.common import written

#: Lanes of equality: 32-bit sums of hashes of whole paragraphs.
WIDE = 16
#: Words of likeness; each holds three sums modulo 2 ** 20 with a guard bit above each.
PACKED, FIELD = 16, 21
MODULUS = 1 << 20
ONES = sum(1 << FIELD * f for f in range(3))
LANES = ONES * (MODULUS - 1)
LOW32 = (1 << 32) - 1
#: Stands for a null id.
NO_ID = -(2**63)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")


def vectors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the struct ``out``: (words, wide, lanes), the sum of the paragraphs' vectors.

    A paragraph's vector has ``WIDE`` hashes of its text, added modulo 2 ** 32, and 3 * ``PACKED`` counts modulo
    2 ** 20: of those of its words (each hashed with the one before) whose hash has a certain bit. The sum doesn't
    depend on the order of paragraphs, and one is put in or taken out by adding or subtracting its vector lane by lane
    (``combined``)."""
    p, w, h = f"__{out}_p", f"__{out}_w", f"__{out}_h"
    df = df.withColumn(p, paragraphs(F.col(text)))
    df = df.withColumn(w, F.transform(p, lambda x: F.split(x, r"[\x20\x09-\x0D]+")))
    pair = lambda ws: F.transform(ws, lambda x, i: F.xxhash64(x, F.get(ws, i - 1)))
    df = df.withColumn(h, F.flatten(F.transform(w, pair)))
    wide = []
    for j in range(WIDE // 2):
        both = F.aggregate(F.transform(p, lambda x: F.xxhash64(F.lit(j), x)), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, x: F.struct(((s["a"] + x.bitwiseAND(LOW32)).bitwiseAND(LOW32)).alias("a"), ((s["b"] + F.shiftrightunsigned(x, 32)).bitwiseAND(LOW32)).alias("b")))
        wide.append(both)
    lanes = [F.aggregate(h, F.lit(0).cast("long"), lambda s, x: (s + F.shiftright(x, j).bitwiseAND(ONES)).bitwiseAND(LANES)) for j in range(PACKED)]
    fields = F.flatten(F.array(*(F.array(b["a"], b["b"]) for b in wide)))
    df = df.withColumn(out, F.struct(F.size(h).cast("long").alias("words"), fields.alias("wide"), F.array(*lanes).alias("lanes")))
    return df.drop(p, w, h)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets together, or, with -1, of ``a`` without ``b``."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    field = lambda x, f: F.shiftright(x, FIELD * f).bitwiseAND(MODULUS - 1)
    lane = lambda x, y: sum((F.shiftleft(F.pmod(field(x, f) + sign * field(y, f), F.lit(MODULUS)), FIELD * f) for f in range(3)), F.lit(0).cast("long"))
    return F.struct((a["words"] + sign * b["words"]).alias("words"), wide.alias("wide"), F.zip_with(a["lanes"], b["lanes"], lane).alias("lanes"))


def text_of(v: Column) -> Column:
    """The fingerprint as hex: words, wide lanes, lanes."""
    hexes = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(F.lpad(F.hex(v["words"]), 16, "0"), hexes(v["wide"], 8), hexes(v["lanes"], 16)))


def _power(lanes: Column, words: Column) -> Column:
    """Estimated sum of squared multiplicities: of the lanes' doubled, centred counts, taken as signed."""
    half = MODULUS // 2
    signed = lambda x, f: F.pmod(2 * F.shiftright(x, FIELD * f).bitwiseAND(MODULUS - 1) - words + half, F.lit(MODULUS)) - half
    square = lambda x: sum((signed(x, f).cast("double") * signed(x, f) for f in range(3)), F.lit(0.0))
    return F.aggregate(lanes, F.lit(0.0), lambda s, x: s + square(x))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 1 - |a - b|^2 / (|a|^2 + |b|^2), not below 0, from the sums alone."""
    apart = combined(a, b, -1)
    both = _power(a["lanes"], a["words"]) + _power(b["lanes"], b["words"])
    near = F.greatest(F.lit(0.0), 1 - _power(apart["lanes"], apart["words"]) / F.nullif(both, F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def next_ids(ids: DataFrame) -> DataFrame:
    """Adds _next to distinct _k: the next greater, after the last the first. Ranges of ids are ordered each on its
    own, and only the first of each range is needed by the range before."""
    part = written(ids.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()), "ids")
    firsts = part.groupBy("_part").agg(F.min("_k").alias("_first"))
    order = Window.orderBy("_part")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_part", F.coalesce(F.lead("_first").over(order), F.min("_first").over(around)).alias("_after"))
    inside = part.withColumn("_n", F.lead("_k").over(Window.partitionBy("_part").orderBy("_k")))
    return inside.join(firsts, "_part").select("_k", "_room", F.coalesce("_n", "_after").alias("_next"))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter replaced by as much of the start of the next document, in order of the id.
    Null texts are empty. A null id comes before all others. Of rows that share an id, the one whose start is least is
    "next" to the id before. A single document is next to itself. Texts travel once, by id, and starts of up to a
    quarter of a text to the document before; keys are ids, so no group is large. Other columns are not read."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ids = rows.groupBy("_k").agg(F.max(F.floor(F.length("_text") / 4)).cast("int").alias("_room"))
    after = written(next_ids(ids), "next")
    want = after.select(F.col("_next").alias("_k"), F.col("_k").alias("_for"), "_room")
    starts = rows.join(want, "_k").select(F.col("_for").alias("_k"), F.expr("left(_text, _room)").alias("_start"))
    starts = starts.groupBy("_k").agg(F.min("_start").alias("_start"))
    n = F.length("_text")
    kept, cut = (n - F.floor(n / 4)).cast("int"), F.floor(n / 4).cast("int")
    both = rows.join(starts, "_k").withColumn("_edited", F.concat(F.left("_text", kept), F.left("_start", cut)))
    both = both.select("_k", "_text", "_edited", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    both = vectors(vectors(both, "_text", "_own"), "_edited", "_other").drop("_text", "_edited")
    both = written(both, "vectors")
    least = both.groupBy("_k").agg(F.min("_own").alias("_after_own")).withColumnRenamed("_k", "_next")
    out = both.join(after.select("_k", "_next"), "_k").join(least, "_next")
    return out.select(
        F.nullif("_k", F.lit(NO_ID)).cast(docs.schema[id].dataType).alias(id), "n_chars", "edited_sha256", text_of(F.col("_own")).alias("fingerprint"), text_of(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_after_own")).alias("near_next"),
    )
