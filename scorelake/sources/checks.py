"""Checks of whole nested documents: the first wrong field of each, by its path.

A rule is made for a kind of value, and gives a column from the value (a variant, null where the field is missing) and
its path: null where all is well, else the first fault inside, as (path, reason). Rules nest as documents do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
Rule = Callable[[Column, Column], Column]

# Types that any value of a kind can be read as, and none of another kind.
SHALLOW = {"OBJECT": "struct<_:variant>", "ARRAY": "array<struct<_:variant>>"}


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def fault(path: Column, reason: str) -> Column:
    return F.struct(path.alias("path"), F.lit(reason).alias("reason"))


def is_kind(v: Column, *kinds: str) -> Column:
    """Whether a value that is there is of one of the kinds; false for a missing one. Objects and lists are told without
    a look inside: the schema of one is that of all it holds, and would be made again for each level of a document."""
    known = F.lit(False)
    for k in kinds:
        known = known | (F.try_variant_get(v, "$", SHALLOW[k]).isNotNull() if k in SHALLOW else F.startswith(kind_of(v), F.lit(k)))
    return v.isNotNull() & F.coalesce(known, F.lit(False))


def of(expected: str, good: Callable[[Column], Column], missing: bool = True, empty: bool = False) -> Rule:
    """A rule for a single value. ``missing``: the field may be left out. ``empty``: it may be null in the text."""

    def rule(v: Column, path: Column) -> Column:
        fine = good(v)
        if empty:
            fine = fine | is_kind(v, "VOID")
        if missing:
            fine = fine | v.isNull()
        return F.when(~fine, fault(path, f"expected {expected}"))

    return rule


def integer(**how) -> Rule:
    """A whole number; a truth value or 1.0 is none."""
    return of("an integer", lambda v: is_kind(v, "BIGINT"), **how)


def numeric(**how) -> Rule:
    return of("a number", lambda v: is_kind(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), **how)


def text(**how) -> Rule:
    return of("a string", lambda v: is_kind(v, "STRING"), **how)


def truth(**how) -> Rule:
    return of("true or false", lambda v: is_kind(v, "BOOLEAN"), **how)


def choice(values: Sequence[str], upper: bool = False, missing: bool = True, empty: bool = True) -> Rule:
    """One of these texts."""

    def good(v: Column) -> Column:
        said = F.try_variant_get(v, "$", "string")
        return is_kind(v, "STRING") & F.coalesce((F.upper(said) if upper else said).isin(*values), F.lit(False))

    return of("one of " + " / ".join(values), good, missing=missing, empty=empty)


def one_of(values: Sequence[int], **how) -> Rule:
    """One of these whole numbers."""
    return of("one of " + " / ".join(map(str, values)), lambda v: is_kind(v, "BIGINT") & F.coalesce(F.try_variant_get(v, "$", "bigint").isin(*values), F.lit(False)), **how)


def items(rule: Rule | None = None, expected: str = "a list", each: Callable[[Column], Column] | None = None, size: int | None = None) -> Rule:
    """A list, with a rule for its items, or with a test that all must pass for the list to be right."""

    def check(v: Column, path: Column) -> Column:
        listed = F.try_variant_get(v, "$", "array<variant>")
        good = is_kind(v, "ARRAY")
        if each is not None:
            good = good & F.coalesce(F.forall(listed, each), F.lit(False))
        if size is not None:
            good = good & F.coalesce(F.size(listed) == size, F.lit(False))
        wrong = F.when(v.isNotNull() & ~good, fault(path, f"expected {expected}"))
        if rule is None:
            return wrong
        found = F.transform(listed, lambda x, i: rule(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(wrong, F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0)))

    return check


def obj(**fields: Rule) -> Rule:
    """An object; its fields are checked in the order in which they are named here."""

    def check(v: Column, path: Column) -> Column:
        dot = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
        inside = [rule(F.try_variant_get(v, f"$.{name}", "variant"), F.concat(dot, F.lit(name))) for name, rule in fields.items()]
        return F.coalesce(F.when(~is_kind(v, "OBJECT"), fault(path, "expected an object")), *inside)

    return check


def either(field: str, with_it: Rule, without: Rule) -> Rule:
    """One rule for objects that have a field, another for those that don't."""

    def check(v: Column, path: Column) -> Column:
        return F.when(F.try_variant_get(v, f"$.{field}", "variant").isNull(), without(v, path)).otherwise(with_it(v, path))

    return check


# What a score's fields may hold.
SLIDES_OUT = ("shift", "legato", "out_down", "out_up")
SLIDES_IN = ("below", "above")
HARMONICS = ("natural", "artificial", "pinch", "tap", "semi", "feedback")
DURATIONS = (1, 2, 4, 8, 16, 32, 64)
STEPS = ("C", "D", "E", "F", "G", "A", "B")

NOTE = obj(
    string=integer(), fret=integer(), confidence=numeric(), dead=truth(), tied=truth(), bend=numeric(empty=True), bend_release=truth(),
    slide=choice(SLIDES_OUT), slide_in=choice(SLIDES_IN), hopo=truth(), harmonic=choice(HARMONICS), harmonic_fret=numeric(empty=True),
    vibrato=truth(), palm_mute=truth(), staccato=truth(),
)
BEAT = obj(notes=items(NOTE), duration=integer(), dots=integer(), tuplet=integer(empty=True), rest=truth(), x=integer(), confidence=numeric())
PAIR = items(expected="two integers", each=lambda x: is_kind(x, "BIGINT"), size=2)
MEASURE = obj(beats=items(BEAT), time=PAIR, number=integer(empty=True), line=integer(), x0=integer(), x1=integer(), confidence=numeric())
SCORE = obj(
    measures=items(MEASURE), tuning=items(expected="a list of integers", each=lambda x: is_kind(x, "BIGINT")), strings=integer(),
    tempo=integer(empty=True), title=text(), name=text(),
)
#: A song of tracks, or an older document that is one score.
SONG = either("tracks", obj(tracks=items(SCORE), title=text(), tempo=integer(empty=True)), SCORE)


def number_like(**how) -> Rule:
    """A number, or a text that is a whole one, as older drum documents have them."""
    whole = lambda v: F.try_variant_get(v, "$", "string").try_cast("bigint").isNotNull()
    return of("an integer", lambda v: is_kind(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") | is_kind(v, "STRING") & whole(v), **how)


DRUM_NOTE = obj(step=choice(STEPS, upper=True, missing=False, empty=False), octave=number_like(missing=False))
DRUM_BEAT = obj(duration=one_of(DURATIONS, missing=False), dots=number_like(), tuplet=number_like(empty=True), notes=items(DRUM_NOTE))
DRUM_SCORE = obj(tempo=number_like(), measures=items(obj(voices=items(items(DRUM_BEAT)))))


def checked(df: DataFrame, document: str, rule: Rule) -> DataFrame:
    """``df`` with ``path`` and ``reason`` of the first fault of its text ``document``; both null where it is right.

    Texts that aren't JSON, and null ones, are faults with an empty path. A row is worked out on its own."""
    v = F.try_parse_json(document)
    found = df.withColumn("_v", v).withColumn("_fault", F.when(c("_v").isNull(), fault(F.lit(""), "expected JSON")).otherwise(rule(c("_v"), F.lit(""))))
    return found.select(*df.columns, c("_fault.path").alias("path"), c("_fault.reason").alias("reason"))


def sorted_out(df: DataFrame, document: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(right rows, rejected rows with path and reason)."""
    found = checked(df, document, rule)
    return found.where("reason is null").drop("path", "reason"), found.where("reason is not null").drop(document)
