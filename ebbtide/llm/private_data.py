"""Personal data: regular forms, and identifiers found by bootstrapped contexts.

Mail addresses, network addresses, card and phone numbers are found by their
form and checks. They are the seeds of a pattern-instance graph: the words around
a seed are lexical patterns, and so are those around every other token with
digits in it. Scores go back and forth: a pattern's is the share of believed
instances among all its different instances, an instance's belief the chance that
at least one of its patterns is right. Patterns with enough support and a high
score at the end mark tokens that no form covers, as `id`.

Only DataFrame functions are used. Texts are read once; what is kept of each is
its spans, the tokens with digits and the few words around them.

Cases: a null text counts as empty and has no spans; every row gives one row;
repeated rows count as one instance of their patterns; an empty table gives an
empty one. Places are code points, the end exclusive. Matches whose check fails
are dropped and their characters aren't tried again. Regular expressions use
possessive repeats, so that very long runs of digits or letters cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import stage

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

# Each form written so that no place of a run is tried twice: a match can only
# begin where a run of its characters begins or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\s])[^\s0-9]*+[0-9][^\s]*+"


@dataclass(frozen=True)
class Settings:
    rounds: int = 4
    support: int = 3  # different seeds of a pattern
    confidence: float = 0.8  # least score of a pattern that marks new identifiers
    belief: float = 0.8  # least score of an instance that counts as believed in the next round
    context: int = 64  # characters around an instance that are looked at
    digits: int = 4  # least digits of a token that may be an identifier
    longest: int = 64  # most characters of such a token


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def matches(df: DataFrame, text: str, name: str, pattern: str, first: Column, context: int) -> DataFrame:
    """``df`` with the leftmost non-overlapping matches as column ``name``, in order: gap, value, left, right.

    ``gap`` is the number of characters since the match before; ``left`` and
    ``right`` hold up to ``context`` characters between a match and its
    neighbours, with the neighbour. ``first`` is a cheap test that a text with
    a match passes.
    """
    gaps, values = f"_{name}_gaps", f"_{name}_values"
    df = df.withColumn(gaps, F.when(first, F.split(text, pattern, -1)).otherwise(_none("string")))
    df = df.withColumn(values, F.when(first, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none("string")))
    both = F.arrays_zip(
        F.col(gaps).alias("gap"),
        F.col(values).alias("value"),
        F.concat(F.array(F.lit("")), values).alias("before"),
        F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))).alias("next_gap"),
        F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))).alias("after"),
    )

    def match(x, i):
        return F.struct(
            F.lit(name).alias("kind"),
            i.alias("nth"),
            F.length(x["gap"]).cast("long").alias("gap"),
            x["value"].alias("value"),
            F.right(F.concat(x["before"], x["gap"]), F.lit(context)).alias("left"),
            F.left(F.concat(x["next_gap"], F.coalesce(x["after"], F.lit(""))), F.lit(context)).alias("right"),
        )

    return df.withColumn(name, F.transform(F.filter(both, lambda x: x["value"].isNotNull()), match)).drop(gaps, values)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _part_fits(part: Column) -> Column:
    """A number of any length, with leading zeros or without, is at most 255."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.substring(F.concat(F.lit("0"), bare), 1, 4).cast("int") <= 255)


def scan(rows: DataFrame, context: int) -> DataFrame:
    """``rows`` without their ``text``, with all matches of the forms and of tokens with digits as ``matches``."""
    column = F.col("text")
    forms = {
        "email": (F.contains(column, F.lit("@")), EMAIL),
        "ip": (F.rlike(column, F.lit(r"[0-9]\.[0-9]")), IP),
        "card": (F.rlike(column, F.lit("[0-9]")), CARD),
        "phone": (F.rlike(column, F.lit(r"\+[0-9]")), PHONE),
        FOUND: (F.rlike(column, F.lit("[0-9]")), TOKEN),
    }
    for kind, (first, form) in forms.items():
        rows = matches(rows, "text", kind, form, first, context)
    return rows.withColumn("matches", F.concat(*forms)).drop("text", *forms)


def located(found: DataFrame, settings: Settings) -> DataFrame:
    """row, kind, start, end, value, left and right of the matches whose checks hold; ``found`` has row and matches."""
    each = found.where(F.size("matches") > 0).select("row", F.inline("matches"))
    so_far = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    each = each.withColumn("end", so_far).withColumn("start", F.col("end") - F.length("value"))
    digits = _digits(F.col("value"))
    holds = (
        F.when(F.col("kind") == "ip", F.forall(F.split("value", r"\."), _part_fits))
        .when(F.col("kind") == "card", F.length(digits).between(13, 19) & luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .when(F.col("kind") == FOUND, F.length(digits) >= settings.digits)
        .otherwise(True)
    )
    # marks around a token don't belong to it
    bare = F.regexp_extract("value", r"^[^\p{L}\p{N}]*+(.*[\p{L}\p{N}])", 1)
    marks = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*+", 0))
    token = F.col("kind") == FOUND
    each = each.where(holds).withColumn("start", F.when(token, F.col("start") + marks).otherwise(F.col("start")))
    each = each.withColumn("value", F.when(token, bare).otherwise(F.col("value"))).withColumn("end", F.col("start") + F.length("value"))
    return each.where(~token | (F.length("value") <= settings.longest)).select("row", "kind", "start", "end", "value", "left", "right")


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an instance: two words before; the word before and the word after; a label ending in a mark."""
    before = F.filter(F.split(F.lower(left), r"\s+"), lambda w: w != "")
    after = F.filter(F.split(F.lower(right), r"\s+"), lambda w: w != "")
    last, second, following = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.try_element_at(after, F.lit(1))
    # numbers in a context are alike
    plain = lambda w: F.regexp_replace(w, "[0-9]+", "0")
    made = F.array(
        F.concat(F.lit("2:"), plain(second), F.lit(" "), plain(last)),
        F.concat(F.lit("b:"), plain(last), F.lit(" "), plain(following)),
        F.when(last.rlike("[:=#]$"), F.concat(F.lit("m:"), plain(last))),
    )
    # a context of marks alone, as in a table, says nothing
    return F.filter(made, lambda p: p.isNotNull() & F.substring(p, 3, 1 << 20).rlike(r"\p{L}"))


def instances(spans: DataFrame, settings: Settings) -> DataFrame:
    """row, kind, start, end, a hash of the value, and the lexical patterns of each span."""
    # a word cut by the window doesn't count
    left = F.when(F.length("left") < settings.context, F.col("left")).otherwise(F.regexp_replace("left", r"^[^\s]*+", ""))
    right = F.regexp_replace("right", r"^[^\s]*+", "")
    return spans.select("row", "kind", "start", "end", F.xxhash64(F.lower("value")).alias("value"), _patterns(left, right).alias("patterns"))


def confident_patterns(instances: DataFrame, settings: Settings) -> DataFrame:
    """``pattern`` and ``score`` of patterns that mark identifiers; ``instances`` has value, seed and patterns."""
    edges = stage(
        instances.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")),
        "pattern-edges",
    )
    believed = edges.select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief"))
    for _ in range(settings.rounds):
        scores = believed.groupBy("pattern").agg((F.sum("belief") / F.count("*")).alias("score"), F.count_if(F.col("belief") > 0).alias("support"))
        scores = scores.where(F.col("support") >= settings.support)
        beliefs = (
            edges.join(scores, "pattern")
            .groupBy("value")
            # at least one pattern is right: 1 - product of (1 - score)
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("chance"))
            .where(F.col("chance") >= settings.belief)
        )
        believed = stage(
            edges.join(beliefs, "value", "left").select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0))).alias("belief")),
            "pattern-beliefs",
        )
    last = believed.groupBy("pattern").agg((F.sum("belief") / F.count("*")).alias("score"), F.count_if("seed").alias("support"))
    return last.where((F.col("support") >= settings.support) & (F.col("score") >= settings.confidence)).select("pattern", "score")


def find(docs: DataFrame, keep: list[str], settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``keep`` columns, ``base`` (spans found by form) and ``found`` (those found by context), as kind, start and end."""
    names = [F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)]
    rows = docs.select(*[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = stage(scan(rows, settings.context).withColumn("row", F.monotonically_increasing_id()), "private-matches")
    spans = stage(instances(located(rows, settings), settings), "private-spans")
    seeds, tokens = spans.where(F.col("kind") != FOUND), spans.where(F.col("kind") == FOUND)
    # tokens that a form covers are no others
    covered = tokens.join(seeds.select("row", F.col("start").alias("from"), F.col("end").alias("to")), "row")
    covered = covered.where((F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))).select("row", "start", "end").distinct()
    others = tokens.join(covered, ["row", "start", "end"], "left_anti")
    both = seeds.select("value", F.lit(True).alias("seed"), "patterns").unionByName(others.select("value", F.lit(False).alias("seed"), "patterns"))
    good = confident_patterns(both, settings)
    marked = others.select("row", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    marked = marked.select("row", "kind", "start", "end").distinct()
    # kinds in the order in which they are listed, then by place
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = lambda df, name: df.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind"))).alias(name))
    out = rows.select("row", *[f"k_{i}" for i in range(len(keep))]).join(listed(seeds, "base"), "row", "left").join(listed(marked, "found"), "row", "left")
    plain = lambda name: F.coalesce(F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), _none("struct<kind:string,start:bigint,end:bigint>"))
    return out.select(*names, plain("base").alias("base"), plain("found").alias("found"))


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each kind, the hash of the base spans and all spans as text."""
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*keep, *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "found")).alias("spans"))
