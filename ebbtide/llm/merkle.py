"""A Merkle manifest of a table, with a proof for every row by pointer jumping.

A row's leaf is the SHA-256 of its fields. Within each language the leaves stand
in the order of doc_id, and every eight consecutive nodes make a node of the next
level, until one is left; these roots of the languages, in the languages' order, make the upper
tree in the same way. Each node first holds the segment of siblings between itself and
its parent and points to the parent. In every round a node joins the node it
points to, takes over that one's pointer and appends its segment, so that the
distance doubles; after as many rounds as the depth has binary digits every leaf
points to the root and holds its whole proof. Only nodes whose level is a
multiple of the distance are pointed to, so the joined side shrinks from round to
round by more than the segments grow, and is broadcast once its written size allows.

Places are numbered by value ranges of bounded size, so a language that holds most
of the rows is spread like any other. Only the languages' largest size, their number and
the root reach the driver.

Cases: a null field counts as "-", an empty one as "0:"; a null doc_id comes
first, equal ids follow by leaf, and equal rows take places of their own, so every
row has a proof; a null language is a group of its own, before the others; an
empty table has no rows and no root; texts of any length are hashed whole; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.ordering import running_totals
from ebbtide.session import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8  # nodes in a run
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<place:int,siblings:binary,subroot:binary>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbours can't run together."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(nodes: Column) -> Column:
    """SHA-256, 32 bytes, of 32-byte digests written as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def text_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _levels(nodes: int) -> int:
    """How often ``nodes`` nodes are combined until one is left."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def _climb(nodes: DataFrame, name, levels: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Every level's nodes with the siblings of their run, and the last node of each group.

    ``nodes`` has ``lang``, ``place``, ``n`` (nodes of the group's level),
    ``node`` (the digest) and other columns, which are kept at their own level.
    """
    found, roots = [], None
    for level in range(levels + 1):
        alone = nodes.where("n = 1").select("lang", "node", F.lit(level).alias("level"))
        roots = alone if roots is None else roots.unionByName(alone)
        if level == levels:
            break
        place, run = F.pmod("place", F.lit(FAN)).cast("int"), F.floor(F.col("place") / FAN)
        whole = Window.partitionBy("lang", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        members = nodes.where("n > 1").withColumn("run", run).withColumn("members", F.collect_list("node").over(whole))  # eight at most
        joined = F.aggregate("members", F.lit(b""), lambda a, x: F.concat(a, x))
        members = members.withColumn("joined", joined).drop("members")
        others = F.concat(F.expr(f"substring(joined, 1, 32 * pmod(place, {FAN}))"), F.expr(f"substring(joined, 32 * pmod(place, {FAN}) + 33)"))
        held = stage(
            members.select(
                *[c for c in nodes.columns if c not in ("node", "n")],
                "node",
                F.col("n"),
                F.lit(level).alias("level"),
                name(level, F.col("place"), F.col("lang")).alias("id"),
                name(level + 1, F.col("run"), F.col("lang")).alias("up"),
                place.alias("at"),
                others.alias("siblings"),
                # the first of a run hands on the parent's digest
                F.when(place == 0, digest(F.col("joined"))).alias("parent"),
            ),
            f"{label}-level",
        )
        found.append(held)
        nodes = held.where("at = 0").select("lang", F.floor(F.col("place") / FAN).alias("place"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("node"))
    return found, roots


def _lower_name(level, place: Column, lang: Column) -> Column:
    return F.concat_ws(":", F.lit(level).cast("string"), place.cast("string"), F.coalesce(F.concat(F.lit("="), lang), F.lit("-")))


def _upper_name(level, place: Column, lang: Column) -> Column:
    return F.concat_ws(":", F.lit("top"), F.lit(level).cast("string"), place.cast("string"))


def proofs(docs: DataFrame, tampered: Column | None = None, told: Column | None = None) -> tuple[DataFrame, str | None]:
    """doc_id, ``leaf``, ``told``, ``path`` of each row, and the root (None for an empty table).

    ``told`` is the leaf of a row as it is claimed to be: for rows where
    ``tampered`` holds, its text is the column ``told``, else it is the row's own
    leaf. ``path`` lists, from the leaf to the root, the node's place in its run
    and the run's other digests; ``subroot`` is set where the lower tree ends.
    """
    values = [docs[c] for c in FIELDS]
    own = leaf(values)
    claimed = own if tampered is None else F.when(tampered, leaf([*values[:-1], told])).otherwise(own)
    # equal rows get a key of their own, so that they too are dealt to several ranges
    leaves = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), own.alias("node"), claimed.alias("told"), F.monotonically_increasing_id().alias("row"))
    order = F.struct("lang", "doc_id", "node", "row")
    placed = running_totals(leaves.withColumn("order", order).withColumn("one", F.lit(1).cast("long")), "order", ["one"], ["lang"])
    placed = stage(placed.select("lang", (F.col("cum_one") - 1).alias("place"), F.col("all_one").alias("n"), "node", "doc_id", "told"), "leaves")
    empty = placed.select("doc_id", F.col("node").alias("leaf"), "told", F.lit(None).cast(_PATH).alias("path"))
    largest = placed.agg(F.max("n")).first()[0]
    if largest is None:
        return empty, None
    lower, subroots = _climb(placed, _lower_name, _levels(largest), "merkle")
    # the lower trees' roots are the upper tree's first nodes
    named = stage(subroots.withColumn("order", F.struct("lang")).withColumn("one", F.lit(1).cast("long")), "subroots")
    tops = running_totals(named, "order", ["one"]).select("lang", "level", (F.col("cum_one") - 1).alias("place"), F.col("all_one").alias("n"), "node")
    tops = stage(tops, "subroots")
    langs = tops.count()
    # one group: the name of a language's root tells where it stands
    upper, root = _climb(tops.select(F.lit(None).cast("string").alias("lang"), "place", "n", "node", F.col("lang").alias("of"), F.col("level").alias("ended")), _upper_name, _levels(langs), "merkle-top")
    whole = root.first()["node"]

    segment = lambda mark: F.array(F.struct(F.col("at").alias("place"), "siblings", mark.alias("subroot"))).cast(_PATH)
    nothing = [F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("told")]
    parts = []
    for n, level in enumerate(lower):
        mark = F.lit(None).cast("binary")
        payload = ["doc_id", F.col("node").alias("leaf"), "told"] if n == 0 else nothing
        parts.append(level.select("id", "up", segment(mark).alias("path"), F.lit(n == 0).alias("is_leaf"), F.lit(n).alias("level"), *payload))
    # a language's only leaf is its root: it steps to that node without siblings
    single = placed.where("n = 1").select(
        F.lit(None).cast("string").alias("id"), _lower_name(0, F.col("place"), F.col("lang")).alias("up"), F.array().cast(_PATH).alias("path"), F.lit(True).alias("is_leaf"), F.lit(0).alias("level"), "doc_id", F.col("node").alias("leaf"), "told"
    )
    parts.append(single)
    for n, level in enumerate(upper):
        first = n == 0
        ident = _lower_name(F.col("ended"), F.lit(0), F.col("of")) if first else F.col("id")
        mark = F.col("node") if first else F.lit(None).cast("binary")
        parts.append(level.select(ident.alias("id"), "up", segment(mark).alias("path"), F.lit(False).alias("is_leaf"), F.lit(None).cast("int").alias("level"), *nothing))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)

    depth, distance = 1 + len(lower) + len(upper), 1
    while distance < depth:
        # nodes that some other one points to after this many steps; the upper tree is pointed to from several distances
        pointed = nodes.where(~F.col("is_leaf") & (F.col("level").isNull() | (F.col("level") % distance == 0)))
        pointed = stage(pointed.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("rest")), "pointed")
        going = nodes.where(F.col("level").isNull() | (F.col("level") % (2 * distance) == 0))
        joined = going.join(pointed, "up", "left")
        doubled = joined.select(
            "id", F.coalesce("next", "up").alias("up"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path"), "is_leaf", "level", "doc_id", "leaf", "told"
        )
        distance *= 2
        nodes = stage(doubled, "jumped") if distance < depth else doubled
    done = nodes.where("is_leaf").select("doc_id", "leaf", "told", "path")
    return done, bytes(whole).hex()


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    step = lambda node, x: digest(F.concat(F.substring(x["siblings"], F.lit(1), 32 * x["place"]), node, F.substring(x["siblings"], 32 * x["place"] + 1, F.lit(1 << 30))))
    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, tampered: Column | None = None, told: Column | None = None) -> DataFrame:
    """A row each: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found, root = proofs(docs, tampered, told)
    siblings = F.aggregate("path", F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))
    subroot = F.filter(F.transform("path", lambda x: x["subroot"]), lambda x: x.isNotNull())
    whole = F.lit(root).cast("string")
    out = found.select("doc_id", text_of(F.col("leaf")).alias("leaf"), F.coalesce(text_of(F.get(subroot, F.lit(0))), whole).alias("subroot"), whole.alias("root"), F.sha2(text_of(siblings), 256).alias("proof_sha256"), text_of(fold(F.col("told"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A text with its ASCII capitals made small."""
    return F.translate(text, _UPPER, _LOWER)
