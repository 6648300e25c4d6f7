"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are
range-partitioned and sorted, token counts are summed into distributed prefix
sums (first over key ranges, then inside the one range that holds the cut) and
the source is cut at its exact budget. Budgets above a source's size repeat
whole epochs first. The decision per document then only compares its key with
its source's cut, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged
from .words import WORD

#: The weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and a source at most so many epochs.
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that name a key range: 16 ** DIGITS ranges a source.
DIGITS = 3
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def _tag(source: Column) -> Column:
    """A non-null join key that keeps null apart from every string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def prefixed(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows before in the
    order: sums of range partitions first, then those inside each."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    parts = dealt.groupBy("range").agg(*[F.sum(v).alias(f"sum_{k}") for k, v in sums.items()])
    parts = parts.select("range", *[F.coalesce(F.sum(f"sum_{k}").over(upto), F.lit(0)).alias(f"from_{k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(parts), "range").select(*rows.columns, *[(F.col(f"from_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in sums.items()])


def targets(sized: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: its size and its target.

    Water-filling in closed form: in order of size per weight, a source stops
    at ``epochs`` times its size as long as the level that is left for it and
    all later ones would exceed that; the others share the rest by weight.
    Sources may be many: places and sums come from range partitions.
    """
    sources = sized.groupBy("tag").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    placed = prefixed(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-places")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = placed.withColumn("weight", weight.cast("long"))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    ranked = staged(prefixed(ranked, order, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, "mix-order"), "mix-sums")
    size, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(size) * share - epochs * F.col("size_before")) / (F.lit(weight) - F.col("weight_before"))
    filled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < epochs * F.col("source_size"))
    # the first free source's level holds for all free ones
    first = filled.filter("free").agg(F.min(F.struct("size_before", "weight_before", "level"))).first()[0]
    open_level = F.lit(float("inf") if first is None else first.level)
    target = F.least(open_level * F.col("weight"), (epochs * F.col("source_size")).cast("double"))
    return filled.select("tag", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple = WEIGHTS, seed: int = 0) -> DataFrame:
    """Columns ``doc`` (a struct of all input columns), ``size``, ``source_size``,
    ``target`` and ``taken`` for each row of ``docs`` (doc_id, text, source).

    Null text counts no words and takes none; a null source is a source of its
    own, ordered last; a null doc_id keeps the key of the empty string. Copies
    of a row stand next to each other in the order and are taken one by one, so
    that a cut among them leaves the first ones whole. An empty table gives no
    rows; a very long text may be cut as any other; further columns of any name
    stay inside ``doc``. The same input gives the same mix on every run.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    place = F.struct(
        _key(F.col("doc.doc_id"), seed).alias("key"),
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.col("size"),
        # rows that are alike so far, by the rest of them
        F.xxhash64(F.col("doc.text"), F.to_json(F.struct(*[F.col(f"doc.`{c}`") for c in others])) if others else F.lit("")).alias("rest"),
    )
    keyed = docs.select(doc.alias("doc")).select("doc", _tag(F.col("doc.source")).alias("tag"), word_count(F.col("doc.text")).alias("size")).withColumn("place", place)
    narrow = staged(keyed.select("tag", F.col("doc.source").alias("source"), "size", "place"), "mix")
    plan = staged(targets(narrow, share, epochs, weights), "mix-targets")
    small = plan.count() <= BROADCAST_SOURCES
    side = F.broadcast if small else (lambda x: x)

    budget = F.least(F.floor("target"), epochs * F.col("source_size")).cast("long")
    plan = plan.withColumn("budget", budget).withColumn("whole", F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0L END"))
    plan = plan.withColumn("left", F.col("budget") - F.col("whole") * F.col("source_size"))

    # prefix sums over key ranges, then inside the range that holds the cut
    ranges = narrow.groupBy("tag", F.substring("place.key", 1, DIGITS).alias("range")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.withColumn("upto", F.sum("words").over(upto)).join(side(plan.select("tag", "left")), "tag")
    cut = sums.filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
    cut = cut.select("tag", "range", (F.col("upto") - F.col("words")).alias("offset"), "left")
    inside = narrow.withColumn("range", F.substring("place.key", 1, DIGITS)).join(side(cut), ["tag", "range"])
    inside = inside.groupBy("tag", "place", "size", "offset", "left").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    order = Window.partitionBy("tag").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("end", F.col("offset") + F.sum(words).over(order)).filter(F.col("end") > F.col("left"))
    edge = run.groupBy("tag").agg(F.min(F.struct("place", (F.col("left") - F.col("end") + words).alias("part"), "copies")).alias("edge"))
    plan = staged(plan.join(side(edge), "tag", "left").select("tag", "source_size", "target", "whole", "edge"), "mix-plan")

    planned = keyed.join(F.broadcast(plan) if small else plan, "tag")
    among = F.coalesce((F.col("place") == F.col("edge.place")) & (F.col("edge.copies") > 1), F.lit(False))
    extra = F.when(F.col("place") < F.col("edge.place"), F.col("size")).when(F.col("place") == F.col("edge.place"), F.col("edge.part")).otherwise(0)

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select("doc", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))

    several = plan.filter("edge.copies > 1")
    if several.isEmpty():
        return out(planned, extra)
    # copies at a cut: counted by task, numbered by prefix sums and made anew
    copies = keyed.join(side(several), "tag").filter(among).withColumn("part_id", F.spark_partition_id())
    copies = copies.groupBy("tag", "part_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc", "size", "source_size", "target", "whole", "edge")])
    copies = staged(copies, "mix-copies")
    before = Window.partitionBy("tag").orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    copies = copies.withColumn("at", F.explode(F.expr("sequence(before, before + n - 1)")))
    return out(planned.filter(~among), extra).unionByName(out(copies, F.greatest(F.lit(0), F.least("size", F.col("edge.part") - F.col("at") * F.col("size")))))


def drawn(mixed: DataFrame) -> DataFrame:
    """The texts of the mix: a row for each epoch of a document, the last one
    shortened to the words that its cut leaves. Columns are those of ``doc``."""
    names = mixed.schema["doc"].dataType.names
    rows = mixed.filter("taken > 0").select(
        "doc", "size", F.explode(F.expr("transform(sequence(1L, ceil(taken / size)), i -> least(size, taken - (i - 1) * size))")).alias("words")
    )
    cut = F.col("words") < F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(cut, head).otherwise(F.col("doc.text"))
    out = {c: F.col(f"doc.`{c}`") for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.length(head).cast("long")).otherwise(F.col("doc.n_chars"))
    return rows.select(*[v.alias(k) for k, v in out.items()])
