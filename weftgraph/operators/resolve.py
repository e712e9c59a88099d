"""Entity resolution: spellings of one entity, and the typed entity that an untyped name stands for.

Names that differ by one letter share a variant: the name itself (place 0), or it
without the letter of one place. Names of one variant are within one letter if
the places are the same or one of them is 0, so nothing is compared. A variant
has few names, those that one more letter can make of it, so no key is hot,
however often a name occurs: each distinct name is one row. Variants are dealt
once and not written; a name is linked with one other of its variant and place,
which is as good for entities as all pairs are.

Names of one type within one letter are one entity, also by way of others. Names
shorter than ``SHORT`` letters match only as they are. Names are compared in
lower case with single spaces; null and empty ones are left out. An empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..storage import numbered, stored
from .joins import components, hot_join

SHORT = 5
UNKNOWN = "UNKNOWN"


def same_spelling(name: Column) -> Column:
    """What names are compared by: lower case, single spaces."""
    return F.lower(collapse(name))


def variants(name: Column) -> Column:
    """The name (place 0) and, where it isn't short, the name without the letter of each place."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
    return F.when(F.length(name) >= SHORT, F.array_prepend(shorter, name)).otherwise(F.array(name))


def _by_variant(names: DataFrame, *columns: str) -> DataFrame:
    """The columns of each name that isn't short, ``variant`` and ``place``."""
    return names.where(F.length("name") >= SHORT).select(*columns, F.posexplode(variants(F.col("name"))).alias("place", "variant"))


def _links(names: DataFrame) -> DataFrame:
    """Links (a, b) of the numbers of names within one letter and of one type, enough of them to reach all that pairs reach."""
    # One exchange and one sort serve both windows.
    of_variant, of_place = Window.partitionBy("type", "variant").orderBy("place", "node"), Window.partitionBy("type", "variant", "place").orderBy("node")
    rows = _by_variant(names, "type", "node").repartition("type", "variant").select("node", F.first(F.struct("place", "node")).over(of_variant).alias("top"), F.first("node").over(of_place).alias("same"))
    return rows.select(F.col("node").alias("a"), F.when(F.col("top.place") == 0, F.col("top.node")).otherwise(F.col("same")).alias("b")).where("a <> b")


def entities(mentions: DataFrame) -> DataFrame:
    """Membership of each typed name (name, type, n): ``entity``, the name that its entity has most often, and ``of_entity``, how often that entity occurs.

    ``mentions`` has name and type, a row each time. Ties go to the name that is less.
    """
    typed = mentions.where((F.coalesce("type", F.lit(UNKNOWN)) != UNKNOWN) & (same_spelling(F.col("name")) != ""))
    names = numbered(typed.groupBy(same_spelling(F.col("name")).alias("name"), "type").agg(F.count(F.lit(1)).alias("n")), "node", "names")
    of = names.join(components(_links(names)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = stored(of, "members")
    best = of.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("low"), "name"))["name"].alias("entity"), F.sum("n").alias("of_entity"), F.count(F.lit(1)).alias("many"))
    return hot_join(of, stored(best, "entities"), "component", "many").select("name", "type", "n", "entity", "of_entity")


def resolved(names: DataFrame, members: DataFrame) -> DataFrame:
    """The typed entity for each distinct ``name`` of a table: (name, entity, type, distance); names without one are left out.

    A typed name that is the same goes before one of another letter, then the
    entity that occurs more often, the name that does, and the order of names decide.
    """
    return _resolved(stored(names.select(same_spelling(F.col("name")).alias("name")).distinct(), "wanted"), members)


def _resolved(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Of distinct spellings. Only names that no typed one equals meet others by variant; what is known of those is joined to the pairs."""
    members, wanted = stored(members, "typed"), wanted.where("name <> ''")
    open_names = wanted.join(members.select("name"), "name", "left_anti")
    a = _by_variant(open_names, "name").withColumnRenamed("place", "at")
    b = _by_variant(members.select("name", F.col("name").alias("typed")), "typed")
    near = a.join(b.hint("merge"), "variant").where("place = at or place = 0 or at = 0").select("name", "typed").distinct()
    of = members.withColumnRenamed("name", "typed")
    met = near.unionByName(wanted.withColumn("typed", F.col("name"))).join(of, "typed")
    distance = F.when(F.col("name") == F.col("typed"), 0).otherwise(1)
    place = F.struct(distance.alias("distance"), (-F.col("of_entity")).alias("low"), (-F.col("n")).alias("lower"), "type", "typed", "entity")
    return met.groupBy("name").agg(F.min(place).alias("p")).select("name", "p.entity", "p.type", "p.distance")


def resolve_ends(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations with their UNKNOWN ends (source, source_type, target, target_type) replaced by the typed entities that these stand for; all rows and columns stay."""
    ends = ("source", "target")

    def open_name(end: str) -> Column:
        return F.when(F.coalesce(f"{end}_type", F.lit(UNKNOWN)) == UNKNOWN, same_spelling(F.col(end)))

    rows = stored(relations, "relations")
    each = rows.select(F.explode(F.array(*[F.struct(open_name(end).alias("name"), *[F.lit(int(end == x)).alias(x) for x in ends]) for end in ends])).alias("e")).select("e.*")
    counts = stored(each.where("name is not null").groupBy("name").agg(*[F.sum(x).alias(x) for x in ends]), "counts")
    known = _resolved(counts.select("name"), members).select("name", "entity", F.col("type").alias("_type"))
    lookup = stored(counts.join(known, "name", "left"), "lookup")
    for end in ends:
        keyed = rows.withColumn("_name", open_name(end))
        own = lookup.where(F.col(end) > 0).select(F.col("name").alias("_name"), "entity", "_type", F.col(end).alias("_n"))
        met = hot_join(keyed, own, "_name", "_n").withColumn(end, F.coalesce("entity", end)).withColumn(f"{end}_type", F.coalesce("_type", f"{end}_type"))
        rows = met.select(*relations.columns).unionByName(keyed.where("_name is null").select(*relations.columns))
        rows = stored(rows, "ends") if end == ends[0] else rows
    return rows
