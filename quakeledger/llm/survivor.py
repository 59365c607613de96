"""One surviving record for each group of duplicates, by skylines per field.

A field's skyline is the set of records that no other record of the group beats in completeness, trust and recency
together. The surviving value is the skyline's first by a lexicographic policy; where it is missing, the next
dominance layers fill it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldPolicy:
    """A field to be filled. usable: whether a record can give it. ranks: small integers, most important first, larger better.

    The ranks stand for completeness and trust; each takes few distinct values over all data, which bounds what is
    gathered of a group. carry: columns taken over together with the field.
    """

    name: str
    usable: Column
    ranks: tuple[Column, ...]
    carry: tuple[str, ...] = ()


def field_survivors(records: DataFrame, key: str, record_id: str, recency: str, fields: tuple[FieldPolicy, ...]) -> DataFrame:
    """One row for each key with at least two distinct record ids: key, n_cells, and for each field f a struct

    f(record_id, *carry) of the record it comes from, null where no record is usable.

    Hot groups: records are first reduced to cells (key and all ranks) of which only the most recent record can be
    undominated; that pre-aggregation runs before the shuffle and spreads a group over as many reducers as it has cells.
    What is then gathered of a group is bounded by the product of the rank values, not by its size.

    Null keys form no group; null record ids are not counted as records; a null recency is older than any; equal
    records resolve to the larger id; several deliveries of a record count once, with the latest recency. An empty
    table gives an empty result. Columns named like a field do no harm: only key and structs are returned.
    """
    ranks = {f"{f.name}__r{i}": r.cast("int") for f in fields for i, r in enumerate((f.usable.cast("int"), *f.ranks))}
    carried = sorted({c for f in fields for c in f.carry})
    newest = F.struct(F.col(recency).alias("at"), F.col(record_id).alias("id"), *carried)
    cells = (
        records.where(F.col(key).isNotNull() & F.col(record_id).isNotNull())
        .select(F.col(key).alias("__key"), F.col(record_id).alias("__id"), newest.alias("__newest"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in ranks.items()))
        .groupBy("__key", *ranks)
        .agg(F.max("__newest").alias("newest"), F.min("__id").alias("low"), F.max("__id").alias("high"))
    )
    groups = (
        cells.groupBy("__key")
        .agg(F.collect_list(F.struct("newest", *ranks)).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("low") < F.col("high"))
    )
    out = [F.col("__key").alias(key), F.size("cells").alias("n_cells")]
    for f in fields:
        mine = [n for n in ranks if n.startswith(f"{f.name}__r")]
        out.append(_survivor(F.col("cells"), f, mine).alias(f.name))
    return groups.select(*out)


def _survivor(cells: Column, field: FieldPolicy, ranks: list[str]) -> Column:
    """The policy's choice among the usable records of the skyline."""

    def dominates(a: Column, b: Column) -> Column:
        """a is as good as b everywhere and better somewhere; recency (then id) never ties between cells of one group."""
        at = F.coalesce(a["newest"]["at"] >= b["newest"]["at"], b["newest"]["at"].isNull())
        no_worse, better = at, ~F.coalesce(b["newest"]["at"] >= a["newest"]["at"], a["newest"]["at"].isNull())
        for r in ranks:
            no_worse, better = no_worse & (a[r] >= b[r]), better | (a[r] > b[r])
        return no_worse & better

    def skyline(of: Column) -> Column:
        return F.filter(of, lambda c: ~F.exists(of, lambda d: dominates(d, c)))

    # Whether a record can give the field is itself a criterion of dominance, the first of the policy. So the usable record
    # that the policy prefers is beaten by none and stands in the first layer; deeper layers can add nothing.
    usable = F.filter(skyline(cells), lambda c: c[ranks[0]] == 1)
    best = F.array_max(F.transform(usable, lambda c: F.struct(*(c[r].alias(r) for r in ranks), c["newest"].alias("newest"))))
    got = [best["newest"]["id"].alias("record_id"), *(best["newest"][c].alias(c) for c in field.carry)]
    return F.when(best.isNotNull(), F.struct(*got))


def compared_uid(column: str) -> Column:
    """Letters and digits of an identifier in lower case; null where it holds no digit other than 0."""
    uid = F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{Nd}]", "")
    return F.when(uid.rlike("[1-9]"), uid)


def record_survivors(
    records: DataFrame, key: str, record_id: str, recency: str, trust: Column, fields: tuple[str, ...]
) -> DataFrame:
    """One whole record for each key with at least two record ids: key, base_from, each field, the record it is from (f_from) and its layer (f_layer).

    The base is the skyline's first by (filled fields, trust, recency, id). A field missing there comes from the next
    dominance layers across completeness, trust and recency, in order and to the last; within a layer the same policy
    chooses. Records of a group with the same filled fields and the same
    trust are reduced to the most recent one beforehand: the others are dominated by it and could fill nothing more.

    trust is a small integer, larger better; at most 2 ** len(fields) * trusts records of a group are gathered. Missing
    means null or NaN or blank text. Nulls in the key form no group; an empty table gives an empty result; equal
    records resolve to the larger id.
    """
    if clash := {"base_from", key} & set(fields):
        raise ValueError(f"columns {sorted(clash)} are named twice")
    types = dict(records.dtypes)

    def value(f: str) -> Column:
        c = F.col(f)
        if types[f] == "string":
            return F.when(F.trim(c) != "", c)
        return F.when(~F.isnan(c), c) if types[f] in ("double", "float") else c

    named = [F.struct(value(f).alias("v")).alias(f"f{i}") for i, f in enumerate(fields)]
    filled = sum((F.when(value(f).isNotNull(), F.lit(1 << i)).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    cells = (
        records.where(F.col(key).isNotNull() & F.col(record_id).isNotNull())
        .select(
            F.col(key).alias("__key"), F.col(record_id).alias("__id"), filled.alias("mask"), F.coalesce(trust, F.lit(-(2**30))).cast("int").alias("trust"),
            F.struct(F.col(recency).alias("at"), F.col(record_id).alias("id"), *named).alias("__newest"),
        )
        .groupBy("__key", "mask", "trust")
        .agg(F.max("__newest").alias("newest"), F.min("__id").alias("low"), F.max("__id").alias("high"))
    )
    cell = F.struct(F.bit_count("mask").alias("full"), "trust", "newest", "mask")
    groups = cells.groupBy("__key").agg(F.collect_list(cell).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")

    def dominates(a: Column, b: Column) -> Column:
        at = F.coalesce(a["newest"]["at"] >= b["newest"]["at"], b["newest"]["at"].isNull())
        later = ~F.coalesce(b["newest"]["at"] >= a["newest"]["at"], a["newest"]["at"].isNull())
        return at & (a["full"] >= b["full"]) & (a["trust"] >= b["trust"]) & (later | (a["full"] > b["full"]) | (a["trust"] > b["trust"]))

    # A cell's layer is one more than the deepest of those that beat it. These come before it in descending order, so one
    # pass over the ordered cells finds all layers, however many.
    ordered = F.sort_array("cells", asc=False)
    layered = F.transform(ordered, lambda c: F.struct(F.lit(0).alias("layer"), c.alias("cell")))

    def placed(done: Column, c: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: dominates(d["cell"], c)), lambda d: d["layer"])
        return F.concat(done, F.array(F.struct((F.coalesce(F.array_max(above), F.lit(0)) + 1).alias("layer"), c.alias("cell"))))

    groups = groups.withColumn("layers", F.aggregate(ordered, F.slice(layered, 1, 0), placed))
    preferred = F.transform("layers", lambda x: F.struct((-x["layer"]).alias("up"), x["cell"].alias("cell")))
    groups = groups.select("__key", preferred.alias("layers")).withColumn("base", F.array_max("layers"))
    out = [F.col("__key").alias(key), F.col("base.cell.newest.id").alias("base_from")]
    for i, f in enumerate(fields):
        best = F.array_max(F.filter("layers", lambda x: x["cell"]["newest"][f"f{i}"]["v"].isNotNull()))  # noqa: B023
        groups = groups.withColumn(f"best{i}", best)
        at = f"best{i}.cell.newest"
        out += [F.col(f"{at}.f{i}.v").alias(f), F.col(f"{at}.id").alias(f"{f}_from"), (-F.col(f"best{i}.up")).alias(f"{f}_layer")]
    return groups.select(*out)
