"""Tables of documents, their versions and units: statistics, gates, budgets, merges, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions import text as T

#: Units longer than this are split, into pieces of that size.
OVERSIZE, PIECE = 12_000, 3_000


def first_versions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """content_hash, first key and number of copies of each distinct text; counted before the shuffle."""
    return docs.groupBy(ids.content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias(f"first_{key}"), F.count(F.lit(1)).alias("n_copies"))


def missing(rows: DataFrame, have: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key the other table doesn't have."""
    return rows.join(have.select(F.col(other).alias("__have")), F.col(key) == F.col("__have"), "left_anti")


#: Width of the stretches of a numeric order in which windows over a large part are worked out.
SPAN = 1 << 16


def within_budget(rows: DataFrame, part: str, order: str, size: Column, limit: int, separator: int = 1, span: int = SPAN) -> DataFrame:
    """Rows of each part, in order, up to the first that would pass the budget; the first row always stays.

    used_before is the budget that the rows before took, separators included. `order` is a whole number: sums are made by
    stretches of it and carried over, and stretches that begin past the budget go first, so no task walks a whole part.
    """
    rows = rows.withColumn("__size", size).withColumn("__at", F.floor(F.col(order) / span))
    w = W.partitionBy(part).orderBy("__at")
    sums = rows.groupBy(part, "__at").agg(F.sum(F.col("__size") + separator).alias("__all"))
    sums = sums.select(F.col(part).alias("__part"), F.col("__at").alias("__in"), F.coalesce(F.sum("__all").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__carried"))
    rows = rows.join(sums.where(F.col("__carried") <= limit + separator), F.col(part).eqNullSafe(F.col("__part")) & (F.col("__at") == F.col("__in"))).drop("__part", "__in")
    own = W.partitionBy(part, "__at").orderBy(order)
    rows = rows.withColumn("used_before", F.col("__carried") + F.coalesce(F.sum(F.col("__size") + separator).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = (F.col("__carried") == 0) & (F.row_number().over(own) == 1)
    rows = rows.withColumn("__over", ~first & (F.col("used_before") + F.col("__size") > limit))
    ends = rows.where("__over").groupBy(F.col(part).alias("__part")).agg(F.min(order).alias("__end"))
    rows = rows.join(ends, F.col(part).eqNullSafe(F.col("__part")), "left").where("__end is null or not __over").where(F.col("__end").isNull() | (F.col(order) < F.col("__end")))
    return rows.drop("__over", "__size", "__at", "__carried", "__part", "__end")


def joined_within(rows: DataFrame, part: str, order: str, chunk: Column, budget: int, most: int, separator: str = "\n\n---\n\n", **first: Column) -> DataFrame:
    """part and the chunks of its first `most` rows joined; the chunk that passes the budget is cut, separators don't count. `first` are columns of a part's first row."""
    w = W.partitionBy(part).orderBy(order)
    rows = rows.select(part, F.row_number().over(w).alias("n"), chunk.alias("chunk"), *(c.alias(f"__{name}") for name, c in first.items())).where(F.col("n") <= most)
    used = F.coalesce(F.sum(F.length("chunk")).over(W.partitionBy(part).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(budget) - used).where("left > 0")
    rows = rows.withColumn("chunk", F.substring(F.col("chunk"), F.lit(1), F.col("left").cast("int")))
    pieces = F.array_sort(F.collect_list(F.struct("n", "chunk")))
    ones = [F.max(F.when(F.col("n") == 1, F.col(f"__{name}"))).alias(name) for name in first]
    return rows.groupBy(part).agg(F.array_join(F.transform(pieces, lambda s: s["chunk"]), separator).alias("joined"), *ones)


def persistence(text: Column, kind: Column, pinned: Column, title: Column, units: Column) -> Column:
    """(store, reason) of a fetched document; reason is empty when it may be stored."""
    reason = (
        F.when(T.strip(F.coalesce(text, F.lit(""))) == "", "empty text")
        .when((F.lower(kind) == "bylaw") & ~pinned, "bylaw not pinned")
        .when(T.strip(F.coalesce(title, F.lit(""))) == "", "no real title")
        .when(units == 0, "no units").otherwise("")
    )
    return F.struct((reason == "").alias("store"), reason.alias("reason"))


def identity(text: Column, ident: Column, markers: tuple[str, ...]) -> Column:
    """Whether a page is about the identifier it was asked for: the id occurs, or else a marker."""
    return text.contains(ident) | T.any_of(F.lower(text), markers)


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = (), keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Upsert as a full outer join: new values win, but `keep_first` stay and `keep_if_null` stay where the new one is null."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.withColumn("__a", F.lit(True)).alias("a").join(b.withColumn("__b", F.lit(True)).alias("b"), on, "full_outer")
    out = []
    for c in old.columns:
        was, is_ = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            out.append(F.when(F.col("__b"), is_).otherwise(was).alias(c))
        elif c in keep_first:
            out.append(F.when(F.col("__a"), was).otherwise(is_).alias(c))
        elif c in keep_if_null:
            out.append(F.coalesce(is_, was).alias(c))
        else:
            out.append(F.when(F.col("__b"), is_).otherwise(was).alias(c))
    return both.select(*out)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in a total order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def versions(arrivals: DataFrame, key: str, content_hash: str, arrived: str, amended: str | None = None) -> DataFrame:
    """Versions from arrivals: a text that came before isn't a new version and doesn't become current again.

    key, content_hash, effective_from (first arrival), effective_to, status; effective_to is the next version's
    amendment date, else its arrival, less nothing.
    """
    return chained(latest(arrivals, [key, content_hash], F.col(arrived).asc()), key, content_hash, arrived, amended)


def chained(first: DataFrame, key: str, content_hash: str, arrived: str, amended: str | None = None) -> DataFrame:
    """versions() of first arrivals, which have one row for each key and content_hash."""
    w = W.partitionBy(key).orderBy(arrived, content_hash)
    nxt = F.lead(F.coalesce(F.col(amended), F.col(arrived)) if amended else F.col(arrived)).over(w)
    return first.select(key, content_hash, F.col(arrived).alias("effective_from"), nxt.alias("effective_to"), F.when(nxt.isNull(), "current").otherwise("superseded").alias("status"))


def split_oversize(units: DataFrame, key: str, body: str, over: int = OVERSIZE, piece: int = PIECE) -> DataFrame:
    """Units, the long ones in pieces: the first keeps its key, others are key#2 and so on; ordinal of the piece in chunk_no."""
    n = F.when(F.length(body) > over, F.ceil(F.length(body) / piece)).otherwise(1).cast("int")
    rows = units.withColumn("chunk_no", F.explode(F.sequence(F.lit(1), n)))
    cut = F.when(F.length(body) > over, F.substring(F.col(body), (F.col("chunk_no") - 1) * piece + 1, F.lit(piece))).otherwise(F.col(body))
    name = F.when(F.col("chunk_no") > 1, F.concat(F.col(key), F.lit("#"), F.col("chunk_no").cast("string"))).otherwise(F.col(key))
    return rows.withColumns({key: name, body: cut})


def fuzzy_units(requests: DataFrame, units: DataFrame, law: str, asked: str, key: str, ordinal: str) -> DataFrame:
    """Each request (its own columns, with `law` and `asked`) with the unit of its law that it names: the one with that key, else the first by `ordinal` whose key goes on with a hyphen or a dot after it; requests that name none have nulls.

    A key meets a request by one of its beginnings that end before a hyphen or dot, so both ways are one equi-join.
    Columns of the unit are in the struct `unit`; dashes of a request count as hyphens, blanks at its ends don't count.
    """
    chars = F.split(F.col(key), "")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key))), lambda i: F.get(chars, i).isin("-", "."))
    theirs = units.withColumn("__unit", F.struct(*units.columns)).withColumn("__starts", F.concat(F.array(F.col(key)), F.transform(ends, lambda i: F.substring(F.col(key), F.lit(1), i))))
    theirs = theirs.select(F.col(law).alias("__law"), F.col(ordinal).alias("__ordinal"), F.col(key).alias("__key"), "__unit", F.explode(F.array_distinct("__starts")).alias("__start")).where("__start <> ''")
    wanted = requests.withColumn("__asked", F.translate(F.trim(F.col(asked)), "–", "-"))
    keys = wanted.select(F.col(law).alias("__of"), F.col("__asked").alias("__wanted")).distinct()
    met = keys.join(theirs, (F.col("__of") == F.col("__law")) & (F.col("__wanted") == F.col("__start")))
    best = met.groupBy("__of", "__wanted").agg(F.min_by("__unit", F.struct((F.col("__key") != F.col("__wanted")), "__ordinal", "__key")).alias("unit"))
    return wanted.join(best, F.col(law).eqNullSafe(F.col("__of")) & F.col("__asked").eqNullSafe(F.col("__wanted")), "left").drop("__asked", "__of", "__wanted")


def fuzzy_unit(units: DataFrame, key: str, ordinal: str, asked: str) -> DataFrame:
    """The unit with the key asked for, else the first whose key starts with it and a hyphen or dot."""
    rank = F.when(F.col(key) == asked, 0).when(F.col(key).startswith(asked + "-") | F.col(key).startswith(asked + "."), 1)
    return units.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", ordinal).limit(1).drop("__rank")


def replace_oversize(units: DataFrame, vectors: DataFrame, unit: str, key: str, body: str, over: int = OVERSIZE, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Units with the long ones replaced by their pieces (`unit` is null for the new ones, chunk_no counts), and the vectors of the units that stay as they are; to be written in one step with replace_tables()."""
    long = F.length(body) > over
    pieces = split_oversize(units.where(long), key, body, over, piece).withColumn(unit, F.lit(None).cast(units.schema[unit].dataType))
    stay = units.where(~F.coalesce(long, F.lit(False))).withColumn("chunk_no", F.lit(1))
    gone = units.where(long).select(F.col(unit).alias("__gone"))
    return stay.unionByName(pieces), vectors.join(gone, F.col(unit) == F.col("__gone"), "left_anti")


def merge_vectors(old: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """Upsert of vectors: the new one wins, with all its columns; empty and null ones are skipped, so an old one stays."""
    usable = new.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    kept = old.join(usable.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")
    return kept.unionByName(usable)
