"""Reconciling two tables, and matching rows to label rows with wildcards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.operators.keys import join_groups
from dayledger.session import kept

#: Label fields that may be wildcards, and the mark of a label row that could not be read whole.
MOST_FIELDS = 8
DAMAGED = "damaged"
#: Values of a part that a scan is filtered by.
LISTED = 1000


def verify_payloads(
    catalogue: DataFrame,
    files: DataFrame,
    path: str = "path",
    size: str = "size",
    digest: str = "md5",
) -> DataFrame:
    """Status of every path on either side. A digest that is not known on both sides is not judged.

    A path that a side holds more than once is a ``duplicate`` with the least size of each side, one
    row however often it is held. Rows without a path are judged side by side, not against each
    other. Both sides are grouped together in one shuffle.
    """
    both = sided(
        catalogue.select(path, F.col(size).alias("size"), F.col(digest).alias("md5")),
        files.select(path, F.col(size).alias("size"), F.col(digest).alias("md5")),
        [path], ["size", "md5"],
    )
    status = (
        F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
        .when(F.col("n_right") == 0, "missing")
        .when(F.col("n_left") == 0, "untracked")
        .when(~F.col("left_size").eqNullSafe(F.col("right_size")), "size_mismatch")
        .when(F.col("left_md5") != F.col("right_md5"), "md5_mismatch")
        .otherwise("ok")
    )
    return both.select(
        path, status.alias("status"), F.col("left_size").alias("expected_size"),
        F.col("right_size").alias("found_size"),
    )


def sided(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per key: its rows on each side (n_left, n_right) and the least of each column there.

    Rows whose key holds a NULL meet only rows of their own side.
    """
    nobody = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    rows = left.select(*key, *columns, F.lit("left").alias("__side")).unionByName(
        right.select(*key, *columns, F.lit("right").alias("__side"))
    )
    sides = ("left", "right")
    return rows.groupBy(*key, F.when(nobody, F.col("__side")).alias("__apart")).agg(
        *[F.count_if(F.col("__side") == s).alias(f"n_{s}") for s in sides],
        *[F.min(F.when(F.col("__side") == s, F.col(c))).alias(f"{s}_{c}") for c in columns for s in sides],
    ).drop("__apart")


def companions(
    df: DataFrame,
    keys: list[str],
    kind: str,
    left: list[str],
    right: list[str],
    how: str | None = None,
) -> DataFrame:
    """Keys (days) by the ``side`` they hold: ``both``, ``left_only`` or ``right_only``.

    One grouped pass with two flags instead of joining the table with itself; ``how`` keeps one
    side.
    """
    side = (
        F.when(F.col("__left") & F.col("__right"), "both")
        .when(F.col("__left"), "left_only")
        .otherwise("right_only")
    )
    sides = (
        df.where(F.col(kind).isin(left + right))
        .groupBy(*keys)
        .agg(
            F.bool_or(F.col(kind).isin(left)).alias("__left"),
            F.bool_or(F.col(kind).isin(right)).alias("__right"),
        )
        .select(*keys, side.alias("side"))
    )
    return sides if how is None else sides.where(F.col("side") == how)


def keys_of(other: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys, so that a hot one is a single row; a NULL is nobody's partner."""
    return other.select(*on).dropna().distinct()


def having(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner in ``other``."""
    return join_groups(df, keys_of(other, on), on, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner in ``other``."""
    return join_groups(df, keys_of(other, on), on, "left_anti")


def snapshot_diff(
    old: DataFrame, new: DataFrame, key: list[str], compare: list[str]
) -> DataFrame:
    """Keys as added, removed, changed or unchanged, with the compared columns of both sides.

    A key that a side holds more than once is a ``duplicate``, one row with the least values of each
    side. Keys that hold a NULL are judged side by side.
    """
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in compare],
    )
    status = (
        F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
        .when(F.col("n_left") == 0, "added")
        .when(F.col("n_right") == 0, "removed")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return sided(old, new, key, compare).select(
        *key, status.alias("status"),
        *[F.col(f"{s}_{c}").alias(f"{name}_{c}") for c in compare
          for s, name in (("left", "old"), ("right", "new"))],
    )


def part_digests(df: DataFrame, parts: list[str], columns: list[str]) -> DataFrame:
    """A digest of the rows of each part: their number and two sums of their hashes.

    The sums do not depend on order, tell repeated rows apart from none, and add up: the digest of a
    year is the sum of those of its days (``rolled_up``).
    """
    own = [F.col(c) for c in dict.fromkeys([*parts, *columns])]
    hashed = [F.xxhash64(*own), F.xxhash64(F.lit(1), *own)]
    return df.groupBy(*parts).agg(
        F.count("*").alias("n_rows"),
        *[F.sum(h.cast("decimal(19,0)")).alias(f"digest_{i}") for i, h in enumerate(hashed)],
    )


def rolled_up(digests: DataFrame, parts: list[str]) -> DataFrame:
    """The digests of coarser parts."""
    sums = [c for c in ("n_rows", "digest_0", "digest_1")]
    return digests.groupBy(*parts).agg(
        *[F.sum(c).cast(digests.schema[c].dataType).alias(c) for c in sums]
    )


def differing_parts(old: DataFrame, new: DataFrame, parts: list[str]) -> DataFrame:
    """The parts whose digests are not the same on both sides.

    ``parts`` goes from coarse to fine: the digests of the coarse parts are compared first, and only
    below those that differ the finer ones.
    """
    found = None
    for depth in range(1, len(parts) + 1):
        level = parts[:depth]
        sides = []
        for side, digests in enumerate((old, new)):
            if found is not None:
                digests = join_groups(digests, found, parts[: depth - 1], "left_semi")
            sides.append(rolled_up(digests, level).withColumn("__side", F.lit(side)))
        values = F.struct("n_rows", "digest_0", "digest_1")
        both = sides[0].unionByName(sides[1]).groupBy(*level).agg(
            F.count("*").alias("__n"), F.min(values).alias("__low"), F.max(values).alias("__high")
        )
        found = both.where((F.col("__n") < 2) | (F.col("__low") != F.col("__high"))).select(*level)
    return found


def snapshot_changes(
    old: DataFrame, new: DataFrame, key: list[str], compare: list[str], parts: list[str],
    digests: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The rows of ``snapshot_diff`` that are not unchanged.

    Parts (years, months, days) whose digests agree are not compared by key. With stored ``digests``
    of both sides (``part_digests`` of key and compared columns) their files are not even read, where
    the tables are partitioned by ``parts``: a column with at most ``LISTED`` values among the
    differing parts is filtered by them in the scan, before the join to the parts.
    """
    columns = [*key, *compare]
    left, right = digests or [part_digests(df, parts, columns) for df in (old, new)]
    differing = kept(differing_parts(left, right, parts), "differing")
    sides = [old, new]
    for part in parts:
        values = [r[0] for r in differing.select(part).distinct().limit(LISTED + 1).collect()]
        if len(values) <= LISTED:
            own = F.col(part).isin([v for v in values if v is not None])
            own = own | F.col(part).isNull() if None in values else own
            sides = [df.where(own) for df in sides]
    some = [join_groups(df, differing, parts, "left_semi") for df in sides]
    return snapshot_diff(*some, key, compare).where("status <> 'unchanged'")


def moved_content(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Added keys whose content was under another key that is gone.

    Keys are unique on each side. The gone side shrinks to one row per digest, its first key, before
    the join, so copies never pair up with copies.
    """
    added = new.select(key, digest).join(old.select(key), key, "left_anti")
    removed = old.select(key, digest).join(new.select(key), key, "left_anti")
    sources = removed.dropna(subset=[digest]).groupBy(digest).agg(
        F.min(key).alias("moved_from"), F.count("*").alias("n_sources")
    )
    return join_groups(added, sources, [digest])


def reconcile_labels(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are in one label form and not in the other."""
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        sides.groupBy(*key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .where("l <> r")
        .select(*key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))
    )


def match_labels(
    flows: DataFrame, labels: DataFrame, on: list[str], fields: dict[str, str]
) -> DataFrame:
    """Every pair of a flow row and a label row that agree on ``on`` and on all set label fields.

    ``fields`` maps flow columns to label columns; a NULL label field matches any value. A label's
    pattern is the list of its set fields. Each flow row is repeated for the patterns that the labels
    of its key have (at most two to the number of fields) with the other fields blanked, and then
    meets the labels in an equi join. Labels that reading has marked as ``damaged`` match nothing:
    a field that could not be read is no wildcard.
    """
    if not on:
        raise ValueError("labels without a common key would match every row")
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"a flow row may be repeated for every pattern of at most {MOST_FIELDS} fields")
    if DAMAGED in labels.columns:
        labels = labels.where(~F.coalesce(F.col(DAMAGED), F.lit(False))).drop(DAMAGED)
    pattern = F.concat(*[
        F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in fields.values()
    ])
    marked = labels.withColumn("__pattern", pattern)
    occurring = marked.dropna(subset=on).groupBy(*on).agg(F.collect_set("__pattern").alias("__patterns"))

    masks = {
        f"__{c}": F.when(F.substring("__pattern", i, 1) == "1", F.col(c))
        for i, c in enumerate(fields, start=1)
    }
    repeated = join_groups(flows, occurring, on).withColumn(
        "__pattern", F.explode("__patterns")
    ).drop("__patterns").withColumns(masks)
    # A set label field cannot match a flow row that lacks the value.
    complete = reduce(
        lambda a, b: a & b,
        [
            (F.substring("__pattern", i, 1) == "0") | F.col(c).isNotNull()
            for i, c in enumerate(fields, start=1)
        ],
    )
    ours, theirs = repeated.where(complete).alias("f"), marked.alias("l")
    agree = [F.col(f"f.{c}") == F.col(f"l.{c}") for c in [*on, "__pattern"]]
    agree += [
        F.col(f"f.__{mine}").eqNullSafe(F.col(f"l.{label}")) for mine, label in fields.items()
    ]
    label_columns = [c for c in labels.columns if c not in [*on, *fields.values()]]
    return ours.join(theirs, reduce(lambda a, b: a & b, agree)).select(
        *[F.col(f"f.{c}") for c in flows.columns], *[F.col(f"l.{c}") for c in label_columns]
    )
