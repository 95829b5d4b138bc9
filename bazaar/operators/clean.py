"""Cleaning: raw text listings to typed, complete, outlier-free rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present, no_nan, to_number
from bazaar.functions.ordering import ordered_prefix
from bazaar.functions.quantiles import exact_quantiles, summaries
from bazaar.schema import (
    DATE_COLUMNS,
    DEFAULT_ROLES,
    FEATURE_COLUMNS,
    NUMERIC_COLUMNS,
    RAW_COLUMNS,
    REQUIRED_COLUMNS,
    UNKNOWN,
    Roles,
)
from bazaar.session import checkpoint_folder, in_turns, settle, shuffles_removed

# Fixed value: what a date looks like.
DATE_PATTERN = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\z"


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def standardize_columns(df: DataFrame, names: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Rename the first columns by position to ``names``; add missing ones as nulls."""
    kept = df.columns[: len(names)]
    out = df.select([F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    return out.withColumns({n: F.lit(None).cast("string") for n in names[len(kept):]})


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Text to doubles; what does not read as a number becomes null."""
    return df.withColumns({c: to_number(c) for c in _present(df, columns)})


def cast_numeric(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Cast the columns that exist to double."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in _present(df, columns)})


def parse_date(c: str) -> Column:
    text = F.trim(F.col(c).cast("string"))
    dashed = F.replace(text, F.lit("/"), F.lit("-"))
    return F.when(text.rlike(DATE_PATTERN), dashed.try_cast("date"))


def parse_dates(df: DataFrame, columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """``2025-1-5`` or ``2025/01/05`` to a date; anything else becomes null."""
    return df.withColumns({c: parse_date(c) for c in _present(df, columns)})


def derive_stats_month(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Add the month of the collection date, or the label for unknown."""
    (collected,) = roles.of("collection_date")
    month = F.coalesce(F.date_format(collected, "yyyy-MM"), F.lit(UNKNOWN))
    return df.withColumn(roles.stats_month, month)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; missing equals missing, NaN included."""
    return _without_nan(df).dropDuplicates()


def _without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: no_nan(c) for c in _doubles(df)})


def _doubles(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in ("double", "float")]


def settle_unique(df: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """``drop_duplicate_rows`` of all frames together, stored.

    Several frames are brought into buckets one after the other, equal rows into
    the same one, so the disk holds the shuffles of one frame at a time.
    A bucket then finds its duplicates without a shuffle; buckets are removed.
    """
    frames = in_turns(df)
    if len(frames) == 1:
        return settle(drop_duplicate_rows(frames[0]))[0]
    spark, table = frames[0].sparkSession, f"unique_{uuid.uuid4().hex}"
    path, digest = f"{checkpoint_folder(spark)}/{table}", f"_digest_{table}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for frame in frames:
        # Zeros of both signs are equal.
        rows, doubles = _without_nan(frame), _doubles(frame)
        values = [F.col(f"`{c}`") + 0.0 if c in doubles else F.col(f"`{c}`") for c in rows.columns]
        rows = rows.withColumn(digest, F.xxhash64(*values)).repartition(parts, digest)
        with shuffles_removed(spark):
            rows.write.format("parquet").mode("append").bucketBy(parts, digest).options(
                path=path, compression="zstd"
            ).saveAsTable(table)
    unique, _ = settle(spark.table(table).dropDuplicates().drop(digest), compression="zstd")
    spark.sql(f"DROP TABLE {table}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return unique


def fill_median(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Replace missing numbers by the exact median of their column.

    A column without any value is left alone.  Rows are read in several passes:
    store them first if they are costly to work out.
    """
    present = _present(df, columns)
    tidy = df.withColumns({c: no_nan(c) for c in present})
    found = exact_quantiles(tidy, {c: [0.5] for c in present})
    medians = {c: q[0] for c, q in found.items() if q[0] is not None}
    return tidy.fillna(medians) if medians else tidy


def fill_unknown(
    df: DataFrame, columns: Sequence[str] | None = None, label: str = UNKNOWN
) -> DataFrame:
    """Replace missing text by a label, by default in every text column."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.fillna(label, subset=text if columns is None else _present(df, columns))


def remove_outliers_iqr(
    df: DataFrame,
    columns: Sequence[str] = NUMERIC_COLUMNS,
    factor: float = 1.5,
    sequential: bool = True,
) -> DataFrame:
    """Keep rows within ``factor`` interquartile ranges of the quartiles.

    Columns are taken in order, each looking at the rows the earlier ones
    left; with ``sequential=False`` all look at the whole input.  Quartiles of
    several columns are found together: of all of them, or in a sequence of one
    after a column that has removed rows, and of twice as many after others.  A
    column whose quartiles coincide, or that has no values, removes nothing.
    Rows are read in several passes: store them first if they are costly to
    work out.
    """
    present = _present(df, columns)

    def fences(frame: DataFrame, names: list[str]) -> Iterator[tuple[str, Column, bool]]:
        """For each column that has one its test, and whether a row fails it."""
        found = summaries(frame, {c: [0.0, 0.25, 0.75, 1.0] for c in names})
        for c in names:
            least, q1, q3, most = found[c].quantiles
            if q1 is not None and q3 > q1:
                low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
                removes = least < low or most > high or found[c].missing > 0
                yield c, F.col(c).between(low, high), removes

    kept, left = df, present
    ahead = 1 if sequential else len(present)
    while left:
        todo, left = left[:ahead], left[ahead:]
        ahead *= 2
        for c, test, removes in fences(kept, todo):
            if removes:
                kept = kept.where(test)
                # What later columns look like has changed only now.
                if sequential:
                    left, ahead = todo[todo.index(c) + 1 :] + left, 1
                    break
    return kept


def split_single_month(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """If all rows share one known month, label the first half the month before.

    Rows are ordered by institution, project and city, then by their other
    columns.  This makes up a second period, so cleaning leaves it out unless
    asked for.  Rows are read in several passes: store them first if they are
    costly to work out.
    """
    (month,) = roles.of("stats_month")
    known = F.col(month).isNotNull() & ~F.col(month).isin(UNKNOWN, "nan")
    facts = df.agg(
        F.count(F.lit(1)), F.min(F.when(known, F.col(month))), F.max(F.when(known, F.col(month)))
    ).first()
    rows, first, last = facts
    if rows < 2 or first is None or first != last or not _is_month(first):
        return df
    half = rows // 2
    keys = [c for c in roles.of("institution", "project_name", "city") if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c != month]
    earlier = F.date_format(F.add_months(F.to_date(F.lit(f"{first}-01")), -1), "yyyy-MM")

    # Whole key groups go to one side; only the group at the middle is split.  It is
    # found one key at a time, so what is ordered are the values of one column.
    middle, before, within = {}, 0, df
    for c in keys:
        values = within.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        placed = ordered_prefix(values, [F.asc_nulls_last(c)], {"_upto": "_n"})
        found = placed.where(F.col("_upto") > half - before).orderBy("_upto").first()
        middle[c] = found[c]
        before += int(found["_upto"] - found["_n"])
        within = within.where(F.col(c).eqNullSafe(F.lit(found[c])))

    here = F.lit(True)
    ahead = F.lit(False)
    for c in keys:
        value = F.lit(middle[c])
        # Missing keys come last, as in the order above.
        less = F.col(c) < value if middle[c] is not None else F.col(c).isNotNull()
        ahead = ahead | (here & F.coalesce(less, F.lit(False)))
        here = here & F.col(c).eqNullSafe(value)
    outside = df.where(~here).withColumn(month, F.when(ahead, earlier).otherwise(F.lit(first)))
    at_middle = ordered_prefix(df.where(here), [F.asc_nulls_last(c) for c in [*rest, month]])
    split = at_middle.withColumn(
        month, F.when(F.col("position") <= half - before, earlier).otherwise(F.lit(first))
    )
    return outside.unionByName(split.select(df.columns))


def _is_month(text: str) -> bool:
    head, _, tail = text.partition("-")
    return len(head) == 4 and (head + tail).isdigit() and 1 <= int(tail) <= 12


def clean(
    df: DataFrame | Sequence[DataFrame],
    remove_outliers: bool = True,
    split_month: bool = False,
    names: Sequence[str] = RAW_COLUMNS,
) -> DataFrame:
    """The whole cleaning sequence over raw text rows, of one frame or of several in turns."""

    def typed(frame: DataFrame) -> DataFrame:
        out = parse_dates(coerce_numeric(standardize_columns(frame, names)))
        return derive_stats_month(out) if "collection_date" in out.columns else out

    # Medians and quartiles each read the rows again; the shuffle behind the
    # deduplication should run once, and each reading take its column only.
    unique = settle_unique([typed(frame) for frame in in_turns(df)])
    filled = fill_unknown(fill_median(unique))
    if remove_outliers:
        filled = remove_outliers_iqr(filled)
    return split_single_month(filled) if split_month else filled


def drop_null_features(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Drop rows in which any available feature is missing."""
    present = _present(df, features)
    out = df.where(all_present(present))
    for c, kind in df.select(*present).dtypes:
        if kind in ("double", "float"):
            out = out.where(~F.isnan(c))
    return out


def validate_storage(
    df: DataFrame, path: str = "", required: Sequence[str] = REQUIRED_COLUMNS,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """One row saying whether a stored table is fit for analysis."""
    absent = [c for c in required if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("hdfs" if path.startswith("hdfs://") else "local").alias("mode"),
        F.lit(path).alias("parquet_path"),
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(",".join(absent)).alias("missing_required_columns"),
        F.lit(roles.stats_month in df.columns).alias("has_stats_month_col"),
    )


def month_distribution(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows per month, blanks and missing-value words left out."""
    (month,) = roles.of("stats_month")
    label = F.trim(F.col(month).cast("string"))
    return (
        df.select(label.alias("stats_month"))
        .where(~F.col("stats_month").isin("", "nan", "None"))
        .groupBy("stats_month")
        .agg(F.count(F.lit(1)).alias("row_cnt"))
        .orderBy("stats_month")
    )
