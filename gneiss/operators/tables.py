"""Redundancy in tables. A table is a set of rows of a DataFrame: `by` names the columns that tell tables apart, `order` the
columns that order a table's rows. Long form: (by..., row, col, value), all values strings, missing ones empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as tx
from gneiss.functions.tokens import Counter, chars

#: Columns of the long form, which no key may be called.
LONG = ("row", "ci", "col", "value", "code", "mark")


def keys(by: list[str]) -> list[str]:
    """The keys, if they clash with no column of the long form. Columns inside are called _g_ and a name."""
    if bad := [k for k in by if k in LONG or k.startswith("_g_")]:
        raise ValueError(f"keys may not be called {', '.join(bad)}")
    return by


def to_cells(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """One row a cell. The row number is counted inside each table."""
    row = F.row_number().over(Window.partitionBy(*keys(by)).orderBy(*order)) - 1
    cells = F.posexplode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return df.withColumn("_g_row", row).select(*by, "_g_row", cells.alias("ci", "_g_c")).select(*by, F.col("_g_row").alias("row"), "ci", "_g_c.col", "_g_c.value")


def constant_columns(df: DataFrame, columns: list[str], by: list[str], least_rows: int = 4) -> DataFrame:
    """(by..., col, value): columns with one value, never missing, in tables of enough rows. One pass, partial aggregates."""
    agg = [F.count("*").alias("_g_n")]
    for i, c in enumerate(columns):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        agg += [F.min(v).alias(f"_g_lo{i}"), F.max(v).alias(f"_g_hi{i}")]
    g = df.groupBy(*keys(by)).agg(*agg).filter(F.col("_g_n") >= least_rows)
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_g_lo{i}").alias("value"), (F.col(f"_g_lo{i}") == F.col(f"_g_hi{i}")).alias("same")) for i, c in enumerate(columns)]))
    return g.select(*by, found.alias("_g_f")).filter("_g_f.same and _g_f.value <> ''").select(*by, "_g_f.col", "_g_f.value")


def unit_marks(cells: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """(by..., ci, col, mark): columns whose values are numbers that all carry the same currency or percent sign."""
    mark = tx.mark_of(F.col("value"))
    g = cells.filter("value <> ''").groupBy(*keys(by), "ci", "col").agg(F.count("*").alias("_g_n"), F.count(mark).alias("_g_m"), F.min(mark).alias("mark"), F.max(mark).alias("_g_other"))
    return g.filter((F.col("_g_n") >= least) & (F.col("_g_n") == F.col("_g_m")) & (F.col("mark") == F.col("_g_other"))).select(*by, "ci", "col", "mark")


def hoist_units(cells: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Cells with the mark in the column's name."""
    marks = unit_marks(cells, by, least).drop("col")
    c = cells.join(marks, [*by, "ci"], "left")
    has = F.col("mark").isNotNull()
    bare = F.expr("concat(substring_index(value, mark, 1), substring(value, length(substring_index(value, mark, 1)) + 1 + length(mark)))")
    return c.select(*by, "row", "ci", F.when(has, F.concat("col", F.lit("("), "mark", F.lit(")"))).otherwise(F.col("col")).alias("col"), F.when(has & F.contains("value", "mark"), bare).otherwise(F.col("value")).alias("value"))


def ditto(value: Column, above: Column, count: Counter = chars) -> Column:
    return F.when((value == above) & (value != "") & (count(value) > 1), F.lit("^")).otherwise(tx.escape_caret(value))


def elide_repeats(df: DataFrame, columns: list[str], by: list[str], order: list[str], count: Counter = chars) -> DataFrame:
    """A caret for a value that equals the one above it (in the input). One window for all columns."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
    return s.withColumns({c: ditto(F.col(c), F.lag(c).over(w), count) for c in columns})


def restore_repeats(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """The inverse: a caret takes the last value above it; one without any above stays."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: tx.unescape_caret(F.coalesce(F.last(F.when(F.col(c) != "^", F.col(c)), ignorenulls=True).over(w), F.col(c))) for c in columns})


def code_name(n: Column) -> Column:
    """a..z, aa..zz, aaa..: the n-th code, from 0, of any length. Each letter is a digit from 1 to 26."""
    letters = F.struct((n.cast("long") + 1).alias("rest"), F.lit("").alias("name"))
    add = lambda a, _: F.when(a["rest"] == 0, a).otherwise(F.struct(F.floor((a["rest"] - 1) / 26).alias("rest"), F.concat(F.char((97 + (a["rest"] - 1) % 26).cast("int")), a["name"]).alias("name")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), letters, add, lambda a: a["name"])


def code_place(name: Column) -> Column:
    """The inverse of code_name."""
    return F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + (F.ascii(c) - 96))) - 1


def column_profile(cells: DataFrame, by: list[str], count: Counter = chars) -> DataFrame:
    """(by..., ci, col, n, distinct, widest, before): the facts that decide whether a column is worth codes. Token counts
    are taken once per different value, not once per cell."""
    g = cells.filter("value <> ''").groupBy(*keys(by), "ci", "col", "value").agg(F.count("*").alias("_g_k"))
    g = g.withColumn("_g_t", count(F.col("value")))
    return g.groupBy(*by, "ci", "col").agg(F.sum("_g_k").alias("n"), F.count("*").alias("distinct"), F.max("_g_t").alias("widest"), F.sum(F.col("_g_k") * F.col("_g_t")).alias("before"))


def codebooks(cells: DataFrame, by: list[str], count: Counter = chars, least_rows: int = 12, least_saving: int = 40, least_share: float = 0.10) -> DataFrame:
    """(by..., ci, col, code, value) of the columns that pay for codes.

    Codes go to the different values in code-point order. Names that occur as short cells of the table are left out, and
    so are names that earlier columns of the table have taken: a column's codes start where those of the paying columns
    before it end, so one window over the different values (never over the rows) replaces a loop over columns.
    """
    values = cells.filter("value <> ''").groupBy(*keys(by), "ci", "col", "value").agg(F.count("*").alias("_g_k"))
    values = values.withColumn("_g_t", count(F.col("value")))
    k, t, n, d, before = (F.col(f"_g_{x}") for x in ("k", "t", "n", "d", "before"))
    facts = values.groupBy(*by, "ci").agg(F.sum(k).alias("_g_n"), F.count("*").alias("_g_d"), F.max(t).alias("_g_widest"), F.sum(k * t).alias("_g_before"), F.sum(t + 2).alias("_g_book"))
    saving = before - n - F.col("_g_book") - 3
    pays = (n >= least_rows) & (d >= 2) & (d <= F.greatest(F.lit(1), F.floor(n / 3))) & (F.col("_g_widest") >= 2) & (saving >= least_saving) & (saving >= least_share * before)
    short = cells.select(*by, F.trim("value").alias("_g_name")).filter((F.length("_g_name") <= 3) & F.col("_g_name").rlike("^[a-z]+$")).distinct()
    inside = Window.partitionBy(*by).orderBy("ci", "value")
    ranked = values.join(facts.filter(pays).select(*by, "ci"), [*by, "ci"]).withColumn("_g_i", F.row_number().over(inside).cast("long") - 1)
    # the i-th free name: the taken ones are few, so each value steps over those at or before its place
    taken = short.groupBy(*by).agg(F.array_sort(F.collect_set(code_place(F.col("_g_name")))).alias("_g_taken"))
    free = F.expr("aggregate(coalesce(_g_taken, cast(array() as array<bigint>)), _g_i, (a, x) -> if(x <= a, a + 1, a))")
    same = lambda d: d.withColumn("_g_one", F.lit(1))  # noqa: E731  there may be no keys
    ranked = same(ranked).join(same(taken), [*by, "_g_one"], "left").withColumn("_g_i", free)
    return ranked.select(*by, "ci", "col", code_name(F.col("_g_i")).alias("code"), "value")


def encode(cells: DataFrame, books: DataFrame, by: list[str]) -> DataFrame:
    b = books.select(*by, "ci", "code", "value")
    return cells.join(b, [*by, "ci", "value"], "left").select(*by, "row", "ci", "col", F.coalesce("code", "value").alias("value"))


def decode(cells: DataFrame, books: DataFrame, by: list[str]) -> DataFrame:
    b = books.select(*by, "ci", F.col("code").alias("value"), F.col("value").alias("full"))
    return cells.join(b, [*by, "ci", "value"], "left").select(*by, "row", "ci", "col", F.coalesce("full", "value").alias("value"))


def unique_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, unique): which columns could be a key."""
    g = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), (F.col(c) == F.col("n")).alias("unique")) for c in columns])).alias("x")).select("x.*")


def key_column(old: DataFrame, new: DataFrame, columns: list[str]) -> str | None:
    """The first column without repeats on both sides."""
    good = [{r.col for r in unique_columns(d, columns).collect() if r.unique} for d in (old, new)]  # a row a column
    return next((c for c in columns if c in good[0] & good[1]), None)


def diff_keyed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, col, before, after): added and removed rows (col empty), and changed cells."""
    o = old.select(F.col(key).alias("key"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).alias("o"))
    n = new.select(F.col(key).alias("key"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).alias("n"))
    j = o.join(n, "key", "full").filter("o is null or n is null or o <> n")
    whole = F.array(F.struct(F.lit("").alias("col"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"o.{c}").alias("before"), F.col(f"n.{c}").alias("after")) for c in columns]), lambda x: x["before"] != x["after"])
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return j.select("key", change.alias("change"), F.explode(F.when(change == "changed", cells).otherwise(whole)).alias("x")).select("key", "change", "x.*")
