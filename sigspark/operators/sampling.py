"""Deterministic samples: the order of rows is that of an MD5 of seed and row id, never a draw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark import fixed_values as fv
from sigspark.functions.text import month_key
from sigspark.operators.ranking import top_k
from sigspark.session import persist_table


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def sample_order(key: str, seed: int) -> list[Column]:
    return [draw(key, seed).asc(), F.col(key).asc()]


#: Rows that a task holds before it cuts its strata to their lowest rows, and that it hands on when cutting no longer helps.
HELD_ROWS = 50_000


def lowest_rows(df: DataFrame, strata: list[Column], key: str, seed: int, k: int, by_key: int = 0) -> DataFrame:
    """What a sample needs of a table, from one scan: of each stratum the ``k`` rows that are drawn first, and its number of rows.

    Tasks keep the lowest rows of the strata they see; such parts merge, so the result is small, whatever the size of a
    stratum. (stratum, drawn, n, by_key, row): ``row`` is the whole row; n is a part's count, on one row of each part and
    stratum; ``by_key`` marks rows that are among the ``by_key`` smallest ids. A stratum is a string, null if any of its
    columns is.
    """
    fields = df.columns
    label = F.when(~sum((c.isNull().cast("int") for c in strata), F.lit(0)).cast("boolean"), F.concat_ws("\x1f", *[c.cast("string") for c in strata]))
    staged = df.select(label.alias("stratum"), draw(key, seed).alias("drawn"), F.col(key).alias("id"), F.struct(*fields).alias("row"))
    names = ["stratum", "drawn", "id", "row"]

    def first_of(table: pa.Table) -> np.ndarray:
        """Places of the rows to keep."""
        place = table.append_column("place", pa.array(np.arange(table.num_rows)))
        order = place.select(["stratum", "drawn", "id", "place"]).sort_by([("stratum", "ascending"), ("drawn", "ascending"), ("id", "ascending")])
        label = order["stratum"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        within = np.arange(len(label)) - np.repeat(starts, np.diff(np.append(starts, len(label))))
        return order["place"].to_numpy()[within < k]

    def smallest(table: pa.Table) -> np.ndarray:
        return table.select(["id"]).append_column("place", pa.array(np.arange(table.num_rows))).sort_by("id")["place"].to_numpy()[:by_key]

    def cut(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        kept = np.union1d(first_of(table), smallest(table)) if by_key else np.sort(first_of(table))
        return table.take(pa.array(kept))

    def out(table: pa.Table, counts: dict) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        marks = np.zeros(table.num_rows, dtype=bool)
        marks[smallest(table)] = True
        n, left = [], dict(counts)
        for label in table["stratum"].to_pylist():
            n.append(left.pop(label, 0))
        full = table.append_column("n", pa.array(n, pa.int64())).append_column("by_key", pa.array(marks))
        yield from full.select(["stratum", "drawn", "n", "by_key", "row"]).to_batches(max_chunksize=10_000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], {}
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).select(names))
            for pair in batch.column("stratum").value_counts().to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [cut(pa.concat_tables(held))]
                if held[0].num_rows > HELD_ROWS // 2:  # too many strata to hold: hand on, the parts merge
                    yield from out(held[0], counts)
                    held, counts = [], {}
        if held:
            yield from out(cut(pa.concat_tables(held)), counts)

    schema = T.StructType([*[T.StructField(n, t) for n, t in (("stratum", T.StringType()), ("drawn", T.StringType()), ("n", T.LongType()), ("by_key", T.BooleanType()))], staged.schema["row"]])
    return persist_table(staged.mapInArrow(scan, schema), "sample-candidates")


def ranked(parts: DataFrame, k: int, key: str) -> DataFrame:
    """Candidates with their rank in their stratum, at most ``k`` a stratum (cut before the shuffle)."""
    order = Window.partitionBy("stratum").orderBy("drawn", f"row.{key}")
    return parts.filter("stratum IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quotas(parts: DataFrame, target: int, least: int = 0) -> DataFrame:
    """Rows to take of each stratum, in proportion to its size; a row a stratum."""
    sizes = parts.filter("stratum IS NOT NULL").groupBy("stratum").agg(F.sum("n").alias("size"))
    share = F.bround(F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(1))) * target)
    return sizes.select(F.col("stratum").alias("of"), F.greatest(F.lit(least), share).cast("bigint").alias("quota"))


def month_quotas(counts: DataFrame, group: str, month: str, n: str, target: int) -> DataFrame:
    """Even quotas over months: small months are used up, the rest share one level.

    With months sorted by size, the level is found where filling all remaining months would
    exceed what is left; what does not divide evenly goes to the earliest large months. Only
    counts per (group, month) are touched.
    """
    total = Window.partitionBy(group)
    by_size = total.orderBy(n, month)
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    staged = counts.withColumns(
        {
            "_total": F.sum(n).over(total),
            "_months": F.count(F.lit(1)).over(total),
            "_pos": F.row_number().over(by_size),
            "_used": F.coalesce(F.sum(n).over(before), F.lit(0)),
        }
    )
    share = F.floor((F.lit(target) - F.col("_used")) / (F.col("_months") - F.col("_pos") + 1))
    staged = staged.withColumn("_small", (F.col("_total") <= target) | (F.col(n) <= share))
    # months up to the first one that does not fit its share are small
    blocked = F.max(F.when(~F.col("_small"), 1).otherwise(0)).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    staged = staged.withColumn("_large", blocked == 1)
    large = F.sum(F.when(F.col("_large"), 1).otherwise(0)).over(total)
    small_used = F.sum(F.when(~F.col("_large"), F.col(n)).otherwise(0)).over(total)
    staged = staged.withColumns({"_left": F.lit(target) - small_used, "_n_large": large})
    order = F.sum(F.when(F.col("_large"), 1).otherwise(0)).over(total.orderBy(month).rowsBetween(Window.unboundedPreceding, 0))
    level = F.floor(F.col("_left") / F.nullif(F.col("_n_large"), F.lit(0)))
    extra = F.when(order <= F.col("_left") % F.nullif(F.col("_n_large"), F.lit(0)), 1).otherwise(0)
    quota = F.when(F.col("_large"), level + extra).otherwise(F.col(n))
    return staged.select(group, month, F.col(n).alias("available"), quota.cast("bigint").alias("quota"))


def monthly_sample(df: DataFrame, target: int = 3000, group: str = "ticker_hint", key: str = "text_id", ts: str = "ts", seed: int = 42) -> DataFrame:
    """At most ``target`` rows per group, spread evenly over calendar months."""
    keyed = df.filter(F.col(group).isNotNull()).withColumn("_month", month_key(F.col(ts)))
    counts = keyed.groupBy(group, "_month").agg(F.count(F.lit(1)).alias("_n"))
    quotas = month_quotas(counts, group, "_month", "_n", target)
    quota = F.broadcast(quotas) if _fits(quotas) else quotas
    rows = keyed.withColumn("_m", F.coalesce("_month", F.lit(""))).join(
        quota.select(F.col(group).alias("_g"), F.coalesce("_month", F.lit("")).alias("_qm"), "available", "quota"),
        (F.col(group) == F.col("_g")) & (F.col("_m") == F.col("_qm")),
    )
    whole = rows.filter("available <= quota")
    cut = top_k(
        rows.filter("available > quota"), [group, "_month"], sample_order(key, seed), F.col("quota"), target, F.col(key), "_rank"
    ).drop("_rank")
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


BROADCAST_ROWS = 200_000


def _fits(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Is a small-table candidate really small? Counts at most ``limit + 1`` rows."""
    return table.limit(limit + 1).count() <= limit


def stratified_sample(df: DataFrame, target: int, stratum: str, key: str = "text_id", seed: int = 42) -> DataFrame:
    """Proportional sample of exactly ``target`` rows (all rows when there are fewer).

    A surplus is trimmed, and a deficit topped up, by id.
    """
    parts = lowest_rows(df, [F.col(stratum)], key, seed, target, by_key=target)
    chosen = ranked(parts, target, key).join(quotas(parts, target), F.col("stratum") == F.col("of")).filter("rank <= quota")
    chosen = chosen.select(F.lit(0).alias("late"), "row")
    spare = parts.filter("by_key").select(F.lit(1).alias("late"), "row").orderBy(f"row.{key}").limit(target)
    spare = spare.join(chosen.select(F.col(f"row.{key}").alias("_taken")), F.col(f"row.{key}") == F.col("_taken"), "left_anti")
    return chosen.unionByName(spare).orderBy("late", f"row.{key}").limit(target).select("row.*")


def rare_preserving_sample(
    df: DataFrame, target: int = 500, rare: tuple[str, ...] = ("Credit Event", "Geopolitical", "Regulatory"),
    strata: tuple[str, ...] = ("source", "event_type"), key: str = "text_id", seed: int = 42,
) -> DataFrame:
    """All rare-class rows (up to the target), the rest proportional with at least one per stratum, topped up in drawn order."""
    is_rare = F.coalesce(F.col("event_type").isin(*rare), F.lit(False))
    # all rare rows are one stratum, so its count and its first rows come from the same scan
    parts = lowest_rows(df, [F.when(is_rare, "rare").otherwise("other"), *(F.when(is_rare, "").otherwise(F.col(c)) for c in strata)], key, seed, target)
    of_rare = F.coalesce(F.startswith("stratum", F.lit("rare\x1f")), F.lit(False))
    n_rare = parts.filter(of_rare).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    order = ["drawn", f"row.{key}"]
    rare_rows = parts.filter(of_rare).orderBy(*order).limit(target).select("row.*")
    needed = target - min(target, n_rare)
    if needed == 0:
        return rare_rows
    rest = parts.filter(~of_rare)
    picked = ranked(rest, needed, key).join(quotas(rest, needed, least=1), F.col("stratum") == F.col("of")).filter("rank <= quota")
    picked = picked.select(F.lit(0).alias("late"), "drawn", "row")
    spare = rest.select(F.lit(1).alias("late"), "drawn", "row").join(picked.select(F.col(f"row.{key}").alias("_taken")), F.col(f"row.{key}") == F.col("_taken"), "left_anti")
    return rare_rows.unionByName(picked.unionByName(spare).orderBy("late", *order).limit(needed).select("row.*"))


def uniform_sample(df: DataFrame, n: int, key: str = "text_id", seed: int = 42) -> DataFrame:
    """n rows in hash order: a top-k selection, not a full sort."""
    return df.orderBy(*sample_order(key, seed)).limit(n)


def label_sheet(texts: DataFrame, per_source: int = 40, sources: tuple[str, ...] = ("twitter_kaggle", "newsapi", "gdelt"), seed: int = 42) -> DataFrame:
    """Relevant texts per source with an empty label column; news show their title."""
    pool = texts.filter(F.coalesce("is_relevant", F.lit(False)) & F.col("source").isin(*sources))
    window = Window.partitionBy("source").orderBy(*sample_order("text_id", seed))
    shown = F.when(F.col("source").isin(*fv.NEWS_SOURCES), F.coalesce("title", "text")).otherwise(F.col("text"))
    return (
        pool.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= per_source)
        .select("text_id", "source", shown.alias("text"), F.lit("").alias("my_label"))
    )
