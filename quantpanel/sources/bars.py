"""Daily bars and the dimensions around them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_symbol():
    return Window.partitionBy("symbol").orderBy("trade_date")

#: Rows of a partition of dealt bars; a size of work, results do not depend on it.
PART_ROWS = 250_000

BARS = "symbol string, trade_date date, open double, close double, high double, low double, volume double, amount double, pct_change double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Scan of stored bars; a symbol predicate reaches the files, an unreadable file fails the scan."""
    df = spark.read.schema(BARS).option("ignoreCorruptFiles", "false").parquet(path)
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def scan_state(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, n_bars, state) of each symbol asked for: missing where no bars are stored, else stored."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    df = universe.select("symbol").distinct().join(n, "symbol", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    return df.withColumn("state", F.when(F.col("n_bars") > 0, "stored").otherwise("missing"))


def history(bars: DataFrame, as_of, days: int) -> DataFrame:
    """The last `days` bars of each symbol up to a date, with return_pct from the vendor or the closes."""
    df = bars.where(F.col("trade_date") <= F.lit(as_of).cast("date")).select("symbol", "trade_date", "close", "amount", "pct_change")
    df = df.withColumn("return_pct", F.coalesce("pct_change", (F.try_divide("close", F.lag("close").over(by_symbol())) - 1) * 100))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    return df.withColumn("_n", newest).where(F.col("_n") <= days).drop("_n", "pct_change")


def write_bars(bars: DataFrame, path: str, parts: int = 8) -> None:
    """Bars by month, a month in `parts` files (S3, S16). Rows of a symbol and date that are written again replace the stored
    ones; other symbols and dates of their months stay, and so do other months.

    Months that change are merged beside the store first, as a table can't be read and replaced at once.
    """
    spark = bars.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    monthly = bars.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    staged = f"{path.rstrip('/')}-merge-{uuid.uuid4().hex}"
    if fs.exists(target):
        stored = spark.read.schema(monthly.schema).parquet(path).join(F.broadcast(monthly.select("month").distinct()), "month", "left_semi")  # months are a calendar
        kept = stored.join(monthly.select("symbol", "trade_date").distinct(), ["symbol", "trade_date"], "left_anti")
        kept.unionByName(monthly).write.parquet(staged)
        monthly = spark.read.schema(monthly.schema).parquet(staged)
    dealt = monthly.repartition("month", F.pmod(F.hash("symbol"), F.lit(parts)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema: str, aliases: dict[str, str], key: str = "symbol") -> DataFrame:
    """A stored report under its own column names, the first row of each key in the order of the file."""
    raw = spark.read.option("header", "true").csv(path).withColumn("_at", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()))
    df = raw.withColumnsRenamed({a: c for a, c in aliases.items() if a in raw.columns})
    df = df.select(*[F.expr(f"try_cast(`{n.split()[0]}` as {n.split()[1]})").alias(n.split()[0]) for n in (x.strip() for x in schema.split(","))], "_at")
    order = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return df.withColumn("_n", order).where("_n = 1").drop("_n", "_at")


def newest_reports(reports: DataFrame, as_of, n: int) -> DataFrame:
    """Rows of the n newest report dates up to a date."""
    df = reports.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    days = df.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return df.join(F.broadcast(days), "trade_date", "left_semi")  # n rows


def refresh(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """The new universe, or the stored one where the new is empty."""
    return cached if fresh.isEmpty() else fresh


def first_names(*sources: DataFrame) -> DataFrame:
    """(symbol, name) with the name of the first source that has one."""
    both = None
    for k, df in enumerate(sources):
        part = df.where("name is not null and name <> ''").select("symbol", "name", F.lit(k).alias("_k"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("symbol").agg(F.min(F.struct("_k", "name")).alias("n")).select("symbol", "n.name")


def replace_date(stored: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """A rolling report with the rows of current's dates replaced, newest date and largest score first."""
    days = current.select("trade_date").distinct()
    return stored.join(F.broadcast(days), "trade_date", "left_anti").unionByName(current).orderBy(F.desc("trade_date"), F.desc(score), "symbol")  # a date or a few


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df dealt by keys over `parts` partitions; without a number, as many as the session shuffles to."""
    return df.repartition(*keys) if parts is None else df.repartition(parts, *keys)


def parts_of(df: DataFrame, rows: int = PART_ROWS) -> int | None:
    """Partitions of about `rows` rows of a stored table, so that no task grows with it; None where the session's number does."""
    n = -(-df.count() // rows)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def derive_bars(lineitem: DataFrame, k: float = 0.1, parts: int | None = None) -> DataFrame:
    """Bars of each supplier and ship date: moves of its mean price about its own mean, compounded from 10.

    The lines are dealt by symbol once, over `parts` partitions; days and all windows of a symbol are made where they lie, in one sort.
    """
    lines = lineitem.withColumns({"symbol": F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), "trade_date": F.to_date("l_shipdate")}).drop("l_suppkey", "l_shipdate")
    day = dealt(lines, parts, "symbol").groupBy("symbol", "trade_date")
    day = day.agg(F.avg("l_extendedprice").alias("e"), F.max("l_tax").alias("tx"), F.max("l_discount").alias("ds"), F.sum("l_quantity").alias("volume"))
    r = k * (F.col("e") / F.avg("e").over(by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1)
    close = F.round(10 * F.exp(F.sum(F.log1p("r")).over(by_symbol())), 4)
    df = day.withColumn("r", r).withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(by_symbol()), "close"))
    # a tenth of a millionth keeps products of four digits and quarters of percents off the edges of rounding
    high, low = F.round(F.greatest("open", "close") * (1 + F.col("tx") / 4) + 1e-7, 4), F.round(F.least("open", "close") * (1 - F.col("ds") / 4) + 1e-7, 4)
    return df.select("symbol", "trade_date", "open", "close", high.alias("high"), low.alias("low"), "volume", (F.col("volume") * F.col("close")).alias("amount"), (100 * F.col("r")).alias("pct_change"))


def bar_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions over which steps that deal the bars anew spread them, as bars_of does."""
    return parts_of(table(spark, sf_dir, "lineitem"))


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_discount", "l_quantity")
    return derive_bars(lines, parts=parts_of(lines))


#: Frames that several steps of a query read, stored from its declaration to that of the next one.
_HELD: dict[object, DataFrame] = {}


def held(df: DataFrame) -> DataFrame:
    """df stored when first read, until the next query is declared; its partitions and order stay."""
    return _HELD.setdefault(object(), df.persist())


def held_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_of, worked out once for all steps of a query."""
    if sf_dir not in _HELD:
        _HELD[sf_dir] = bars_of(spark, sf_dir).persist()
    return _HELD[sf_dir]


def release() -> None:
    """Frames of the query before go, so no query reads what another one stored."""
    while _HELD:
        _, df = _HELD.popitem()
        try:
            df.unpersist()
        except Exception:  # its session has ended
            continue


def membership_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector_type, sector_label): the region of each supplier as its industry."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    df = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # fixed dimensions
    return df.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.lit("industry").alias("sector_type"), F.col("r_name").alias("sector_label"))


def normalise_vendor_bars(raw: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Numbers by try_cast; change, pct_change and amplitude derived where the vendor has none."""
    num = [c for c in ("open", "close", "high", "low", "volume", "amount", "change", "pct_change", "amplitude") if c in raw.columns]
    df = raw.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in num}).withColumn("symbol", normalise_symbol(F.col(symbol))).withColumn("trade_date", F.to_date("trade_date"))
    before = F.lag("close").over(by_symbol())
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("double")
    return df.withColumns({
        "change": F.coalesce(have("change"), F.col("close") - before),
        "pct_change": F.coalesce(have("pct_change"), (F.try_divide(F.col("close"), before) - 1) * 100),
        "amplitude": F.coalesce(have("amplitude"), F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100),
    })


def missing_ranges(cached: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, start_date, end_date) of what a request from first to last needs before and after the cached span."""
    span = cached.groupBy("symbol").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    gaps = F.array(F.struct(a.alias("start_date"), F.least(b, F.date_sub("lo", 1)).alias("end_date")), F.struct(F.greatest(a, F.date_add("hi", 1)).alias("start_date"), b.alias("end_date")))
    return span.select("symbol", F.explode(gaps).alias("g")).select("symbol", "g.start_date", "g.end_date").where("start_date <= end_date")


def upsert(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace cached ones of the same symbol and date."""
    both = cached.withColumn("_rank", F.lit(1)).unionByName(fresh.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("symbol", "trade_date").orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def normalise_symbol(c: F.Column) -> F.Column:
    """The last six digits, zero-padded; null without digits (F1)."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), '[="\\s]', ''), r"\.0$", ""), "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.substring(F.concat(F.lit("000000"), digits), -6, 6))


def classify_board(instruments: DataFrame) -> DataFrame:
    """Exchange, board, ST and suspension of (symbol, name, trade_status); the main board without ST stays."""
    board = F.when(F.col("symbol").rlike("^(600|601|603|605)"), "sse_main").when(F.col("symbol").rlike("^(000|001|002|003)"), "szse_main")
    df = instruments.withColumns({"board": board, "exchange": F.when(F.col("symbol").startswith("6"), "SSE").otherwise("SZSE"), "is_st": F.upper("name").contains("ST"), "is_suspended": F.coalesce(F.col("trade_status") != "1", F.lit(False))})
    return df.where("board is not null and not is_st")


def normalise_quotes(raw: DataFrame) -> DataFrame:
    """Quotes with the date of quote_datetime, else quote_date, else today; numbers by try_cast; provisional."""
    num = [c for c in ("open", "close", "high", "low", "pre_close", "volume", "amount") if c in raw.columns]
    at = F.expr("try_to_timestamp(cast(quote_datetime as string))")
    df = raw.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in num}).withColumn("quote_datetime", at).withColumn("symbol", normalise_symbol(F.col("symbol")))
    day = F.coalesce(F.to_date("quote_datetime"), F.expr("try_cast(quote_date as date)"), F.current_date())
    return df.withColumns({"trade_date": day, "is_provisional": F.lit(True)}).where("symbol is not null")


def parse_quote_lines(lines: DataFrame) -> DataFrame:
    """Columns of raw feed lines `var hq_str_xx000000="name,open,..."` in `value`."""
    f = F.split(F.regexp_extract("value", '"([^"]*)"', 1), ",")
    num = lambda i: F.expr(f"try_cast(f[{i}] as double)")
    df = lines.withColumn("f", f).withColumn("symbol", F.regexp_extract("value", r"hq_str_[a-z]*(\d{6})", 1)).where("symbol <> '' and size(f) >= 32")
    names = ("open", "pre_close", "close", "high", "low")
    df = df.select("symbol", F.col("f")[0].alias("name"), *[num(i + 1).alias(n) for i, n in enumerate(names)], num(8).alias("volume"), num(9).alias("amount"), F.col("f")[30].alias("quote_date"), F.col("f")[31].alias("quote_time"))
    return df.withColumn("quote_datetime", F.expr("try_to_timestamp(concat(quote_date, ' ', quote_time))")).withColumn("pct_change", (F.try_divide("close", "pre_close") - 1) * 100)
