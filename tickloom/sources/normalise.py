"""Landed text files as typed tables. All parsing is column expressions over string columns; rows that
break a file's own rules are dropped or rejected as whole files, never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.parse import accounting_number, day_month_year, plain_number
from tickloom.operators.series import keep_last

# The column names of the two daily price layouts.
PRICE_NAMES = {
    "SYMBOL": "symbol", "SERIES": "series", "ISIN": "isin", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close",
    "PREVCLOSE": "prevclose", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover",
    "TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close",
    "PrvsClsgPric": "prevclose", "TtlTradgVol": "volume", "TtlTrfVal": "turnover",
}
PRICE_COLS = ["symbol", "series", "isin", "open", "high", "low", "close", "prevclose", "volume", "turnover"]
SERIES = ("EQ", "BE")
PARTICIPANT_LABELS = {"CLIENT": "Client", "DII": "DII", "FII": "FII", "PRO": "Pro", "TOTAL": "TOTAL"}


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text, headers trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def normalise_prices(raw: DataFrame) -> DataFrame:
    """One layout of daily prices (plus a ``date`` column) in the common schema; only EQ and BE rows."""
    named = raw.select("date", *[F.col(c).alias(PRICE_NAMES[c.strip()]) for c in raw.columns if c.strip() in PRICE_NAMES])
    if "isin" not in named.columns:
        named = named.withColumn("isin", F.lit(None).cast("string"))
    kept = named.where(F.trim("series").isin(*SERIES))
    kinds = {"symbol": "string", "series": "string", "isin": "string", "volume": "bigint"}
    cols = [F.trim(c).try_cast(kinds.get(c, "double")).alias(c) for c in PRICE_COLS]
    return kept.select("date", *cols)


def union_layouts(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [normalise_prices(f) for f in frames])


def derivative_symbols(raw: DataFrame) -> DataFrame:
    """Symbols with a stock future on each date, from either layout: (date, symbol)."""
    if "FinInstrmTp" in raw.columns:
        rows = raw.where(F.trim("FinInstrmTp") == "STF").select("date", F.trim("TckrSymb").alias("symbol"))
    else:
        rows = raw.where(F.trim("INSTRUMENT") == "FUTSTK").select("date", F.trim("SYMBOL").alias("symbol"))
    return rows.distinct()


def investments(raw: DataFrame) -> DataFrame:
    """Portfolio-investment rows; undated rows are totals and dropped, the route defaults to All."""
    route = F.trim("route") if "route" in raw.columns else F.lit(None).cast("string")
    typed = raw.select(day_month_year("date").alias("date"), F.trim("asset").alias("asset"), F.coalesce(route, F.lit("All")).alias("route"),
                       *[accounting_number(c).alias(c) for c in ("gross_buy", "gross_sell", "net", "net_usd_mn", "usdinr_ref") if c in raw.columns])
    return typed.where(F.col("date").isNotNull())


DERIVATIVE_COLS = ["product", "buy_contracts", "buy_cr", "sell_contracts", "sell_cr", "oi_contracts", "oi_cr"]


def derivatives(raw: DataFrame) -> DataFrame:
    """Derivative activity per product in title case; the layout must carry the expected columns."""
    missing = [c for c in ["date", *DERIVATIVE_COLS] if c not in raw.columns]
    if missing:
        raise ValueError(f"derivatives layout changed, missing {missing}")
    typed = raw.select(day_month_year("date").alias("date"), F.initcap(F.trim("product")).alias("product"),
                       *[accounting_number(c).alias(c) for c in DERIVATIVE_COLS[1:]])
    return typed.where(F.col("date").isNotNull())


def participant_files(files: DataFrame) -> DataFrame:
    """(day, text) of whole positioning files -> (date, participant, one column per measure as map ``m``).

    A file is kept when its titled date (if any) is its own day and it holds exactly the five
    expected rows. A title may share its line with the header.
    """
    lines = F.transform(F.split(F.col("text"), r"\r?\n"), lambda x: F.trim(x))
    staged = files.select("day", lines.alias("lines")).withColumn("first", F.col("lines")[0])
    title = F.regexp_extract("first", r"as on ([A-Za-z]+)\.? (\d{1,2}, \d{4})", 0)
    titled = F.try_to_timestamp(F.concat_ws(" ", F.substring(F.regexp_extract(title, r"as on ([A-Za-z]+)", 1), 1, 3),
                                            F.regexp_extract(title, r"(\d{1,2}, \d{4})", 1)), F.lit("MMM d, yyyy")).cast("date")
    own_line = (title != "") & ~F.col("first").contains("Future Index Long")
    known = (title != "") | F.lower("first").rlike(r"^\s*client[_ ]type")
    good = staged.where(known & ((title == "") | (titled == F.col("day"))))
    body = good.select("day", F.when(own_line, F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines")).alias("l"))
    header = F.transform(F.split(F.col("l")[0], ","), lambda x: F.trim(x))
    rows = body.select("day", header.alias("h"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line"))
    cells = rows.withColumn("v", F.split("line", r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    labels = F.create_map(*[x for k, v in PARTICIPANT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    named = cells.withColumn("participant", F.element_at(labels, F.upper(F.trim(F.col("v")[0])))).where(F.col("participant").isNotNull())
    keys = F.slice("h", F.lit(2), F.size("h"))
    numbers = F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x: plain_number(F.replace(x, F.lit('"'), F.lit(""))))
    typed = named.select(F.col("day").alias("date"), "participant", F.map_from_arrays(keys, F.slice(numbers, 1, F.size(keys))).alias("m"))
    whole = typed.groupBy("date").agg(F.count("*").alias("_n"), F.count_distinct("participant").alias("_d")).where("_n = 5 AND _d = 5")
    return typed.join(whole.select("date"), "date", "left_semi")


def observations(raw: DataFrame, key: str = "key") -> DataFrame:
    """One observation per day: '.' marks a holiday and is dropped, the last row of a day wins."""
    typed = raw.select(key, F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("close"), "seq")
    return keep_last(typed.where(F.col("close").isNotNull()), [key, "date"], ["seq"]).drop("seq")


OHLCV = ("open", "high", "low", "close", "volume")


def ohlcv(raw: DataFrame, key: str = "key", zones: DataFrame | None = None) -> DataFrame:
    """Bars by local trading date, with the price columns that the source has; a series whose volume is always zero carries
    none; the last row of a day wins.

    ``zones``: (key, zone), the registry's time zones, for sources whose ``date`` is a moment in UTC: the day is that of the clock
    where the series trades. A key without a zone keeps the day of UTC."""
    if zones is None:
        local = F.to_date("date")
    else:
        raw = raw.join(zones.select(key, F.coalesce("zone", F.lit("UTC")).alias("_zone")), key, "left")
        local = F.to_date(F.from_utc_timestamp("date", F.coalesce("_zone", F.lit("UTC"))))
    typed = raw.select(key, local.alias("date"), *[c for c in OHLCV if c in raw.columns], "seq")
    one = keep_last(typed, [key, "date"], ["seq"]).drop("seq")
    if "volume" not in raw.columns:
        return one
    traded = one.groupBy(key).agg(F.max(F.coalesce("volume", F.lit(0.0))).alias("_v"))
    return one.join(traded, key).withColumn("volume", F.when(F.col("_v") > 0, F.col("volume"))).drop("_v")


# Headings of the published lists.
LIST_COLUMNS = {"Company Name": "company", "Industry": "industry", "Symbol": "symbol", "Series": "series", "ISIN Code": "isin"}
LIST_NEEDS = ("Company Name", "Symbol", "ISIN Code")


def constituent_lists(raw: DataFrame, expected: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Published lists (index, text) -> (rows, rejects): index and the known columns of the good lists, and (index, reason) of
    the others.

    Columns go by their headings, in any order. A list is refused whole: for a wrong first line, missing headings, a line that
    does not fit the headings, another size than in ``expected`` (index, size), repeated symbols or malformed ISINs.
    """
    lines = raw.select("index", F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r", ""), "\n").alias("_l"))
    heads = F.transform(F.split(F.get("_l", F.lit(0)), ","), lambda h: F.trim(h))
    lines = lines.select("index", F.col("_l"), heads.alias("_h"), F.expr("ltrim(_l[0]) LIKE 'Company Name%'").alias("_list"))
    needs = F.array(*[F.lit(c) for c in LIST_NEEDS])
    lines = lines.withColumn("_whole", F.size(F.array_except(needs, "_h")) == 0)
    body = lines.where("_list AND _whole").select("index", "_h", F.explode(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(1)))).alias("line")).where("trim(line) <> ''")
    cells = F.from_csv(F.col("line"), F.lit(", ".join(f"c{i} string" for i in range(12)) + ", bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    body = body.withColumn("_c", cells)
    values = F.array(*[F.col(f"_c.c{i}") for i in range(12)])
    fits = F.size(F.filter(values, lambda v: v.isNotNull())) <= F.size("_h")

    def cell(heading: str) -> Column:
        at = F.array_position("_h", heading)
        return F.when(at > 0, F.trim(F.get(values, (at - 1).cast("int"))))

    rows = body.select("index", fits.alias("_fits"), *[cell(h).alias(c) for h, c in LIST_COLUMNS.items()])
    rows = rows.withColumn("_fits", F.col("_fits") & F.col("company").isNotNull() & F.col("symbol").isNotNull() & F.col("isin").isNotNull())
    per_symbol = rows.groupBy("index", "symbol").agg(F.count("*").alias("_k"), F.count_if(~F.col("_fits")).alias("_odd"), F.count_if(~F.coalesce(F.col("isin").rlike("^IN[A-Z0-9]{10}$"), F.lit(False))).alias("_bad"))
    found = per_symbol.groupBy("index").agg(F.sum("_k").alias("_n"), F.max("_k").alias("_dup"), F.sum("_odd").alias("_odd"), F.sum("_bad").alias("_bad"))
    judged = lines.select("index", "_list", "_whole").join(found, "index", "left").join(expected.select("index", F.col("size").alias("_want")), "index", "left")
    n = F.coalesce("_n", F.lit(0))
    reason = (F.when(~F.col("_list"), "not a constituent file").when(~F.col("_whole"), "unexpected columns").when(F.col("_odd") > 0, "malformed line")
              .when(F.col("_want").isNull(), "unknown index").when(n != F.col("_want"), F.concat(n.cast("string"), F.lit(" constituents, expected "), F.col("_want").cast("string")))
              .when(F.col("_dup") > 1, "duplicate symbols").when(F.col("_bad") > 0, "malformed ISINs"))
    judged = judged.select("index", reason.alias("reason"))
    good = rows.drop("_fits").join(judged.where("reason IS NULL").select("index"), "index", "left_semi")
    return good, judged.where("reason IS NOT NULL")


TRI_ROW = T.ArrayType(T.StructType([T.StructField("Index Name", T.StringType()), T.StructField("Date", T.StringType()),
                                    T.StructField("TotalReturnsIndex", T.StringType())]))


def tri_payload(raw: DataFrame, payload: str = "payload", keys: tuple[str, ...] = ()) -> DataFrame:
    """Total-return payloads, a JSON list or {'d': '<json>'}: (keys, date, tri); '-' and blanks are skipped."""
    text = F.coalesce(F.get_json_object(payload, "$.d"), F.col(payload))
    rows = raw.select(*keys, F.explode(F.from_json(text, TRI_ROW)).alias("r"))
    typed = rows.select(*keys, day_month_year(F.col("r.Date"), "d MMM yyyy").alias("date"), plain_number(F.col("r.TotalReturnsIndex")).alias("tri"))
    return typed.where(F.col("tri").isNotNull())


def rename_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """'company, old, new, dd-MMM-yyyy' with commas in the company: (old, new, date); bad dates drop."""
    pattern = r"^(.*),([^,]*),([^,]*),([^,]*)$"
    parts = lines.select(*[F.trim(F.regexp_extract(line, pattern, i)).alias(n) for i, n in ((2, "old"), (3, "new"), (4, "d"))])
    return parts.select("old", "new", day_month_year("d").alias("date")).where((F.col("old") != "") & (F.col("new") != "") & F.col("date").isNotNull())


def latest_targets(selection: DataFrame, review: str | None = None) -> DataFrame:
    """(symbol, weight) of one review, the latest by default, renormalised to 1."""
    pick = F.lit(review) if review else selection.agg(F.max("review")).scalar()
    rows = selection.where(F.col("review") == pick)
    total = rows.agg(F.sum("weight_tilt")).scalar()
    return rows.select("symbol", (F.col("weight_tilt") / total).alias("weight"))


def eq_closes(prices: DataFrame) -> DataFrame:
    return prices.where(F.trim("series") == "EQ").select("date", F.trim("symbol").alias("symbol"), F.col("close").cast("double").alias("close"))


def index_close(rows: DataFrame, index: str) -> DataFrame:
    return rows.where(F.trim("index") == index).select("date", F.col("close").cast("double").alias("close"))
