"""Queries over feeds: CSV conversion, audits, calendars and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import local_date
from tapeglass.session import cut, remove, shared_folder
from tapeglass.sources import archives, market
from tapeglass.sources.tables import table
from tapeglass.streaming import windows


def csv_convert(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as gz CSV in epoch nanoseconds, read by the declared schema, converted to day partitions and read back."""
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    b = table(spark, d, "bars_1m_raw")
    csv = b.select(F.col("display_symbol").alias("ticker"), "volume", "open", "close", "high", "low", (F.unix_micros("t") * 1000).alias("window_start"), "transactions")
    csv.write.option("header", True).option("compression", "gzip").csv(f"{root}/staging")
    ids = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("display_symbol").agg(F.min("security_id").alias("security_id"))
    market.convert(market.read_minute_csv(spark, f"{root}/staging"), ids, f"{root}/bars")
    out = spark.read.parquet(f"{root}/bars")
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("display_symbol").alias("symbols"), F.count("security_id").alias("with_id"), F.sum("volume").alias("volume"), F.sum("transactions").alias("transactions"))


CSV_SQL = """
with i as (select display_symbol, min(security_id) as sid from tickers where security_id is not null group by 1)
select strftime(timezone('America/New_York', b.t), '%Y-%m-%d') as day, count(*) as bars, count(distinct b.display_symbol) as symbols, count(i.sid) as with_id, sum(b.volume) as volume, cast(sum(b.transactions) as bigint) as transactions
from bars_1m_raw b left join i on i.display_symbol = b.display_symbol group by 1
"""


def bars_audit(spark: SparkSession, d: str) -> DataFrame:
    a = market.audit(table(spark, d, "bars_1m_raw"))
    return a.select("display_symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "volume", F.unix_micros("first_t").alias("first_us"), F.unix_micros("last_t").alias("last_us"), "inside_minute", "repeats")


AUDIT_SQL = """
select display_symbol, strftime(timezone('America/New_York', t), '%Y-%m-%d') as day, count(*) as rows, sum(volume) as volume, epoch_us(min(t)) as first_us, epoch_us(max(t)) as last_us,
  cast(count_if(epoch_us(t) % 60000000 <> 0) as bigint) as inside_minute, count(*) - count(distinct epoch_us(t) // 60000000) as repeats
from bars_1m_raw group by 1, 2
"""


def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Trading days with their index, and the last bar of each day by 16:00 as its close."""
    days = market.trading_days(table(spark, d, "day_session"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "day_idx")


CALENDAR_SQL = "select strftime(day, '%Y-%m-%d') as day, row_number() over (order by day) - 1 as day_idx from (select distinct day from day_session)"


def stream_window_available_now(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_counts(windows.file_stream(spark, d, "events"), "ts", "event_type", "value", "6 hours")
    out = windows.run_available(w)
    return out.select((F.unix_micros("w.start") / 1_000_000).cast("bigint").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_SQL = "select cast(epoch(ts) as bigint) // 21600 * 21600 as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


def stream_sliding_available_now(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_counts(windows.file_stream(spark, d, "events"), "ts", "event_type", "value", "1 day", "12 hours")
    out = windows.run_available(w)
    return out.select((F.unix_micros("w.start") / 1_000_000).cast("bigint").alias("start_s"), "event_type", "n")


SLIDING_SQL = "select (cast(epoch(ts) as bigint) // 43200 - k) * 43200 as start_s, event_type, count(*) as n from events cross join (select unnest([0, 1]) as k) group by 1, 2"


def stream_sessions_available_now(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sessions(windows.file_stream(spark, d, "events"), "ts", "user_id", "12 hours")
    out = windows.run_available(s)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


SESSIONS_SQL = "with g as (select user_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 43200000000 then 0 else 1 end as new from events) select user_id, cast(sum(new) as bigint) as sessions, count(*) as events from g group by 1"


def _day_table(spark: SparkSession, d: str, root: str) -> str:
    b = table(spark, d, "bars_1m_raw").where(F.col("display_symbol").isNotNull() & F.col("t").isNotNull())
    market.write_days(b.withColumn("day", local_date(F.col("t"))).repartition("day"), f"{root}/bars", {"snapshot": "2024-12-31", "rows": "all"})
    return f"{root}/bars"


def day_window_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bars as day partitions; three months of them read with only those days' folders opened, after the stamps were checked."""
    root = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    path = _day_table(spark, d, root)
    market.read_stamped(spark, path, {"snapshot": "2024-12-31", "rows": None})
    b = market.read_days(spark, path, "2024-01-01", "2024-03-31")
    out = cut(b.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")))
    remove(spark, root)
    return out


DAY_WINDOW_SQL = "select strftime(timezone('America/New_York', t), '%Y-%m-%d') as day, count(*) as bars, sum(volume) as volume from bars_1m_raw where display_symbol is not null and cast(timezone('America/New_York', t) as date) between date '2024-01-01' and date '2024-03-31' group by 1"


def footer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each day of the day partitions by the footers of their files, and the weekdays between this day and the last one that have no folder."""
    root = f"{shared_folder(spark)}/footers-{uuid.uuid4().hex}"
    f = market.footers(spark, _day_table(spark, d, root))
    day = F.to_date(F.regexp_extract("file", r"day=(\d{4}-\d{2}-\d{2})", 1))
    g = f.groupBy(day.alias("day")).agg(F.sum("rows").alias("rows"), F.countDistinct("columns").alias("schemas"), F.count_if(F.col("rows") == 0).alias("empty_files"))
    before = F.lag("day").over(Window.orderBy("day"))  # a row per day
    between = F.filter(F.sequence(F.date_add("before", 1), F.date_sub("day", 1)), lambda x: F.weekday(x) < 5)
    g = g.withColumn("before", before)
    lost = F.when(F.datediff("day", "before") > 1, F.size(between)).otherwise(0)
    out = cut(g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "schemas", "empty_files", lost.cast("bigint").alias("weekdays_missing")))
    remove(spark, root)
    return out


FOOTER_SQL = "with g as (select cast(timezone('America/New_York', t) as date) as day, count(*) as rows from bars_1m_raw where display_symbol is not null group by 1), l as (select *, lag(day) over (order by day) as before from g) select strftime(day, '%Y-%m-%d') as day, rows, 1::bigint as schemas, 0::bigint as empty_files, coalesce(len(list_filter(range(before + 1, cast(day as timestamp), interval 1 day), lambda x: isodow(x) < 6)), 0)::bigint as weekdays_missing from l"


def resume_run(spark: SparkSession, d: str) -> DataFrame:
    """A run over all sessions' days that dies after the days of 2023, is started again and does the rest: what each run did."""
    root = f"{shared_folder(spark)}/cursor-{uuid.uuid4().hex}"
    cursor = market.DayCursor(spark, root)
    days = cut(table(spark, d, "day_session").select("day").distinct())
    first = [r.day for r in days.where(F.year("day") == 2023).collect()]  # a row per trading day
    if first:
        cursor.mark("panel", first)
        cursor.mark("other", first)
        cursor.clear("panel", first[:1])
        cursor.mark("panel", first[:1])
    second = cut(cursor.remaining(days, "panel"))
    done = days.join(second, "day", "left_anti")
    out = done.select("day", F.lit(1).alias("run")).unionByName(second.select("day", F.lit(2).alias("run")))
    out = cut(out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("run").cast("bigint").alias("run")))
    remove(spark, root)
    return out


RESUME_SQL = "select distinct strftime(day, '%Y-%m-%d') as day, case when year(day) = 2023 then 1 else 2 end::bigint as run from day_session"


def sql_over_parquet(spark: SparkSession, d: str) -> DataFrame:
    """SQL straight over parquet files: filings that lack an acceptance time, by company."""
    return spark.sql(f"select cik, count(*) as filings, max(source_filing_url) as url from parquet.`{d}/financials.parquet` where acceptance_datetime is null and cik is not null group by cik")


OVER_PARQUET_SQL = "select cik, count(*) as filings, max(source_filing_url) as url from financials where acceptance_datetime is null and cik is not null group by cik"


def zip_json_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts per company from a zip of JSON files (written here from the filings): nested arrays become a row per fact."""
    root = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    f = table(spark, d, "financials").where(F.col("cik").isNotNull() & F.col("basic_earnings_per_share").isNotNull() & ~F.isnan("basic_earnings_per_share"))
    fact = F.struct(F.col("filing_id").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), F.col("basic_earnings_per_share").alias("val"))
    per = f.groupBy("cik").agg(F.to_json(F.struct(F.first("cik").alias("cik"), F.struct(F.struct(F.collect_list(fact).alias("units")).alias("eps")).alias("facts"))).alias("text")).withColumn("member", F.concat(F.lit("CIK"), "cik", F.lit(".json")))
    archives.write_zips(per, "member", "text", root)
    body = F.from_json("text", "cik string, facts struct<eps: struct<units: array<struct<accn: bigint, fy: string, fp: string, val: double>>>>")
    rows = archives.zip_members(spark, root, ".json").select(body.alias("b")).select("b.cik", F.inline("b.facts.eps.units"))
    out = cut(rows.select("cik", F.col("accn").alias("filing_id"), F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), F.col("val").alias("eps")))
    remove(spark, root)
    return out


FACTS_SQL = "select cik, filing_id, cast(fiscal_year as varchar) as fiscal_year, fiscal_period, basic_earnings_per_share as eps from financials where cik is not null and basic_earnings_per_share is not null and not isnan(basic_earnings_per_share)"


def paged_json_events(spark: SparkSession, d: str) -> DataFrame:
    """Filings of each company as pages of parallel arrays that name the next page; rows whose form is quarterly are kept."""
    root = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    f = table(spark, d, "financials").where(F.col("cik").isNotNull()).select("cik", "filing_id", "filing_date", "timeframe").distinct()
    page = F.floor((F.row_number().over(Window.partitionBy("cik").orderBy("filing_id", "filing_date", "timeframe")) - 1) / 5).cast("int")
    last = F.max("page").over(Window.partitionBy("cik"))
    p = f.withColumn("page", page).withColumn("last", last)
    col = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("filing_id", F.date_format("filing_date", "yyyy-MM-dd").alias("filed"), F.coalesce("timeframe", F.lit("")).alias("form")))), lambda x: x[c].cast("string"))
    name = lambda k: F.concat_ws("-", "cik", k.cast("string"))
    p = p.groupBy("cik", "page", "last").agg(col("filing_id").alias("filing_id"), col("filed").alias("filed"), col("form").alias("form"))
    body = F.to_json(F.struct("cik", "filing_id", "filed", "form", F.when(F.col("page") < F.col("last"), name(F.col("page") + 1)).alias("next_url")))
    archives.write_files(p, name(F.col("page")), body, root)  # stands for a server
    starts = f.select(F.concat_ws("-", "cik", F.lit("0")).alias("start")).distinct()
    got = archives.pages(spark, starts, lambda url: archives.read_file(root, url))
    rows = got.select(F.get_json_object("body", "$.cik").alias("cik"), "page", F.inline(archives.parallel_arrays("body", ["filing_id", "filed", "form"])))
    out = cut(rows.where(F.contains("form", F.lit("quarter"))).select("cik", F.col("filing_id").cast("bigint").alias("filing_id"), F.col("filed").alias("filing_date")))
    remove(spark, root)
    return out


PAGED_SQL = "select distinct cik, filing_id, strftime(filing_date, '%Y-%m-%d') as filing_date from financials where cik is not null and timeframe like '%quarter%'"


def zip_tsv_join(spark: SparkSession, d: str) -> DataFrame:
    """Three tab-separated tables per zip (filings, owners, amounts; written here), read and joined: amounts of owners by filing."""
    root = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    s = table(spark, d, "short_interest").where(F.col("security_id").isNotNull() & F.col("short_interest").isNotNull() & ~F.isnan("short_interest"))
    s = s.select(F.concat_ws("|", "security_id", F.date_format("settlement_date", "yyyyMMdd")).alias("acc"), "security_id", F.date_format("settlement_date", "dd-MMM-yyyy").alias("at"), F.format_string("%.3f", "short_interest").alias("amount")).distinct()
    line = lambda *c: F.concat_ws("\t", *c)
    body = lambda head, c: F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_set(c)), "\n"))
    q = s.groupBy(F.substring("acc", -8, 4).alias("year")).agg(body("ACCESSION\tFILED", line("acc", "at")).alias("a"), body("ACCESSION\tOWNER", line("acc", "security_id")).alias("b"), body("AMOUNT\tACCESSION", line("amount", "acc")).alias("c"))
    files = q.select(F.inline(F.array(*[F.struct(F.concat("year", F.lit(f"/{n}.tsv")).alias("member"), F.col(c).alias("text")) for n, c in (("SUBMISSION", "a"), ("OWNER", "b"), ("TRANS", "c"))])))
    archives.write_zips(files.repartition(1), "member", "text", root)
    m = cut(archives.zip_members(spark, root, ".tsv", "latin-1"))
    sub = archives.tsv(m.withColumn("archive", F.col("member")), "SUBMISSION.tsv", ["ACCESSION", "FILED"]).drop("archive")
    own = archives.tsv(m.withColumn("archive", F.col("member")), "OWNER.tsv", ["ACCESSION", "OWNER"]).drop("archive")
    trans = archives.tsv(m.withColumn("archive", F.col("member")), "TRANS.tsv", ["ACCESSION", "AMOUNT"]).drop("archive")
    j = sub.join(own, "ACCESSION").join(trans, "ACCESSION")
    out = cut(j.select(F.col("OWNER").alias("security_id"), F.date_format(F.to_date("FILED", "dd-MMM-yyyy"), "yyyy-MM-dd").alias("settlement_date"), F.col("AMOUNT").try_cast("double").alias("short_interest")))
    remove(spark, root)
    return out


TSV_SQL = "select distinct security_id, strftime(settlement_date, '%Y-%m-%d') as settlement_date, round(short_interest, 3) as short_interest from short_interest where security_id is not null and short_interest is not null and not isnan(short_interest)"


def series_with_marks(spark: SparkSession, d: str) -> DataFrame:
    """A daily CSV series with dots for missing values (written here: the day's highest price, a dot on days of fewer than 20 names), read without them."""
    root = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    s = table(spark, d, "day_session").where(F.col("volume") > 0).groupBy("day").agg(F.countDistinct("security_id").alias("n"), F.max("rth_high").alias("x"))
    s.select(F.date_format("day", "yyyy-MM-dd").alias("observation_date"), F.when(F.col("n") < 20, ".").otherwise(F.format_string("%.4f", "x")).alias("VALUE")).write.option("header", True).csv(root)
    out = cut(archives.series_with_marks(spark, root, "observation_date", "VALUE").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "value"))
    remove(spark, root)
    return out


MARKS_SQL = "select strftime(day, '%Y-%m-%d') as day, round(max(rth_high), 4) as value from day_session where volume > 0 group by day having count(distinct security_id) >= 20"


def enrich_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Listings that lack an identifier, or are gone without a date, get one from a lookup by page; all others stay as they are."""
    t = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).select("security_id", "display_symbol", "composite_figi", "active", "delisted_utc").distinct()
    gap = F.col("composite_figi").isNull() | (~F.col("active") & F.col("delisted_utc").isNull())
    asked = t.where(gap).select(F.col("security_id").alias("start")).distinct()
    got = archives.pages(spark, asked, _lookup).select(F.col("start").alias("_s"), F.get_json_object("body", "$.figi").alias("_f"))
    j = t.join(got, F.col("security_id") == F.col("_s"), "left")
    return j.select("security_id", "display_symbol", F.coalesce("composite_figi", "_f").alias("figi"), F.col("_s").isNotNull().alias("asked"))


def _lookup(url: str) -> str:
    """Stands for a remote lookup: an identifier made from the id."""
    return json.dumps({"figi": f"F{url}", "next_url": None})


ENRICH_SQL = "with t as (select distinct security_id, display_symbol, composite_figi, active, delisted_utc from tickers where security_id is not null), g as (select distinct security_id from t where composite_figi is null or (not active and delisted_utc is null)) select t.security_id, t.display_symbol, coalesce(t.composite_figi, case when g.security_id is not null then 'F' || t.security_id end) as figi, g.security_id is not null as asked from t left join g on g.security_id = t.security_id"


def stream_append_late(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows in append mode over four files in a row, the last of which comes too late: windows closed by the watermark take no more rows."""
    root = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.lit("2024-01-15").cast("timestamp")
    early, late = e.where((F.col("ts") < half) & (F.col("event_id") % 10 != 0)), e.where((F.col("ts") < half) & (F.col("event_id") % 10 == 0))
    rest = F.lit("2024-01-25").cast("timestamp")
    # rows count as late by the watermark of the batch before, so one more batch lies between
    for name, part in (("0", early), ("1", e.where((F.col("ts") >= half) & (F.col("ts") < rest))), ("2", e.where(F.col("ts") >= rest)), ("3", late)):
        part.select("ts", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{root}/in/{name}")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    w = windows.window_counts(stream, "ts", "event_type", "value", "1 day", late="1 day")
    out = windows.run_available(w, "append")
    out = cut(out.select((F.unix_micros("w.start") / 1_000_000).cast("bigint").alias("start_s"), "event_type", "n"))
    remove(spark, root)
    return out


#: windows that the watermark (the newest event less a day) closed; late rows are in none of them
LATE_SQL = "with x as (select cast(epoch(ts) as bigint) as s, event_type, event_id from events), m as (select max(s) - 86400 as w from x) select s // 86400 * 86400 as start_s, event_type, count(*) as n from x, m where (s >= epoch(timestamp '2024-01-15') or event_id % 10 <> 0) and s // 86400 * 86400 + 86400 <= m.w group by 1, 2"


QUERIES = {"csv_convert": csv_convert, "bars_audit": bars_audit, "trading_calendar": trading_calendar, "stream_window_available_now": stream_window_available_now, "stream_sliding_available_now": stream_sliding_available_now, "stream_sessions_available_now": stream_sessions_available_now, "stream_append_late": stream_append_late, "day_window_scan": day_window_scan, "footer_audit": footer_audit, "resume_run": resume_run, "sql_over_parquet": sql_over_parquet, "zip_json_facts": zip_json_facts, "paged_json_events": paged_json_events, "zip_tsv_join": zip_tsv_join, "series_with_marks": series_with_marks, "enrich_gaps": enrich_gaps}
SQL = {"csv_convert": CSV_SQL, "bars_audit": AUDIT_SQL, "trading_calendar": CALENDAR_SQL, "stream_window_available_now": STREAM_SQL, "stream_sliding_available_now": SLIDING_SQL, "stream_sessions_available_now": SESSIONS_SQL, "stream_append_late": LATE_SQL, "day_window_scan": DAY_WINDOW_SQL, "footer_audit": FOOTER_SQL, "resume_run": RESUME_SQL, "sql_over_parquet": OVER_PARQUET_SQL, "zip_json_facts": FACTS_SQL, "paged_json_events": PAGED_SQL, "zip_tsv_join": TSV_SQL, "series_with_marks": MARKS_SQL, "enrich_gaps": ENRICH_SQL}
