"""Files, layouts, reports and the remaining text, rule and score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import layout
from docsieve.operators import temporal as tm
from docsieve.plans.registry import NODES, query
from docsieve.plans.standins import nodes
from docsieve.plans.text_queries import written_dates
from docsieve.sources import tables as src
from docsieve.sources.tables import Tables

# --- files: written to the shared folder and read again ---


@query("sink_insert", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def sink_insert(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    t.nation.select("n_nationkey", "n_name").write.mode("append").parquet(path)
    t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("sink_rebuild_partition", "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 5 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def sink_rebuild_partition(t: Tables) -> DataFrame:
    path, rows = src.shared_folder(t.spark), t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey")
    src.rebuild_partitions(rows, path, "s_nationkey")
    src.rebuild_partitions(rows.where("s_nationkey < 5").withColumn("s_acctbal", F.lit(0.0)), path, "s_nationkey")
    return t.spark.read.parquet(path)


@query("src_jsonl", "SELECT event_id, event_type, value FROM events")
def src_jsonl(t: Tables) -> DataFrame:
    """Malformed lines between the records are dropped."""
    path = src.shared_folder(t.spark)
    good = t.events.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    good.unionByName(t.region.select(F.concat(F.lit("{broken "), "r_name").alias("value"))).write.text(path)
    return src.read_json_lines(t.spark, path, "event_id bigint, event_type string, value double")


@query("src_csv_quoted", "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label FROM part")
def src_csv_quoted(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    t.part.select("p_partkey", label.alias("label")).write.csv(path, header=True, escape='"')
    return src.read_csv_quoted(t.spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "label")


@query("src_csv_multiline", "SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE text <> ''")
def src_csv_multiline(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    t.conversations.where("text <> ''").select("conv_id", "turn", "text").write.csv(path, header=True, escape='"', quoteAll=True)
    rows = t.spark.read.schema("conv_id bigint, turn bigint, text string").csv(path, header=True, multiLine=True, escape='"')
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("src_csv_rfc", "SELECT s_suppkey, s_name FROM supplier")
def src_csv_rfc(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    t.supplier.select("s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("s_name")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return src.read_csv_quoted(t.spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("src_csv_header_norm", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS missing FROM nation")
def src_csv_header_norm(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    t.nation.select(F.col("n_nationkey").alias("Nation Key"), F.col("n_name").alias("Full Name")).write.csv(path, header=True)
    return src.normalised_headers(src.read_csv_quoted(t.spark, path), {"id": ["key", "nation_key"], "name": ["full_name", "name"], "missing": ["no_such"]})


@query("src_json_dir", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def src_json_dir(t: Tables) -> DataFrame:
    """A document a region, with its nations in an array."""
    path = src.shared_folder(t.spark)
    docs = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    docs.repartition("n_regionkey").select(F.to_json(F.struct("n_regionkey", "names")).alias("value")).write.text(path)
    read = src.read_json_lines(t.spark, path, "n_regionkey int, names array<string>")
    return read.select("n_regionkey", F.size("names").cast("long").alias("n"))


@query("src_json_array", "SELECT r_regionkey, r_name FROM region")
def src_json_array(t: Tables) -> DataFrame:
    """An array of records in each file; a file holds those of a bucket of keys, whose number sets its size."""
    path = src.shared_folder(t.spark)
    arrays = t.region.groupBy(F.pmod(F.xxhash64("r_regionkey"), F.lit(4)).alias("bucket")).agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    arrays.repartition("bucket").select("bucket", "value").write.partitionBy("bucket").text(path)
    return src.read_json_documents(t.spark, f"{path}/bucket=*", "r_regionkey int, r_name string")


@query("sink_json_report", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sink_json_report(t: Tables) -> DataFrame:
    path = src.shared_folder(t.spark)
    t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return t.spark.read.schema("c_mktsegment string, n bigint").json(path)


# --- layout: a part's line items as the items of a page ---

PAGE_WIDTH = 612
# A third of the pages have one column, a third two, a third an indent; some items stand anywhere.
EDGE = "CAST(40 + l_partkey % 8 + CASE WHEN l_orderkey % 25 = 0 THEN l_quantity * 9 WHEN l_suppkey % 3 = 1 THEN (l_linenumber % 2) * 300 WHEN l_suppkey % 3 = 2 THEN (l_linenumber % 2) * 60 ELSE 0 END AS BIGINT)"
ITEMS = f"items AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS item, {EDGE} AS x, CAST(30 + l_quantity AS BIGINT) AS width, CAST(l_orderkey % 60 * 12 + l_partkey % 3 AS BIGINT) AS y FROM lineitem)"


def items(t: Tables) -> DataFrame:
    """A supplier's line items as the pieces of text of its page."""
    edge = F.when(F.col("l_orderkey") % 25 == 0, F.col("l_quantity") * 9).when(F.col("l_suppkey") % 3 == 1, (F.col("l_linenumber") % 2) * 300).when(F.col("l_suppkey") % 3 == 2, (F.col("l_linenumber") % 2) * 60).otherwise(0)
    return t.lineitem.select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        (40 + F.col("l_partkey") % 8 + edge).cast("long").alias("x"), (30 + F.col("l_quantity")).cast("long").alias("width"),
        (F.col("l_orderkey") % 60 * 12 + F.col("l_partkey") % 3).cast("long").alias("y"),
    )


def anchored_ctes(source: str, value: str, order: str, width: int, out: str, name: str) -> str:
    """A fold in order: a value further than ``width`` from the last anchor is the next one."""
    return f"""o_{name} AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS i FROM {source}),
    {name} AS (SELECT *, CAST({value} AS DOUBLE) AS {out} FROM o_{name} WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN abs(o.{value} - f.{out}) <= {width} THEN f.{out} ELSE CAST(o.{value} AS DOUBLE) END FROM {name} f JOIN o_{name} o ON o.page = f.page AND o.i = f.i + 1)"""


LAID = f"""WITH RECURSIVE {ITEMS}, {anchored_ctes('items', 'y', 'y, x, item', 3, 'line', 'lined')},
  bins AS (SELECT page, floor(x / 10) * 10 AS edge, count(*) AS n FROM lined GROUP BY page, edge), size AS (SELECT page, count(DISTINCT line) AS n_lines, count(*) AS n_items FROM lined GROUP BY page),
  peaks AS (SELECT b.page, b.edge FROM bins b JOIN size s ON s.page = b.page WHERE b.n >= 0.05 * s.n_items), {anchored_ctes('peaks', 'edge', 'edge', 30, 'start', 'merged')},
  starts AS (SELECT page, start, row_number() OVER (PARTITION BY page ORDER BY start) AS k FROM (SELECT DISTINCT page, start FROM merged)),
  several AS (SELECT s.page FROM size s JOIN starts a ON a.page = s.page AND a.k = 1 JOIN starts b ON b.page = s.page AND b.k = 2 WHERE n_lines >= 5 AND n_items >= 10 AND b.start - a.start >= {PAGE_WIDTH} * 0.25),
  cols AS (SELECT page, k - 1 AS col, start - 10 AS min_x FROM starts WHERE page IN (SELECT page FROM several) UNION ALL SELECT page, 0, 0.0 FROM size WHERE page NOT IN (SELECT page FROM several))"""


def page_columns(t: Tables) -> tuple[DataFrame, DataFrame]:
    lined = layout.text_lines(items(t))
    return lined, layout.columns(lined, PAGE_WIDTH)


@query("lay_columns", f"{LAID} SELECT page, col, min_x, coalesce(lead(min_x) OVER (PARTITION BY page ORDER BY col), {PAGE_WIDTH}.0) AS max_x FROM cols")
def lay_columns(t: Tables) -> DataFrame:
    """The columns of each page, from their left border to the next one's, or to the page's end."""
    starts = F.col("starts")
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(float(PAGE_WIDTH))))
    each = page_columns(t)[1].select("page", F.posexplode(F.arrays_zip(starts.alias("min_x"), ends.alias("max_x"))).alias("col", "c"))
    return each.select("page", F.col("col").cast("long").alias("col"), "c.min_x", "c.max_x")


@query(
    "lay_reading_order",
    f"""{LAID}, placed AS (SELECT l.page, l.item, l.x, l.line, coalesce((SELECT max(c.col) FROM cols c WHERE c.page = l.page AND c.min_x <= l.x + l.width / 2.0), 0) AS col FROM lined l)
    SELECT page, item, line, col, row_number() OVER (PARTITION BY page ORDER BY col, line, x, item) AS place FROM placed""",
)
def lay_reading_order(t: Tables) -> DataFrame:
    """Items in the columns that were found: column by column, line by line, from left to right."""
    read = layout.in_reading_order(*page_columns(t))
    return read.select("page", "item", "line", F.col("col").cast("long").alias("col"), "place")


@query("win_pdf_lines", f"WITH RECURSIVE {ITEMS}, {anchored_ctes('items', 'y', 'y, x, item', 3, 'line', 'lined')} SELECT page, item, line FROM lined")
def win_pdf_lines(t: Tables) -> DataFrame:
    """Items of one line: not more than 3 from the line's first item."""
    return layout.text_lines(items(t)).select("page", "item", "line")


@query("win_peak_merge", f"WITH RECURSIVE {ITEMS}, edges AS (SELECT DISTINCT page, floor(x / 10) * 10 AS edge FROM items), {anchored_ctes('edges', 'edge', 'edge', 30, 'kept', 'merged')} SELECT page, CAST(edge AS BIGINT) AS edge, kept FROM merged")
def win_peak_merge(t: Tables) -> DataFrame:
    peaks = layout.edge_peaks(items(t), "page", "x", share=0.0)
    return layout.anchored(peaks, "page", ["edge"], "edge", 30, "kept").select("page", "edge", "kept")


# --- text ---


@query("fn_char_spacing_old", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z] [A-Za-z] [A-Za-z] ')) AS n_runs FROM documents")
def fn_char_spacing_old(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.count_of(F.col("text"), "[A-Za-z] [A-Za-z] [A-Za-z] ").alias("n_runs"))


FIELDS = """fields AS (SELECT page_id, html, unnest(['title', 'lang', 'path']) AS field, unnest([regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(html, 'lang="([a-z]+)"', 1), regexp_extract(url, '/([^/?]*)[^/]*$', 1)]) AS value FROM pages)"""


@query("fn_parse_sanity_date", "SELECT o_orderkey, year(o_orderdate) * 12 + CASE WHEN o_orderkey % 5 = 1 THEN 0 ELSE month(o_orderdate) END AS month_no FROM orders")
def fn_parse_sanity_date(t: Tables) -> DataFrame:
    """A bare year has month 0."""
    parsed = tm.parse_role_date(F.col("written"), False, F.lit(0)) - F.when(F.col("written").rlike("^[0-9]{4}$"), 1).otherwise(0)
    return written_dates(t).select("o_orderkey", parsed.alias("month_no"))


# --- rules ---


# --- graph, contradictions and reports ---


@query("txt_prompts", f"WITH {NODES} SELECT owner, string_agg(node || ': ' || n_roles || ' roles', chr(10) ORDER BY node) AS context FROM nodes GROUP BY owner")
def txt_prompts(t: Tables) -> DataFrame:
    each = F.sort_array(F.collect_list(F.struct("node", F.format_string("%s: %d roles", "node", "n_roles").alias("line"))))
    return nodes(t).groupBy("owner").agg(F.concat_ws("\n", each["line"]).alias("context"))


# --- validation and scores ---


@query("val_retry_ladder", "SELECT user_id, event_id, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN 1 THEN 'same tier' WHEN 2 THEN 'with a hint' WHEN 3 THEN 'quality tier' ELSE 'failed' END AS step FROM events WHERE event_type = 'error'")
def val_retry_ladder(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    step = F.when(k == 1, "same tier").when(k == 2, "with a hint").when(k == 3, "quality tier").otherwise("failed")
    return t.events.where("event_type = 'error'").select("user_id", "event_id", step.alias("step"))


# --- state ---


@query("st_cron", "SELECT CAST(ts AS DATE) AS run_day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY run_day ORDER BY run_day DESC LIMIT 100")
def st_cron(t: Tables) -> DataFrame:
    """A log of nightly runs, of which the last hundred are kept."""
    runs = t.events.groupBy(F.col("ts").cast("date").alias("run_day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"))
    return runs.orderBy(F.desc("run_day")).limit(100)
