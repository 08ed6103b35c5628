"""Queries that show the text functions, readers, outlines and the dense form on relations whose results SQL can give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text as tx
from gneiss.functions import tokens as tk
from gneiss.operators import fidelity as fd
from gneiss.operators import perturb as pt
from gneiss.operators import questions as qs
from gneiss.operators import sections as sc
from gneiss.operators import spatial as sp
from gneiss.plans import codec as cd
from gneiss.plans.registry import query, table
from gneiss.sources import blocks as bl
from gneiss.sources import text as src
from gneiss.streaming import windows as sw

NEEDS = r"^!*(?:![A-Z](\s|$)|#{1,6} |[-*+] |\d+[.)]? |> |`{3,}|%[A-Z]{3})"
STARTS = ["# ", "- ", "!T ", "12. ", "> ", "```", "!!# ", "%ABC", "", "#", "!t ", "1x "]
STARTED = "([" + ", ".join(f"'{x}'" for x in STARTS) + f"])[c_custkey % {len(STARTS)} + 1] || c_name"


@query(f"SELECT c_custkey, CASE WHEN regexp_matches(t, '{NEEDS}') THEN '!' || t ELSE t END AS escaped, t AS restored, regexp_matches(t, '^(?:' || substr('{NEEDS}', 7)) AS structural FROM (SELECT c_custkey, {STARTED} AS t FROM customer)")
def escaped_lines(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in STARTS]), (F.col("c_custkey") % len(STARTS) + 1).cast("int"))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.concat(start, F.col("c_name")).alias("t"))
    e = tx.escape_body(F.col("t"))
    return d.select("c_custkey", e.alias("escaped"), tx.unescape_body(e).alias("restored"), tx.looks_structural(F.col("t")).alias("structural"))


VALUE = "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || ' x' WHEN 3 THEN 'a\"b' ELSE 'a' || chr(10) || 'b' END"


@query(f"""SELECT c_custkey, CASE WHEN v = '' THEN '""' WHEN regexp_matches(v, '[ "]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS quoted, CASE WHEN c_custkey % 4 > 0 THEN repeat('^', c_custkey % 4 + 1) ELSE '' END AS caret,
    repeat('^', c_custkey % 4) AS plain, repeat('`', greatest(3, c_custkey % 6 + 1)) AS fence, CASE WHEN ceil(length(c_name) / 4.0) <= ceil(length(c_mktsegment) / 4.0) THEN c_name ELSE c_mktsegment END AS cheapest
    FROM (SELECT *, replace({VALUE}, chr(10), ' ') AS v FROM customer)""")
def quoted_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    marks = lambda x, n: F.repeat(F.lit(x), (F.col("c_custkey") % n).cast("int"))
    caret = tx.escape_caret(marks("^", 4))
    return c.select("c_custkey", tx.quote_cell(F.expr(VALUE)).alias("quoted"), caret.alias("caret"), tx.unescape_caret(caret).alias("plain"), tx.code_fence(F.concat(F.lit("x "), marks("`", 6))).alias("fence"), tk.cheapest(tk.chars, F.col("c_name"), F.col("c_mktsegment")).alias("cheapest"))


PARAS = r"""blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text FROM (
    SELECT doc_id, i, trim(regexp_replace(p, '\s+', ' ', 'g')) AS text FROM (
        SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n\s*\n')) AS p, generate_subscripts(string_split_regex(coalesce(text, ''), '\n\s*\n'), 1) AS i FROM documents))
    WHERE text <> '')"""


@query(f"WITH {PARAS} SELECT doc_id, sha256(string_agg(sha256('para' || chr(31) || text), '' ORDER BY pos)) AS fingerprint FROM blocks GROUP BY 1")
def fingerprints(spark, sf_dir):
    return fd.fingerprint(src.text_blocks(table(spark, sf_dir, "documents")))


@query(f"""WITH {PARAS}, x AS (SELECT doc_id, pos, text, replace(' ' || text || ' ', ' ', '  ') AS x FROM blocks) SELECT doc_id, CAST(pos AS INT) AS pos,
    CAST((length(x) - length(replace(x, ' of  the ', ''))) / 9 AS INT) AS n, trim(replace(replace(x, ' of  the ', ' §1 '), '  ', ' ')) AS replaced FROM x WHERE contains(x, ' of  the ')""")
def bounded_phrases(spark, sf_dir):
    b = src.text_blocks(table(spark, sf_dir, "documents"))
    n = tx.bounded_count(F.col("text"), "of the")
    return b.filter(n > 0).select("doc_id", "pos", n.alias("n"), tx.bounded_replace(F.col("text"), "of the", "§1").alias("replaced"))


def turns(spark, sf_dir):
    """Conversations as blocks: users' turns are headings, systems' are page marks, assistants' are paragraphs."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "heading").when(F.col("role") == "system", "page").otherwise("para")
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    return c.select("conv_id", F.col("turn").cast("int").alias("pos"), kind.alias("kind"), F.lit(1).alias("level"), "text", F.when(kind == "page", F.col("turn").cast("int") + 2).alias("number"),
                    *none("array<string>", "items", "cols"), *none("array<array<string>>", "rows"), *none("array<struct<k:string,v:string>>", "pairs"))


TURNS = """b AS (SELECT conv_id, CAST(turn AS INT) AS pos, CASE role WHEN 'user' THEN 'heading' WHEN 'system' THEN 'page' ELSE 'para' END AS kind, text, CAST(turn AS INT) + 2 AS number FROM conversations),
    n AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'page' THEN number END IGNORE NULLS) OVER w, 1) AS here, CAST(count(*) FILTER (kind = 'heading') OVER w AS VARCHAR) AS section FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER w, '(preamble)') AS title, CAST(coalesce(last_value(CASE WHEN kind = 'heading' THEN here END IGNORE NULLS) OVER w, 1) AS INT) AS page,
        CAST(coalesce(last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER w, -1) AS INT) AS section_pos FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {TURNS} SELECT conv_id, pos, section, title, page, section_pos FROM s")
def section_membership(spark, sf_dir):
    return sc.with_sections(turns(spark, sf_dir), "conv_id").select("conv_id", "pos", "section", F.col("section_title").alias("title"), "page", "section_pos")


COSTS = rf"""{TURNS}, k AS (SELECT conv_id, section_pos, section, title, page, CAST(sum(CASE WHEN kind = 'para' THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END) AS BIGINT) AS tokens, '' AS kinds FROM s GROUP BY ALL HAVING section <> '0' OR sum(CASE WHEN kind = 'para' THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END) > 0)"""


@query(f"WITH {COSTS} SELECT * FROM k")
def section_costs(spark, sf_dir):
    return sc.skeleton(turns(spark, sf_dir), "conv_id")


@query(f"WITH {COSTS} SELECT conv_id, string_agg(section || ' ' || title || ' p' || page || ' ~' || tokens, chr(10) ORDER BY section_pos) AS outline FROM k GROUP BY 1")
def rendered_outline(spark, sf_dir):
    return sc.rendered(sc.skeleton(turns(spark, sf_dir), "conv_id"), "conv_id")


@query(f"WITH {TURNS} SELECT conv_id, pos, kind, text, section FROM s WHERE (conv_id % 2 = 0 AND section = '1') OR (conv_id % 3 = 0 AND section = '2')")
def wanted_sections(spark, sf_dir):
    """Sections asked for by a table: the first of every second conversation, the second of every third."""
    t = turns(spark, sf_dir)
    ids = t.select("conv_id").distinct()
    wanted = ids.filter("conv_id % 2 = 0").withColumn("id", F.lit("1")).unionByName(ids.filter("conv_id % 3 = 0").withColumn("id", F.lit("2")))
    return sc.expand(t, wanted, "conv_id").select("conv_id", "pos", "kind", "text", "section")


SPANS = "SELECT p_brand, p_partkey, p_name AS text, 8.0::DOUBLE + [0, 0, 0, 3, 6, 9][p_partkey % 6 + 1] AS size FROM part"


@query(f"""WITH s AS ({SPANS}), n AS (SELECT p_brand, size, sum(length(text)) AS n FROM s GROUP BY 1, 2), b AS (SELECT p_brand, size AS body FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, size) = 1)
    SELECT s.p_brand, p_partkey, body, CAST(CASE WHEN length(text) >= 160 THEN NULL WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.35 THEN 2 WHEN size / body >= 1.15 THEN 3 END AS INT) AS level FROM s JOIN b USING (p_brand)""")
def heading_sizes(spark, sf_dir):
    size = F.lit(8.0) + F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 3, 6, 9)]), (F.col("p_partkey") % 6 + 1).cast("int"))
    s = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("text"), size.alias("size"))
    return sp.heading_levels(s, ["p_brand"]).join(sp.body_size(s, ["p_brand"]), "p_brand").select("p_brand", "p_partkey", "body", "level")


@query("""WITH w AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_orderkey * 7 % 5000 AS y FROM lineitem), n AS (SELECT *, CASE WHEN y - lag(y) OVER o > 40 THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY l_suppkey ORDER BY y, l_orderkey, l_linenumber, l_partkey))
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(sum(new) OVER (PARTITION BY l_suppkey ORDER BY y, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM n""")
def gap_runs(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 7 % 5000).alias("y"))
    return sp.islands(d, ["l_suppkey"], "y", 40, "run", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("run").cast("long").alias("run"))


ROWS = ["order", "status", "priority"]
ROWS_SQL = "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row, CAST(o_orderkey AS VARCHAR) AS \"order\", o_orderstatus AS status, o_orderpriority AS priority FROM orders"


def order_rows(spark, sf_dir):
    """Each customer's orders as an array of rows of strings, by order."""
    o = table(spark, sf_dir, "orders")
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("r"))
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))


def back(blocks):
    """The rows of tables, by place."""
    r = blocks.filter("kind = 'table'").select("o_custkey", F.posexplode("rows").alias("row", "r"))
    return r.select("o_custkey", "row", *[F.col("r")[i].alias(c) for i, c in enumerate(ROWS)])


@query(ROWS_SQL)
def delimited_tables(spark, sf_dir):
    """Tables written as delimited text and read again."""
    lines = F.concat(F.lit(",".join(ROWS) + "\n"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "\n"))
    return back(bl.parsed_blocks(order_rows(spark, sf_dir).select("o_custkey", lines.alias("t")), bl.read_delimited, "o_custkey", "t"))


@query(ROWS_SQL)
def markdown_tables(spark, sf_dir):
    """Tables written as Markdown between texts and read again."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = f"# T\n\ntext\n\n| {' | '.join(ROWS)} |\n|---|---|---|\n"
    t = F.concat(F.lit(head), F.array_join(F.transform("rows", line), "\n"), F.lit("\n\nmore"))
    return back(bl.parsed_blocks(order_rows(spark, sf_dir).select("o_custkey", t.alias("t")), bl.read_markdown, "o_custkey", "t"))


@query(ROWS_SQL)
def html_tables(spark, sf_dir):
    """Tables written as HTML, without closing tags, and read again."""
    line = lambda r: F.concat(F.lit("<tr><td>"), F.array_join(r, "<td>"))
    t = F.concat(F.lit("<p>text<table><tr><th>" + "<th>".join(ROWS)), F.array_join(F.transform("rows", line), "\n"), F.lit("</table><p>more"))
    return back(bl.parsed_blocks(order_rows(spark, sf_dir).select("o_custkey", t.alias("t")), bl.read_html, "o_custkey", "t"))


def order_blocks(spark, sf_dir):
    """A document for each customer: a heading, a paragraph and the table of their orders."""
    made = {"kind": F.lit("table"), "cols": F.array(*[F.lit(c) for c in ROWS]), "rows": F.col("rows"), "caption": F.lit("orders")}
    fields = [f.strip().split(" ", 1) for f in bl.FIELDS.split(", ")]
    d = order_rows(spark, sf_dir)
    t = d.select("o_custkey", F.lit("Orders").alias("title"), F.lit(1).alias("pos"), *[made.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])
    para = {"kind": F.lit("para"), "text": F.concat(F.lit("# customer "), F.col("o_custkey").cast("string"))}
    return t.unionByName(d.select("o_custkey", F.lit("Orders").alias("title"), F.lit(0).alias("pos"), *[para.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields]))


@query(ROWS_SQL)
def dense_tables(spark, sf_dir):
    """Tables through the dense form (codes, constants, repeats, separators) and back."""
    return back(cd.decode_documents(cd.encode_documents(order_blocks(spark, sf_dir), "o_custkey"), "o_custkey"))


@query("SELECT o_custkey, 1 AS pos, '# customer ' || o_custkey AS text, 'Orders' AS title FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_texts(spark, sf_dir):
    """Texts that look like structure through the dense form and back."""
    d = cd.decode_documents(cd.encode_documents(order_blocks(spark, sf_dir), "o_custkey"), "o_custkey")
    return d.filter("kind = 'para'").select("o_custkey", (F.col("pos") + 1).alias("pos"), "text", "title")


@query("""SELECT o_custkey, 'declared-rows' AS rule, count(*) || ' rows declared, ' || (count(*) - 1) || ' present' AS detail FROM orders GROUP BY 1
    UNION ALL SELECT DISTINCT -o_custkey, 'magic-header', 'the first line must name the format' FROM orders""")
def damaged_documents(spark, sf_dir):
    """What the validator says of documents whose last row is cut off, or whose first line is."""
    e = cd.encode_documents(order_blocks(spark, sf_dir), "o_custkey")
    cut = e.withColumn("dense", F.regexp_replace("dense", r"[^\n]*\n$", ""))
    bare = e.select((-F.col("o_custkey")).alias("o_custkey"), F.regexp_replace("dense", r"^[^\n]*\n", "").alias("dense"))
    v = cd.validate_documents(cut, "o_custkey").filter("rule = 'declared-rows'").unionByName(cd.validate_documents(bare, "o_custkey"))
    return v.select("o_custkey", "rule", "detail")


@query(r"""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS line, count(*) AS n, CAST(len(regexp_extract_all(event_type, '\S+')) AS INT) AS tokens FROM events GROUP BY ALL""")
def event_lines(spark, sf_dir):
    return sw.line_counts(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("text")))


@query(ROWS_SQL.replace("FROM orders", "FROM orders QUALIFY row < 5"))
def trimmed_tables(spark, sf_dir):
    return back(pt.trimmed(order_blocks(spark, sf_dir), 5))


PAGES = "s AS (SELECT p_brand, p_partkey, CAST(p_partkey % 7 + 1 AS INT) AS page, p_partkey // 3 AS block, CAST(p_partkey * 37 % 500 AS INT) AS x0, CAST(p_partkey * 91 % 700 AS INT) AS y0, 8.0::DOUBLE + [0, 0, 0, 3, 6, 9][p_partkey % 6 + 1] AS size, p_name AS text FROM part WHERE p_partkey % 7 < 5)"


@query(f"""WITH {PAGES}, n AS (SELECT p_brand, size, sum(length(text)) AS n FROM s GROUP BY 1, 2), body AS (SELECT p_brand, size AS body FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, size) = 1),
    b AS (SELECT p_brand, page, 1 AS rank, min(y0) AS y0, min(x0) AS x0, block, max(size) AS size, string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM s GROUP BY p_brand, page, block),
    l AS (SELECT p_brand, page, rank, y0, x0, block, text, CASE WHEN length(text) >= 160 THEN NULL WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.35 THEN 2 WHEN size / body >= 1.15 THEN 3 END AS level FROM b JOIN body USING (p_brand)),
    u AS (SELECT p_brand, page, rank, y0, x0, block, CASE WHEN level IS NULL THEN 'para' ELSE 'heading' END AS kind, level, text FROM l UNION ALL SELECT DISTINCT p_brand, page, 0, NULL, NULL, NULL, 'page', NULL, '' FROM s
        UNION ALL SELECT DISTINCT p_brand, page, 2, NULL, NULL, NULL, 'figure', NULL, '' FROM s WHERE p_partkey % 35 = 1)
    SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY page, rank, y0, x0, block) - 1 AS INT) AS pos, kind, CAST(level AS INT) AS level, text, CASE WHEN kind = 'page' THEN page END AS number FROM u""")
def paged_blocks(spark, sf_dir):
    """Spans on pages as blocks in reading order, up to the fifth page."""
    size = F.lit(8.0) + F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 3, 6, 9)]), (F.col("p_partkey") % 6 + 1).cast("int"))
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select("p_brand", k, (k % 7 + 1).cast("int").alias("page"), F.floor(k / 3).alias("block"), (k * 37 % 500).cast("int").alias("x0"), (k * 91 % 700).cast("int").alias("y0"), size.alias("size"), F.col("p_name").alias("text"))
    return sp.page_blocks(s, ["p_brand"], s.filter("p_partkey % 35 = 1"), 5)


@query(r"""WITH c AS (SELECT text, len(regexp_extract_all(text, '\S+')) AS n FROM conversations) SELECT CASE WHEN n > 200 THEN 'large' WHEN n > 50 THEN 'medium' ELSE 'small' END AS bucket,
    CAST(sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS n, avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END) AS accuracy, avg(n) AS mean_tokens FROM c GROUP BY 1""")
def score_buckets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("the").alias("gold"), F.col("text").alias("pred"), tk.words(F.col("text")).alias("prompt_tokens"))
    return qs.score_answers(c.withColumn("bucket", qs.bucket(F.col("prompt_tokens"), {"large": 200, "medium": 50})), ["bucket"])


@query("""WITH n AS (SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)
    SELECT p_brand, CAST(r AS INT) AS row, c.i AS anchor, c.t AS text FROM (SELECT p_brand, r, unnest([{'i': 0, 't': CAST(p_partkey AS VARCHAR)}, {'i': 1, 't': p_name}, {'i': 2, 't': CAST(p_size AS VARCHAR)}]) AS c FROM n)""")
def borderless_cells(spark, sf_dir):
    """Each brand's parts as words on a page, in three columns without borders, with a line of text above."""
    p = table(spark, sf_dir, "part")
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    cells = F.posexplode(F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")))
    w = p.select("p_brand", row.alias("r"), "p_partkey", "p_name", "p_size").select("p_brand", "r", cells.alias("c", "cell"))
    w = w.select("p_brand", "r", "c", F.posexplode(F.split("cell", " ")).alias("k", "text"), "cell")
    start = F.lit(60.0) + F.col("c") * 300 + F.length(F.array_join(F.slice(F.split("cell", " "), F.lit(1), F.col("k")), " ")) * 5 + F.when(F.col("k") > 0, 5).otherwise(0)
    y = F.lit(100.0) + F.col("r") * 16
    w = w.select("p_brand", (F.col("r") * 1000 + F.col("c") * 100 + F.col("k")).cast("long").alias("id"), start.alias("x0"), y.alias("y0"), (start + F.length("text") * 5).alias("x1"), (y + 10).alias("y1"), "text")
    line = p.select("p_brand").distinct().select("p_brand", F.lit(-1).cast("long").alias("id"), F.lit(60.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(30.0).alias("y1"), F.lit("Parts:").alias("text"))
    return sp.borderless_tables(w.unionByName(line), ["p_brand"]).select("p_brand", "row", "anchor", "text")
