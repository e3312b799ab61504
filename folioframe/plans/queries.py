"""Queries over seeded PDF collections: table rows become PDF bytes, which are parsed back into tables.

The oracle states each answer over the seed tables alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import cos, filters
from folioframe.functions.fonts import FONT_FLAGS
from folioframe.operators import compression, forms, graph, images, predicates, security, signatures, text, writers
from folioframe.sources import corpus, pdf, signing

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}
_oracles: dict[str, str] = {}

# SQL over documents: d(doc_id, flat, n_lines, n_pages).
FLAT = r"regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f-\x9f]', ' ', 'g')"
LAID = f"""WITH f AS (SELECT doc_id, lang, {FLAT} AS flat FROM documents),
d AS (SELECT doc_id, lang, flat, ceil(length(flat) / 80.0)::BIGINT AS n_lines,
  greatest(1, ceil(ceil(length(flat) / 80.0) / 40.0))::BIGINT AS n_pages FROM f)"""
PAGED = LAID + ", p AS (SELECT doc_id, lang, flat, n_lines, unnest(range(0, n_pages)) AS page_index FROM d)"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _registry[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def through(kind: str, change: Callable) -> Callable:
    """An Arrow UDF out of a function of plain values; nulls stay null."""
    arrow = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[kind]

    @F.arrow_udf(kind)
    def batch(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in r else change(*r) for r in rows], arrow)

    return batch


# ---- scans ----


@query("SELECT '1.' || (4 + doc_id % 4) AS version, count(*) AS n FROM documents GROUP BY 1")
def scan_header_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.documents(spark, sf_dir)
    return files.groupBy(pdf.header_version(F.col("content")).alias("version")).agg(F.count("*").alias("n"))


@query(
    LAID
    + """ SELECT doc_id AS file_id, (CASE WHEN doc_id % 7 = 3 THEN 6 ELSE 4 END + 2 * n_pages
  + CASE WHEN doc_id % 3 = 0 THEN 1 + ceil((CASE WHEN doc_id % 7 = 3 THEN 5 ELSE 4 END + n_pages) / 200.0) ELSE 0 END)::BIGINT AS n_objects FROM d"""
)
def scan_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.objects(corpus.documents(spark, sf_dir))
    return found.groupBy("file_id").agg(F.count("*").alias("n_objects"))


@query(
    LAID
    + """ SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'stream' ELSE 'table' END AS src,
  ((CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END + n_pages + 1 + CASE WHEN doc_id % 3 = 0 THEN ceil((CASE WHEN doc_id % 7 = 3 THEN 5 ELSE 4 END + n_pages) / 200.0)
    ELSE CASE WHEN doc_id % 7 = 3 THEN 4 ELSE 3 END + n_pages END)::BIGINT
    + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0 END)::BIGINT AS in_use,
  (CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 3 THEN 5 ELSE 4 END + n_pages ELSE 0 END)::BIGINT AS compressed FROM d"""
)
def xref_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = pdf.xref_winners(pdf.xref_sections(corpus.documents(spark, sf_dir)))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return won.groupBy("file_id", "src").agg(count("in_use"), count("compressed"))


@query(
    """SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN true ELSE false END AS strict_ok, doc_id % 5 <> 0 AS xref_recovered,
  (doc_id % 5 = 1) AS no_header FROM documents"""
)
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.recovery(corpus.damaged(spark, sf_dir))
    return found.select("file_id", "strict_ok", "xref_recovered", F.array_contains("warnings", "no PDF header").alias("no_header"))


@query(LAID + " SELECT doc_id AS file_id, n_pages::INTEGER AS n_pages FROM d")
def lenient_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.recovery(corpus.damaged(spark, sf_dir)).select("file_id", "n_pages")


# ---- pages ----


@query(
    PAGED
    + """ SELECT doc_id AS file_id, page_index::INTEGER AS page_index,
  [612.0, 595.0, 500.0 + doc_id % 50][(doc_id % 3 + 1)::INTEGER]::DOUBLE AS width, [792.0, 842.0, 700.0][(doc_id % 3 + 1)::INTEGER]::DOUBLE AS height,
  (90 * (doc_id % 4))::INTEGER AS rotate FROM p"""
)
def pages_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pages(corpus.documents(spark, sf_dir)).select("file_id", "page_index", "width", "height", "rotate")


@query(LAID + " SELECT doc_id AS file_id, n_pages FROM d")
def pages_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pages(corpus.documents(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("n_pages"))


@query(PAGED + " SELECT doc_id AS file_id, page_index::INTEGER AS page_index, (10 + 2 * page_index)::BIGINT AS obj_num FROM p")
def page_tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pages_recursive(spark, pdf.objects(corpus.documents(spark, sf_dir)))


@query(LAID + " SELECT doc_id AS file_id, ((90 * (doc_id % 4) + 270) % 360)::INTEGER AS rotate, n_pages FROM d")
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = writers.rotate_pages(corpus.documents(spark, sf_dir), 270)
    return pdf.pages(turned).groupBy("file_id", "rotate").agg(F.count("*").alias("n_pages"))


@query(
    LAID
    + """ SELECT doc_id AS file_id, part::INTEGER AS part, least(3, n_pages - 3 * part)::BIGINT AS n_pages FROM (
  SELECT doc_id, n_pages, unnest(range(0, ceil(n_pages / 3.0)::BIGINT)) AS part FROM d)"""
)
def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = writers.split_every(corpus.documents(spark, sf_dir), 3)
    keyed = parts.select(F.struct("file_id", "part").alias("file_id"), "content")
    counted = pdf.pages(keyed.select((F.col("file_id.file_id") * 100_000 + F.col("file_id.part")).alias("file_id"), "content")).groupBy("file_id").agg(F.count("*").alias("n_pages"))
    return counted.select((F.floor(F.col("file_id") / 100_000)).alias("file_id"), F.pmod("file_id", F.lit(100_000)).cast("int").alias("part"), "n_pages")


@query(
    LAID
    + r""", t AS (SELECT doc_id, flat, n_pages, unnest(CASE WHEN n_pages > 1 THEN [1, 0, 0] ELSE [0, 0] END) AS page,
  unnest(CASE WHEN n_pages > 1 THEN [0, 1, 2] ELSE [0, 1] END) AS page_index FROM d)
SELECT doc_id AS file_id, page_index::INTEGER AS page_index, length(substr(flat, page * 3200 + 1, 3200))::BIGINT AS n_chars FROM t WHERE length(substr(flat, page * 3200 + 1, 3200)) > 0"""
)
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = writers.extract_pages(corpus.documents(spark, sf_dir), [1, 0, 0])
    return pdf.text_chunk_table(cut).groupBy("file_id", "page_index").agg(F.sum(F.length("text")).alias("n_chars"))


@query(
    LAID
    + """ SELECT doc_id % 16 AS file_id, sum(n_pages)::BIGINT AS n_pages, sum(length(flat))::BIGINT AS n_chars FROM d GROUP BY 1"""
)
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = writers.merge_files(corpus.documents(spark, sf_dir), F.pmod("file_id", F.lit(16)), F.col("file_id"))
    chunks = pdf.text_chunk_table(merged).groupBy("file_id").agg(F.sum(F.length("text")).alias("n_chars"))
    return pdf.pages(merged).groupBy("file_id").agg(F.count("*").alias("n_pages")).join(chunks, "file_id")


# ---- text ----


@query(
    PAGED
    + """, l AS (SELECT doc_id, page_index, n, substr(flat, (page_index * 40 + n) * 80 + 1, 80) AS line
  FROM p, range(0, 40) t(n) WHERE page_index * 40 + n < n_lines)
SELECT doc_id AS file_id, page_index::INTEGER AS page_index, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY 1, 2"""
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_text(pdf.text_chunk_table(corpus.documents(spark, sf_dir)))


@query(
    LAID
    + """ SELECT lang, count(*) AS docs, sum(n_pages)::BIGINT AS pages,
  sum(length(flat) + greatest(n_lines - n_pages, 0))::BIGINT AS chars FROM d GROUP BY lang"""
)
def doc_text_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: load, page tree, content, fonts, text, then an aggregate."""
    files = corpus.documents(spark, sf_dir)
    pages = pdf.pages(files).groupBy("file_id").agg(F.count("*").alias("pages"))
    chars = text.page_text(pdf.text_chunk_table(files)).groupBy("file_id").agg(F.sum(F.length("text")).alias("chars"))
    langs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    joined = langs.join(pages, "file_id").join(chars, "file_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("pages").alias("pages"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars"))


@query(
    PAGED
    + """ SELECT doc_id AS file_id, page_index::INTEGER AS page_index, n::INTEGER AS line_index, (700 - 12 * n)::DOUBLE AS y,
  substr(flat, (page_index * 40 + n) * 80 + 1, 80) AS text FROM p, range(0, 40) t(n) WHERE page_index * 40 + n < n_lines"""
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.lines(pdf.text_chunk_table(corpus.documents(spark, sf_dir)))
    return found.select("file_id", "page_index", F.col("line_index").cast("int").alias("line_index"), "y", "text")


@query(
    PAGED
    + """, l AS (SELECT doc_id, page_index, n, substr(flat, (page_index * 40 + n) * 80 + 1, 80) AS line
  FROM p, range(0, 40) t(n) WHERE page_index * 40 + n < n_lines)
SELECT doc_id AS file_id, page_index::INTEGER AS page_index, 50.0::DOUBLE AS x_min, (50 + 6 * max(octet_length(encode(line))))::DOUBLE AS x_max, count(*) AS n_chunks
FROM l GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.columns(pdf.text_chunk_table(corpus.documents(spark, sf_dir)))
    return found.select("file_id", "page_index", "x_min", "x_max", "n_chunks")


@query(PAGED + " SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 3 THEN 'Type0' ELSE 'Type1' END AS subtype, CASE WHEN doc_id % 7 = 3 THEN 'Adobe-Identity-0' END AS ros, count(*) AS pages, max(CASE WHEN doc_id % 7 = 3 THEN 600.0 ELSE 0.0 END)::DOUBLE AS missing_width FROM p GROUP BY 1, 2, 3")
def fonts_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.font_table(corpus.documents(spark, sf_dir))
    return found.groupBy("file_id", "subtype", "ros").agg(F.count("*").alias("pages"), F.max("missing_width").alias("missing_width"))


@query(
    LAID
    + r""" SELECT doc_id AS file_id, ord(c)::INTEGER AS code_point, count(*) AS n FROM (
  SELECT doc_id, unnest(string_split(flat, '')) AS c FROM d WHERE doc_id % 7 = 3) GROUP BY 1, 2"""
)
def cmap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters shown in Type0 fonts, through their ToUnicode maps."""
    files = corpus.documents(spark, sf_dir)
    composite = pdf.font_table(files).where("subtype = 'Type0'").select("file_id").distinct()
    shown = pdf.text_chunk_table(files).join(composite, "file_id", "left_semi")
    chars = shown.select("file_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    code_point = F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("int")
    return chars.groupBy("file_id", code_point.alias("code_point")).agg(F.count("*").alias("n"))


# ---- filters and values ----


@query(
    LAID
    + """ SELECT doc_id % 6 AS chain, count(*) AS pages, bool_and(true) AS decoded FROM (SELECT doc_id, unnest(range(0, n_pages)) FROM d) GROUP BY 1"""
)
def filter_chain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.decoded_streams(pdf.objects(corpus.documents(spark, sf_dir)))
    pages = found.where("obj_num >= 10 and obj_num % 2 = 1 and coalesce(type, '') = ''")
    starts = F.startswith("data", F.lit(b"BT /F1")) & F.endswith("data", F.lit(b"ET"))
    return pages.groupBy(F.pmod("file_id", F.lit(6)).alias("chain")).agg(F.count("*").alias("pages"), F.coalesce(F.bool_and(starts), F.lit(False)).alias("decoded"))


@query("SELECT doc_id AS file_id, sha256(encode(coalesce(text, ''))) AS sha, octet_length(encode(coalesce(text, '')))::INTEGER AS n_bytes FROM documents")
def hex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCIIHex written and read: the reader in SQL, the writer in Python."""
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    coded = docs.withColumn("coded", through("binary", filters.ascii_hex_encode)("raw"))
    back = F.unhex(F.replace(F.decode("coded", "ISO-8859-1"), F.lit(">"), F.lit("")))
    return coded.select("file_id", F.sha2(back, 256).alias("sha"), F.octet_length(back).alias("n_bytes"))


@query(r"SELECT doc_id AS file_id, regexp_replace(coalesce(text, ''), '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g') AS text FROM documents")
def string_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as PDF strings: escaped, parsed, decoded as Latin-1 without control characters."""
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = through("binary", lambda t: cos.parse(cos.write(t.encode("latin-1", "replace")))[0])
    plain = F.regexp_replace(F.decode(coded("text"), "ISO-8859-1"), r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return docs.select("file_id", plain.alias("text"))


@query("SELECT p_partkey, p_name AS name, '/' || replace(replace(replace(p_name, '#', '#23'), ' ', '#20'), '/', '#2F') AS written FROM part")
def name_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corpus.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    written = through("string", lambda n: cos.write(cos.Name(n)).decode("latin-1"))
    back = through("string", lambda w: str(cos.parse(w.encode("latin-1"))[0]))
    return parts.withColumn("written", written("p_name")).select("p_partkey", back("written").alias("name"), "written")


@query(
    "SELECT c_custkey, "
    + ", ".join(f"(c_custkey >> {i}) & 1 = 1 AS {name}" for i, name in enumerate(security.PERMISSIONS))
    + ", p & -4 | 192 AS written FROM (SELECT c_custkey, ("
    + " + ".join(f"((c_custkey >> {i}) & 1) * {1 << bit}" for i, bit in enumerate(security.PERMISSIONS.values()))
    + ") + 4294963392 - 4294967296 AS p FROM customer)"
)
def permission_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/P`` in a trailer dictionary, written and parsed, then read bit by bit."""
    value = through("long", lambda k: cos.parse(cos.write({"P": corpus.permission_bits(k)}))[0]["P"])
    keys = corpus.table(spark, sf_dir, "customer").select("c_custkey").withColumn("p", value("c_custkey"))
    return keys.select("c_custkey", *[c.alias(n) for n, c in security.permission_flags(F.col("p")).items()], security.permission_value(F.col("p")).alias("written"))


@query("SELECT p_partkey, " + ", ".join(f"((p_partkey * 37) >> {bit}) & 1 = 1 AS {name}" for name, bit in FONT_FLAGS.items()) + " FROM part")
def font_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = through("long", lambda k: cos.parse(cos.write({"Flags": k * 37}))[0]["Flags"])
    keys = corpus.table(spark, sf_dir, "part").select("p_partkey").withColumn("flags", flags("p_partkey"))
    return keys.select("p_partkey", *[c.alias(n) for n, c in security.flag_columns(F.col("flags"), FONT_FLAGS).items()])


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN (p_partkey * 4096) & 65536 > 0 THEN 'push_button' WHEN (p_partkey * 4096) & 32768 > 0 THEN 'radio' ELSE 'checkbox' END
  WHEN 1 THEN CASE WHEN (p_partkey * 4096) & 131072 > 0 THEN 'combo' ELSE 'list' END WHEN 2 THEN 'text' ELSE 'signature' END AS kind FROM part"""
)
def field_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = F.element_at(F.array(*[F.lit(x) for x in ("Btn", "Ch", "Tx", "Sig")]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    keys = corpus.table(spark, sf_dir, "part").select("p_partkey", ft.alias("ft"))
    kind = through("string", lambda t, k: pdf.field_kind(t, cos.parse(cos.write({"Ff": k * 4096}))[0]["Ff"]))
    return keys.select("p_partkey", kind("ft", "p_partkey").alias("kind"))


# ---- metadata, outlines, forms ----


@query("SELECT item_id AS file_id, coalesce(text, '') AS title, 'author ' || item_id AS author, 'D:20240102030405+00''00''' AS creation_date FROM benchmark")
def info_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.doc_info(corpus.test_items(spark, sf_dir)).select("file_id", "title", "author", "creation_date")


@query("SELECT item_id AS file_id, coalesce(text, '') AS title FROM benchmark")
def xmp_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.doc_info(corpus.test_items(spark, sf_dir))
    return found.select("file_id", F.xpath_string("xmp", F.lit("//*[local-name()='title']//*[local-name()='li']")).alias("title"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
i AS (SELECT conv_id, [0] AS path, 'conversation ' || conv_id AS title, NULL AS dest_kind, NULL AS uri FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, [0, n], role || ' ' || turn, 'GoTo', NULL FROM t
  UNION ALL SELECT conv_id, [0, n, 0], 'note', 'URI', 'http://example.com/' || turn FROM t WHERE role = 'assistant')
SELECT conv_id AS file_id, (row_number() OVER (PARTITION BY conv_id ORDER BY path))::INTEGER AS preorder, (len(path) - 1)::INTEGER AS depth, title, dest_kind, uri FROM i"""
)
def outline_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    found = pdf.outlines(corpus.conversations(spark, sf_dir))
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("path"))
    return found.select("file_id", order.alias("preorder"), "depth", "title", "dest_kind", "uri")


@query(
    """SELECT 1 + max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::INTEGER AS depth, count(DISTINCT conv_id) AS n FROM (
  SELECT conv_id, max(role) FILTER (role = 'assistant') AS role FROM conversations GROUP BY conv_id) GROUP BY role IS NULL"""
)
def outline_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.outlines(corpus.conversations(spark, sf_dir)).groupBy("file_id").agg(F.max("depth").alias("depth"))
    return found.groupBy("depth").agg(F.count("*").alias("n"))


LATEST = "SELECT user_id AS file_id, event_type AS name, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1, 2"


@query(f"SELECT file_id, name, latest::VARCHAR AS value, (latest % 4)::INTEGER AS flags, 'text' AS kind FROM ({LATEST})")
def form_values_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental updates: the newest section's field wins."""
    return pdf.form_fields(corpus.forms(spark, sf_dir)).select("file_id", "name", "value", "flags", "kind")


@query(f"SELECT file_id, name, latest::VARCHAR AS value FROM ({LATEST})")
def xfdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.import_xfdf(forms.export_xfdf(pdf.form_fields(corpus.forms(spark, sf_dir))))


@query(f"SELECT file_id, name, '<' || latest || '>' AS value FROM ({LATEST})")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set from a table, written, and read again."""
    files = corpus.forms(spark, sf_dir)
    values = pdf.form_fields(files).select("file_id", "name", F.concat(F.lit("<"), "value", F.lit(">")).alias("value"))
    return pdf.form_fields(forms.set_values(files, values)).select("file_id", "name", "value")


@query(f"SELECT file_id, string_agg(latest::VARCHAR, '' ORDER BY name) AS shown FROM ({LATEST}) GROUP BY file_id")
def form_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pdf.text_chunk_table(forms.flatten(corpus.forms(spark, sf_dir)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "seq", "text"))), lambda c: c["text"])
    return chunks.groupBy("file_id").agg(F.array_join(ordered, "").alias("shown"))


@query("SELECT DISTINCT user_id AS file_id, 'Helv' AS font, 9.0::DOUBLE AS size, 0.0::DOUBLE AS r, 0.5::DOUBLE AS g, 1.0::DOUBLE AS b FROM events")
def default_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.form_fields(corpus.forms(spark, sf_dir))
    return found.select("file_id", *[c.alias(n) for n, c in forms.default_appearance(F.col("da")).items()]).distinct()


# ---- the object graph ----

GRAPH = "SELECT o_custkey, o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"SELECT o_custkey AS file_id, count(l_partkey) AS part_refs, count(l_partkey) AS line_refs, (count(l_partkey) + count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END))::BIGINT AS order_refs FROM ({GRAPH}) GROUP BY 1")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = graph.file_reference_counts(corpus.customers(spark, sf_dir))
    total = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n_refs"))), F.lit(0)).alias(f"{t.lower()}_refs")
    return counted.groupBy("file_id").agg(total("Part"), total("Line"), total("Order"))


@query(
    f"""SELECT o_custkey AS file_id, (3 + count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END)
  + 2 * count(CASE WHEN o_orderstatus <> 'F' THEN l_partkey END))::BIGINT AS n_reachable,
  (count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) + 2 * count(CASE WHEN o_orderstatus = 'F' THEN l_partkey END))::BIGINT AS n_lost FROM ({GRAPH}) GROUP BY 1"""
)
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = graph.file_reachable(corpus.customers(spark, sf_dir))
    return marked.groupBy("file_id").agg(F.count_if("live").alias("n_reachable"), F.count_if(~F.col("live")).alias("n_lost"))


@query(f"SELECT o_custkey AS file_id, sum(n)::BIGINT AS copies, count(*) AS groups FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM ({GRAPH}) WHERE l_partkey IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def object_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.file_duplicates(corpus.customers(spark, sf_dir))
    return found.groupBy("file_id").agg(F.count("*").alias("copies"), F.count_distinct("canonical").alias("groups"))


@query(
    f"""SELECT o_custkey AS file_id, (3 + count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END)
  + count(CASE WHEN o_orderstatus <> 'F' THEN l_partkey END) + count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN l_partkey END))::BIGINT AS n_objects FROM ({GRAPH}) GROUP BY 1"""
)
def compress_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects left after dedup and taking out what hangs on nothing, read back from the written files."""
    options = compression.Options(cleanup=False, pack=False)
    smaller = compression.compress(corpus.customers(spark, sf_dir), options)
    return pdf.object_counts(smaller)


@query("SELECT p_partkey AS file_id, page_index::INTEGER AS page_index, kind, name FROM (SELECT p_partkey, unnest(range(0, 1 + p_partkey % 3)) AS page_index FROM part), (VALUES ('Font', 'F9'), ('XObject', 'Im2')) v(kind, name)")
def dead_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.images(spark, sf_dir)
    return graph.dead_resources(pdf.pages(files), pdf.instruction_table(files)).select("file_id", "page_index", "kind", "name")


# ---- images ----


@query("SELECT p_partkey AS file_id, 50::BIGINT AS obj_num, round((8 + p_partkey % 40) / (1 + p_partkey % 3), 9)::DOUBLE AS dpi FROM part")
def effective_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.images(spark, sf_dir)
    pages = pdf.pages(files)
    uses = images.image_uses(pdf.instruction_table(files), graph.page_resources(pages))
    return images.effective_dpi(uses, pdf.objects(files), pages).select("file_id", "obj_num", F.round("dpi", 9).alias("dpi"))


@query("SELECT p_partkey AS file_id, v.obj_num::BIGINT AS obj_num, (8 + p_partkey % 40)::INTEGER AS width, (2 + p_size % 5)::INTEGER AS height, 'DeviceGray' AS color_space, true AS gray FROM part, (VALUES (50), (51)) v(obj_num)")
def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.file_image_table(corpus.images(spark, sf_dir))
    return found.select("file_id", "obj_num", "width", "height", "color_space", "gray")


@query("SELECT p_partkey AS file_id, (1 + p_partkey % 3)::BIGINT AS n, '01020304' AS data FROM part")
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.inline_images(pdf.instruction_table(corpus.images(spark, sf_dir)))
    return found.groupBy("file_id", F.hex("data").alias("data")).agg(F.count("*").alias("n"))


# ---- revisions, signatures, encryption ----


@query(
    """SELECT s_suppkey AS file_id, v.obj_num::BIGINT AS obj_num, v.change, CASE WHEN v.obj_num = 30 THEN 'permitted' ELSE 'unauthorized' END AS verdict FROM supplier,
  (VALUES (20, 'modified', 1, 0), (3, 'modified', 2, 1), (30, 'added', 3, 0)) v(obj_num, change, m, r) WHERE s_suppkey % v.m = v.r"""
)
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first revision, cut out at its end mark, against the whole file."""
    files = corpus.suppliers(spark, sf_dir)
    first = security.revisions(files).where("revision = 0")
    prefix = files.join(first, "file_id").select("file_id", F.substring("content", F.lit(1), F.col("end")).alias("content"))
    found = security.classify_change(security.revision_changes(pdf.objects(prefix), pdf.objects(files)))
    return found.select("file_id", "obj_num", "change", "verdict")


@query("SELECT s_suppkey AS file_id, 2::BIGINT AS n_revisions, true AS append_only FROM supplier")
def append_only_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.suppliers(spark, sf_dir)
    ends = security.revisions(files).groupBy("file_id").agg(F.count("*").alias("n_revisions"))
    pages = pdf.pages(files)
    first = security.revisions(files).where("revision = 0")
    prefix = files.join(first, "file_id").select("file_id", F.substring("content", F.lit(1), F.col("end")).alias("content"))
    listed = lambda p: p.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "obj_num"))).alias("kids"))
    both = listed(pdf.pages(prefix)).withColumnRenamed("kids", "old").join(listed(pages), "file_id")
    same = F.slice("kids", F.lit(1), F.size("old")) == F.col("old")
    return ends.join(both, "file_id").select("file_id", "n_revisions", same.alias("append_only"))


SIGNED = """WITH s AS (SELECT doc_id, '%PDF-1.7 ' || repeat('x', (60 + doc_id % 40)::INTEGER) || '/Contents' AS head,
  '<' || repeat('0', 40) || '>' AS gap, ' rest of ' || doc_id AS tail FROM documents)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of signed files: two ranges around a hexadecimal gap; every third file's ranges are broken."""
    key = F.col("doc_id")
    head = F.concat(F.lit("%PDF-1.7 "), F.repeat(F.lit("x"), (60 + F.pmod(key, F.lit(40))).cast("int")), F.lit("/Contents"))
    docs = corpus.table(spark, sf_dir, "documents").select(key.alias("file_id"), head.alias("head"), F.concat(F.lit(" rest of "), key.cast("string")).alias("tail"))
    gap = "<" + "0" * 40 + ">"
    n = F.length("head").cast("long")
    broken = F.pmod("file_id", F.lit(3)) == 2
    ranges = F.array(F.when(broken, F.lit(1)).otherwise(F.lit(0)).cast("long"), n, n + len(gap), F.length("tail").cast("long"))
    return docs.select("file_id", F.encode(F.concat("head", F.lit(gap), "tail"), "UTF-8").alias("content"), ranges.alias("r"))


@query(SIGNED + " SELECT doc_id AS file_id, sha256(head || tail) AS digest FROM s WHERE doc_id % 3 <> 2")
def byterange_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signed(spark, sf_dir).where("r[0] = 0")
    return found.select("file_id", security.byte_range_digest(F.col("content"), F.col("r")).alias("digest"))


@query(
    """SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 2 THEN 'ByteRange does not start at 0; gap does not start with ''<''' ELSE '' END AS warnings, false AS misplaced FROM documents"""
)
def usf_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signed(spark, sf_dir)
    warnings = F.array_join(security.byte_range_warnings(F.col("content"), F.col("r")), "; ")
    return found.select("file_id", warnings.alias("warnings"), security.contents_misplaced(F.col("content"), F.col("r")).alias("misplaced"))


def _chained(first: str, rounds: int) -> str:
    """MD5 of the leading 16 bytes, again and again, over hexadecimal text."""
    return first if not rounds else f"md5(unhex(substr({_chained(first, rounds - 1)}, 1, 32)))"


@query(
    f"""WITH k AS (SELECT c_custkey, 'user' || c_custkey AS word FROM customer),
  h AS (SELECT c_custkey, substr(hex(encode(word)) || '{security.PAD.hex().upper()}', 1, 64) || sha256(encode(word)) || 'D4FFFFFF' || hex(encode('0123456789abcdef')) AS seed FROM k)
SELECT c_custkey, substr(md5(unhex(seed)), 1, 10) AS key_40, substr({_chained("md5(unhex(seed))", 50)}, 1, 32) AS key_128 FROM h"""
)
def key_derivation_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File keys of revisions 2 and 3 in SQL (50 chained rounds of MD5); tested against the plain algorithm."""
    keys = corpus.table(spark, sf_dir, "customer").select("c_custkey")
    word = F.encode(F.concat(F.lit("user"), F.col("c_custkey").cast("string")), "UTF-8")
    owner = F.unhex(F.sha2(word, 256))
    made = lambda rev, n: F.lower(F.hex(security.encryption_key(word, owner, F.lit(-44), F.lit(b"0123456789abcdef"), rev, n)))
    return keys.select("c_custkey", made(2, 5).alias("key_40"), made(3, 16).alias("key_128"))


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, octet_length(encode(o_orderstatus || o_orderkey)) AS n_bytes FROM orders),
  p AS (SELECT o_custkey, o_orderkey, (1000 + coalesce(sum(n_bytes) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
    o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM b)
SELECT o_custkey AS file_id, o_orderkey AS obj_num, "offset", min(o_orderkey) OVER (PARTITION BY o_custkey, island) AS run_start FROM p"""
)
def incremental_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = corpus.table(spark, sf_dir, "orders")
    n_bytes = F.octet_length(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    sizes = orders.select(F.col("o_custkey").alias("file_id"), F.lit(1000).alias("base"), F.col("o_orderkey").alias("obj_num"), n_bytes.alias("n_bytes"))
    return writers.update_offsets(sizes).select("file_id", "obj_num", "offset", "run_start")


@query(LAID + " SELECT doc_id AS file_id, (CASE WHEN doc_id % 7 = 3 THEN 6 ELSE 4 END + 2 * n_pages)::BIGINT AS n_objects, n_pages FROM d")
def full_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object and trailer rows written as files and parsed again."""
    files = corpus.documents(spark, sf_dir)
    first = pdf.trailers(files).where("section_ord = 0").select("file_id", "key", "value")
    again = writers.write_objects(pdf.objects(files), first)
    pages = pdf.pages(again).groupBy("file_id").agg(F.count("*").alias("n_pages"))
    return pdf.objects(again).groupBy("file_id").agg(F.count("*").alias("n_objects")).join(pages, "file_id")


@query(LAID + " SELECT doc_id AS file_id, n_pages AS marked FROM d")
def watermark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pdf.text_chunk_table(writers.watermark(corpus.documents(spark, sf_dir), "DRAFT"))
    return chunks.where("text = 'DRAFT'").groupBy("file_id").agg(F.count_distinct("page_index").alias("marked"))


@query(
    """WITH k(kind, x, y, w, h) AS (VALUES ('full', 0.0, 0.0, 600.0, 800.0), ('header', 30.0, 660.0, 540.0, 120.0), ('footer', 30.0, 20.0, 540.0, 80.0), ('top_left', 10.0, 700.0, 90.0, 90.0),
  ('center', 255.0, 355.0, 90.0, 90.0), ('bottom_right', 500.0, 10.0, 90.0, 90.0)) SELECT kind, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM k"""
)
def overlay_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ("full", "header", "footer", "top_left", "center", "bottom_right")])).alias("kind"))
    placed = writers.overlay_placement(F.col("kind"), F.lit(600.0), F.lit(800.0))
    return kinds.select("kind", *[F.round(placed[c], 9).alias(c) for c in "xywh"])


@query("SELECT s_suppkey AS file_id, s_suppkey % 2 = 0 AS by_anyone, s_name AS title, 'Name ' || s_name AS text FROM supplier")
def encrypted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RC4 and AES files opened without a password and with one; those that neither opens give no row. What is read is rotated first, so rewrites are readable too."""
    files = corpus.secrets(spark, sf_dir)

    def shown(opened: DataFrame, by_anyone: bool) -> DataFrame:
        opened = opened.where("content is not null")
        words = text.page_text(pdf.text_chunk_table(opened)).select("file_id", "text")
        return words.join(pdf.doc_info(opened).select("file_id", "title"), "file_id").select("file_id", F.lit(by_anyone).alias("by_anyone"), "title", "text")

    by_all, by_some = writers.rotate_pages(files, 90), security.decrypted(files, "secret")
    by_some = by_some.join(by_all.where("content is null").select("file_id"), "file_id")
    return shown(by_all, True).unionByName(shown(by_some, False))


@query(
    """SELECT s_suppkey AS file_id, s_name AS field_name, c <> 5 AS digest_match, c NOT IN (1, 2) AS signature_ok, c <> 3 AS chain_ok, 'CN=' || s_name AS signer,
  true AS trusted, c NOT IN (1, 2, 3, 5) AS trust_verified, c = 4 AS expired, (1 + s_suppkey % 3)::INTEGER AS mdp_level, 0::INTEGER AS revision,
  CASE WHEN c = 7 THEN 1 ELSE 0 END::INTEGER AS crls, CASE WHEN c = 7 THEN 2 ELSE 0 END::INTEGER AS certs, false AS ltv, 0::INTEGER AS n_warnings
FROM (SELECT *, s_suppkey % 8 AS c FROM supplier)"""
)
def signature_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed files read again: digests, signatures and chains as they are, forged, expired, changed or added to."""
    from datetime import datetime

    files = signing.signed(spark, sf_dir)
    found = signatures.signatures(files)
    judged = signatures.judged(found, files, ["cn=ROOT"], datetime(2030, 1, 1))
    placed = signatures.revision_of_signature(found, security.revisions(files)).select("file_id", F.col("revision").cast("int").alias("revision"))
    return judged.join(placed, "file_id").select(
        "file_id", "field_name", "digest_match", "signature_ok", "chain_ok", F.col("subjects")[0].alias("signer"), "trusted", "trust_verified", "expired",
        "mdp_level", "revision", F.col("dss_crls").alias("crls"), F.col("dss_certs").alias("certs"), "ltv", F.size("usf_warnings").alias("n_warnings"),
    )


@query(
    PAGED
    + """ SELECT doc_id AS file_id, page_index::INTEGER AS page_index, string_agg(substr(flat, (page_index * 40 + n) * 80 + 1, 80), chr(10) ORDER BY n) AS text
FROM p, range(0, 40) t(n) WHERE page_index * 40 + n < n_lines GROUP BY ALL"""
)
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.layout_text(pdf.text_chunk_table(corpus.documents(spark, sf_dir))).select("file_id", "page_index", "text")


@query(LAID + " SELECT doc_id AS file_id, n_pages AS stamped FROM d")
def overlay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under the pages of another copy of it, as forms."""
    files = corpus.documents(spark, sf_dir)
    stamped = writers.overlay(files, files.select("file_id", F.col("content").alias("stamp")), "center")
    drawn = pdf.instruction_table(stamped).where(predicates.is_operator("do")).where(F.contains(F.col("operands")[0], F.lit("FxOv")))
    return drawn.groupBy("file_id").agg(F.count_distinct("page_index").alias("stamped"))


@query(f"SELECT file_id, name, latest::VARCHAR AS value FROM ({LATEST})")
def fdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.import_fdf(forms.export_fdf(pdf.form_fields(corpus.forms(spark, sf_dir))))


XFA_DATA = "'<data><name>' || c_name || '</name><n>' || c_custkey || '</n></data>'"


@query(f"SELECT c_custkey AS file_id, {XFA_DATA} AS datasets, '<template/>' || {XFA_DATA} AS whole FROM customer")
def xfa_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = pdf.xfa_packets(corpus.xfa_forms(spark, sf_dir))
    one = forms.xfa_packet(packets, "DataSets").withColumnRenamed("xml", "datasets")
    return one.join(forms.xfa_document(packets).withColumnRenamed("xml", "whole"), "file_id")


@query("SELECT c_custkey AS file_id, true AS has_acroform, true AS has_xfa, false AS encrypted, false AS can_downgrade FROM customer")
def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.xfa_forms(spark, sf_dir)
    return predicates.document_flags(pdf.objects(files), pdf.trailers(files))


@query(
    """SELECT p_partkey AS file_id, p_name AS title, NULL::VARCHAR AS author, 'D:20240102' || lpad((p_partkey % 24)::VARCHAR, 2, '0') || '0405+00''00''' AS mod_date,
  'keep ' || p_type AS subject FROM part"""
)
def info_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the information dictionary set, removed and kept."""
    parts = corpus.table(spark, sf_dir, "part")
    files = corpus.images(spark, sf_dir)
    hour = F.lpad(F.pmod("p_partkey", F.lit(24)).cast("string"), 2, "0")
    at = F.to_timestamp(F.concat(F.lit("2024-01-02 "), hour, F.lit(":04:05")))
    first = {"Author": F.lit("someone"), "Subject": F.concat(F.lit("keep "), "p_type")}
    then = {"Title": F.col("p_name"), "Author": F.lit(None).cast("string"), "ModDate": writers.pdf_date(at)}
    for values in (first, then):
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])).alias("p")
        files = writers.set_info(files, parts.select(F.col("p_partkey").alias("file_id"), pairs).select("file_id", "p.*"))
    return pdf.doc_info(files).select("file_id", "title", "author", "mod_date", "subject")


@query(
    LAID
    + """ SELECT doc_id AS file_id, (n // 40)::INTEGER AS page_index, 50.0::DOUBLE AS x0, (660 - 12 * (n % 40))::DOUBLE AS y0, 150.0::DOUBLE AS x1,
  (700 - 12 * (n % 40))::DOUBLE AS y1, 60.0::DOUBLE AS front
FROM (SELECT doc_id, min(n) AS n FROM (SELECT doc_id, flat, unnest(range(0, n_lines)) AS n FROM d) WHERE contains(substr(flat, n * 80 + 1, 80), 'th') GROUP BY doc_id)"""
)
def anchor_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a field anchored to the first text with a tag stands, over it and in front of it."""
    chunks = pdf.text_chunk_table(corpus.documents(spark, sf_dir))
    over = writers.anchor_rectangle(chunks, "th", 100.0, 40.0)
    front = writers.anchor_rectangle(chunks, "th", 100.0, 40.0, True).select("file_id", F.col("x0").alias("front"))
    return over.join(front, "file_id")


@query(
    """SELECT p_partkey AS file_id, v.obj_num::BIGINT AS obj_num, v.space AS color_space, v.alpha AS alpha, v.channels::INTEGER AS png_kind,
  CASE WHEN v.obj_num IN (50, 52) THEN false ELSE true END AS gray
FROM part, (VALUES (50, 'DeviceRGB', true, 6), (51, 'ICCBased', false, 2), (52, 'Indexed', false, 2), (53, 'DeviceRGB', false, 2), (54, 'DeviceGray', false, 0)) v(obj_num, space, alpha, channels)"""
)
def image_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with soft masks, profiles and palettes, exported; the kind of a PNG is the byte that names its channels."""
    found = images.file_image_table(corpus.layered_images(spark, sf_dir))
    kind = F.conv(F.hex(F.substring("png", 26, 1)), 16, 10).cast("int")
    return found.select("file_id", "obj_num", "color_space", "alpha", kind.alias("png_kind"), "gray")


@query(
    """SELECT p_partkey AS file_id, greatest(1, CASE WHEN dpi > 10 THEN floor(w * 10 / dpi + 0.5) ELSE w END)::INTEGER AS width,
  greatest(1, CASE WHEN dpi > 10 THEN floor(h * 10 / dpi + 0.5) ELSE h END)::INTEGER AS height
FROM (SELECT p_partkey, 8 + p_partkey % 40 AS w, 2 + p_size % 5 AS h, (8 + p_partkey % 40)::DOUBLE / ((72 * (1 + p_partkey % 3))::DOUBLE / 72) AS dpi FROM part)"""
)
def image_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images scaled down to 10 dots an inch, by how they are shown, written and read again."""
    files = compression.compress(corpus.images(spark, sf_dir), compression.Options(image_dpi=10, fonts=True))
    return images.image_table(pdf.objects(files)).where("obj_num = 50").select("file_id", "width", "height")


@query(LAID + " SELECT doc_id AS file_id, len(list_distinct(string_split(flat, '')))::BIGINT AS n_codes, length(flat)::BIGINT AS n_shown FROM d WHERE length(flat) > 0")
def glyph_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which codes of its font each document shows, and how often."""
    found = pdf.glyph_usage(corpus.documents(spark, sf_dir)).groupBy("file_id")
    return found.agg(F.count_distinct("code").alias("n_codes"), F.sum("n").alias("n_shown"))
