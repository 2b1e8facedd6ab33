"""Registered queries on page relations, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import boxes as B
from pagemill.operators import cascade as C
from pagemill.operators import ranges as S
from pagemill.operators import relations as R
from pagemill.operators.assembly import document_chunks as chunks
from pagemill.operators.references import dereference
from pagemill.operators.scan import recurrence, running
from pagemill.operators.structure import structured_text as structure
from pagemill.operators.trees import enumerate_nodes
from pagemill.plans import fixtures as X
from pagemill.plans.session import cut, removed_at_end, shared_folder
from pagemill.sources.bucketed import load_bucketed, save_bucketed
from pagemill.sources.sorted_sink import read_sorted, write_sorted
from pagemill.sources.table_functions import register_table_functions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: White space as DuckDB's patterns must spell it.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_NORM = lambda c: f"regexp_replace({_TRIM(c)}, '[0-9]+', '<NUM>', 'g')"
_LINES = lambda c: f"(CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN ends_with({c}, chr(10)) THEN string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10)) END)"
_SEEN = lambda c: f"CAST(length(regexp_replace({c}, '{WS}+', '', 'g')) AS BIGINT)"

DOC_PAGES = """doc_pages AS (
  SELECT doc_id, page, page_count, CASE WHEN page % 7 = 0 THEN text
         ELSE 'Collected papers of ' || doc_id || chr(10) || text || chr(10) || 'Page ' || page || ' of ' || page_count END AS text
  FROM (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
               count(*) OVER (PARTITION BY source) AS page_count, coalesce(text, '') AS text FROM documents))"""
CONV_PAGES = "conv_pages AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS BIGINT) AS page, coalesce(text, '') AS text FROM conversations)"


def _structure_sql(pages: str) -> str:
    return f"""
p AS (SELECT doc_id, page, text, {_LINES('text')} AS l FROM {pages}),
q AS (SELECT *, len(l) AS n FROM p),
d0 AS (SELECT doc_id, count(*) AS np, CAST(ceil(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS th FROM q GROUP BY doc_id),
spot AS (SELECT unnest([0, 1, 2]) AS pos),
ct AS (SELECT doc_id, pos, count(*) AS c FROM (SELECT doc_id, pos, {_NORM('l[pos + 1]')} AS line FROM q, spot WHERE n > pos) WHERE line <> '' GROUP BY doc_id, pos, line),
th AS (SELECT d0.doc_id, np, th, coalesce(max(CASE WHEN pos = 0 THEN c END), 0) >= th AS a, coalesce(max(CASE WHEN pos = 1 THEN c END), 0) >= th AS b, coalesce(max(CASE WHEN pos = 2 THEN c END), 0) >= th AS e
       FROM d0 LEFT JOIN ct ON d0.doc_id = ct.doc_id GROUP BY d0.doc_id, np, th),
h AS (SELECT doc_id, np, th, CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT e THEN 2 ELSE 3 END AS h FROM th),
cb AS (SELECT doc_id, pos, count(*) AS c FROM (SELECT q.doc_id, pos, {_NORM('l[n - pos]')} AS line FROM q JOIN h ON q.doc_id = h.doc_id, spot WHERE n - 1 - pos >= h.h) WHERE line <> '' GROUP BY doc_id, pos, line),
tb AS (SELECT h.doc_id, np, th, h, coalesce(max(CASE WHEN pos = 0 THEN c END), 0) >= th AS a, coalesce(max(CASE WHEN pos = 1 THEN c END), 0) >= th AS b, coalesce(max(CASE WHEN pos = 2 THEN c END), 0) >= th AS e
       FROM h LEFT JOIN cb ON h.doc_id = cb.doc_id GROUP BY h.doc_id, np, th, h),
f AS (SELECT doc_id, np, h, CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT e THEN 2 ELSE 3 END AS f FROM tb),
s AS (SELECT q.*, np, least(h, n) AS he, CASE WHEN f > 0 THEN greatest(n - f, 0, least(h, n)) ELSE n END AS fs FROM q JOIN f ON q.doc_id = f.doc_id)
SELECT doc_id, page, CASE WHEN np < 3 THEN '' ELSE array_to_string(l[1:he], chr(10)) END AS header,
       CASE WHEN np < 3 THEN text ELSE array_to_string(l[he + 1:fs], chr(10)) END AS body,
       CASE WHEN np < 3 THEN '' ELSE array_to_string(l[fs + 1:n], chr(10)) END AS footer FROM s"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOC_PAGES}, {_structure_sql('doc_pages')}")
def structured_text(spark, sf_dir):
    return structure(X.doc_pages(spark, sf_dir))


@query(f"WITH {CONV_PAGES}, {_structure_sql('conv_pages')}")
def structured_text_short(spark, sf_dir):
    return structure(X.conv_pages(spark, sf_dir))


@query(f"""WITH {DOC_PAGES},
a AS (SELECT doc_id, page, page_count, CASE WHEN page % 3 = 0 THEN text || chr(10) || ' / ' || chr(10) || page_count || chr(10)
      WHEN page % 3 = 1 THEN '/' || chr(10) || page_count || chr(10) || text || chr(10) || '/' || chr(10) || '0' ELSE text END AS text FROM doc_pages),
l AS (SELECT *, {_LINES('text')} AS l FROM a),
b AS (SELECT *, list_transform(l, lambda x: {_TRIM('x')}) AS b FROM l),
k AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: NOT (coalesce(b[i] = '/' AND b[i + 1] = CAST(page_count AS VARCHAR), false) OR (i > 1 AND coalesce(b[i - 1] = '/' AND b[i] = CAST(page_count AS VARCHAR), false)))) AS k FROM b)
SELECT doc_id, page, CASE WHEN len(k) = len(l) THEN text ELSE array_to_string(list_transform(k, lambda i: l[i]), chr(10)) END AS text FROM k""")
def footer_artifacts(spark, sf_dir):
    return X.artifact_pages(spark, sf_dir).select("doc_id", "page", T.strip_footer_artifacts(F.col("text"), F.col("page_count")).alias("text"))


@query(f"""SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(list_transform(l, lambda x: {_NORM('x')})) AS line
FROM (SELECT doc_id, {_LINES("coalesce(text, '')")} AS l FROM documents)""")
def normalize_lines(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalise_line(F.col("line")).alias("line"))


@query(f"SELECT doc_id, n_visible, n_visible >= 100 AS enough FROM (SELECT doc_id, {_SEEN(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS n_visible FROM documents)")
def nonws_counts(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select("doc_id", T.visible_chars(F.coalesce("text", F.lit(""))).alias("n_visible"))
    return d.withColumn("enough", F.col("n_visible") >= 100)


_ZONES = ("", "Z", "+05'30'", "-0800", "+02", "-1", "Z00'00'")


@query(f"""WITH r AS (SELECT o_orderkey AS id, left('D:' || strftime(o_orderdate, '%Y%m%d') || '101502', CAST(2 + o_orderkey % 15 AS BIGINT)) ||
  CASE WHEN o_orderkey % 15 = 14 THEN (['{"', '".join(z.replace("'", "''") for z in _ZONES)}'])[CAST(o_orderkey % 7 + 1 AS BIGINT)] ELSE '' END AS raw FROM orders),
s AS (SELECT id, raw, CASE WHEN starts_with(raw, 'D:') THEN raw[3:] ELSE raw END AS s FROM r),
z AS (SELECT *, s[15:] AS z, replace(s[15:], '''', '') AS b FROM s)
SELECT id, raw, CASE WHEN length(s) < 4 THEN raw ELSE s[1:4] || '-' || CASE WHEN length(s) >= 6 THEN s[5:6] ELSE '01' END || '-' || CASE WHEN length(s) >= 8 THEN s[7:8] ELSE '01' END
  || 'T' || CASE WHEN length(s) >= 10 THEN s[9:10] ELSE '00' END || ':' || CASE WHEN length(s) >= 12 THEN s[11:12] ELSE '00' END || ':' || CASE WHEN length(s) >= 14 THEN s[13:14] ELSE '00' END
  || CASE WHEN z = '' THEN '' WHEN starts_with(z, 'Z') THEN 'Z' WHEN length(b) >= 3 THEN b[1:3] || ':' || CASE WHEN length(b) >= 5 THEN b[4:5] ELSE '00' END ELSE '' END END AS iso FROM z""")
def pdf_dates(spark, sf_dir):
    o = X.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    body = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("101502"))
    zone = F.get(F.array(*[F.lit(z) for z in _ZONES]), (key % 7).cast("int"))
    raw = F.concat(F.substring(body, F.lit(1), (2 + key % 15).cast("int")), F.when(key % 15 == 14, zone).otherwise(""))
    return o.select(key.alias("id"), raw.alias("raw")).withColumn("iso", T.pdf_date_to_iso(F.col("raw")))


_RECTS = """rects AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page,
  CASE WHEN l_returnflag <> 'A' THEN [0.0::DOUBLE, floor(l_discount * 20) * 36, 600 - 12 * floor(l_quantity / 25), 792] END AS crop,
  CASE WHEN l_linestatus = 'O' THEN [612.0::DOUBLE, 792, 0, 0] WHEN l_returnflag = 'A' AND l_quantity > 40 THEN [0.0::DOUBLE, 0, 612] ELSE [0.0::DOUBLE, 0, 595, 842] END AS media FROM lineitem),
v AS (SELECT doc_id, page, CASE WHEN len(crop) >= 4 THEN crop END AS c, CASE WHEN len(media) >= 4 THEN media END AS m FROM rects),
w AS (SELECT doc_id, page, coalesce(c, m, [0.0::DOUBLE, 0, 0, 0]) AS b, CASE WHEN c IS NOT NULL THEN 'CropBox' WHEN m IS NOT NULL THEN 'MediaBox' ELSE 'Unknown' END AS box_type FROM v),
g AS (SELECT doc_id, page, least(b[1], b[3]) AS "left", least(b[2], b[4]) AS bottom, greatest(b[1], b[3]) AS "right", greatest(b[2], b[4]) AS top, box_type FROM w),
k AS (SELECT doc_id, "left", bottom, "right", top, box_type, count(*) AS n, min(page) AS first_page, list(page ORDER BY page) AS pages FROM g GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_page DESC) = 1 AS dominant, row_number() OVER (PARTITION BY doc_id ORDER BY first_page) AS box_index,
      CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS page_count FROM k)"""
_GEO = '"left", bottom, "right", top, "right" - "left" AS width, top - bottom AS height'


def _boxes(spark, sf_dir):
    return B.page_boxes(B.page_geometry(X.rects(spark, sf_dir)))


@query(f"WITH {_RECTS} SELECT doc_id, box_index, page_count, {_GEO}, box_type, CASE WHEN NOT dominant THEN pages END AS pages FROM x")
def page_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir)


@query(f"WITH {_RECTS} SELECT doc_id, page_count, {_GEO}, box_type FROM x WHERE dominant")
def dominant_box(spark, sf_dir):
    return _boxes(spark, sf_dir).where("pages is null").drop("box_index", "pages")


@query(f"WITH {_RECTS} SELECT doc_id, page, {_GEO}, box_type FROM g")
def expand_boxes(spark, sf_dir):
    return B.expand_boxes(_boxes(spark, sf_dir))


_ANNOTS = """t AS (SELECT CAST(page_id // 10 AS VARCHAR) AS doc_id, CAST(page_id % 10 + 1 AS BIGINT) AS page, url, coalesce(html, '') AS html FROM pages),
a AS (SELECT doc_id, page, CASE WHEN contains(dest, 'ó') THEN 'GoTo' ELSE 'Link' END AS subtype, NULL::VARCHAR AS uri, dest FROM (SELECT doc_id, page, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dest FROM t)
      UNION ALL SELECT doc_id, page, 'Link', url, NULL FROM t)"""


@query(f"WITH {_ANNOTS} SELECT doc_id, page, subtype, uri, dest FROM a")
def annotations(spark, sf_dir):
    return X.annotations(spark, sf_dir)


@query(f"WITH {_ANNOTS} SELECT subtype, count(*) AS n FROM a GROUP BY subtype")
def annot_by_subtype(spark, sf_dir):
    return R.annotations_by_subtype(X.annotations(spark, sf_dir))


@query(f"WITH {_ANNOTS} SELECT doc_id, list_sort(list(DISTINCT page)) AS pages FROM a WHERE subtype = 'GoTo' GROUP BY doc_id")
def annot_pages(spark, sf_dir):
    return R.distinct_pages(X.annotations(spark, sf_dir).where("subtype = 'GoTo'"))


@query(f"WITH {_ANNOTS} SELECT doc_id, page, uri FROM a WHERE uri IS NOT NULL")
def link_filter(spark, sf_dir):
    return R.links(X.annotations(spark, sf_dir)).select("doc_id", "page", "uri")


_XOBJ = """x AS (SELECT CAST(p_partkey % 97 AS VARCHAR) AS doc_id, CAST(p_size % 7 + 1 AS BIGINT) AS page, 'Im' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Form' ELSE 'Image' END AS subtype,
  CAST(p_size % 4 AS BIGINT) AS width, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS height, p_partkey FROM part),
nm AS (SELECT DISTINCT doc_id, page, name FROM x WHERE page % 2 = 0 AND p_partkey % 3 = 0),
pt AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.doc_id = x.doc_id AND nm.page = x.page) OR EXISTS (SELECT 1 FROM nm WHERE nm.doc_id = x.doc_id AND nm.page = x.page AND nm.name = x.name))"""


@query(f"""WITH {_XOBJ} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY name) - 1 AS image_index, name, width, height FROM pt WHERE subtype = 'Image' AND width > 0 AND coalesce(height, 0) > 0""")
def painted_xobjects(spark, sf_dir):
    x, names = X.xobjects(spark, sf_dir)
    index = F.expr("row_number() over (partition by doc_id, page order by name) - 1").cast("long")
    return R.usable_images(R.painted(x, names)).select("doc_id", "page", index.alias("image_index"), "name", "width", "height")


_TREE = """t AS (SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 6 = 5 THEN 'n' || (n_nationkey - 1) ELSE 'r' || n_regionkey END AS parent, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS v FROM nation
  UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey > 0 THEN 'r' || (r_regionkey - 1) END, CASE WHEN r_regionkey % 2 = 0 THEN r_name END FROM region)"""
_WALK = lambda ok: f"""WITH RECURSIVE {_TREE}, w AS (SELECT id, parent, 0 AS d, CASE WHEN {ok} THEN v END AS v FROM t UNION ALL SELECT w.id, t.parent, d + 1, CASE WHEN {ok.replace('v', 't.v')} THEN t.v END FROM w JOIN t ON w.parent = t.id WHERE w.v IS NULL)
SELECT id, max(v) AS found FROM w GROUP BY id"""  # noqa: E731


def _tree(spark, sf_dir):
    n, r = X.read(spark, sf_dir, "nation"), X.read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    a = n.select(F.concat(F.lit("n"), key.cast("string")).alias("id"), F.when(key % 6 == 5, F.concat(F.lit("n"), (key - 1).cast("string"))).otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("parent"), F.when(key % 3 == 0, F.col("n_name")).alias("v"))
    key = F.col("r_regionkey")
    return a.unionByName(r.select(F.concat(F.lit("r"), key.cast("string")).alias("id"), F.when(key > 0, F.concat(F.lit("r"), (key - 1).cast("string"))).alias("parent"), F.when(key % 2 == 0, F.col("r_name")).alias("v")))


@query(_WALK("v IS NOT NULL"))
def inherited_resource(spark, sf_dir):
    return R.nearest_ancestor(_tree(spark, sf_dir), "v")


@query(_WALK("length(v) > 6"))
def inherited_box(spark, sf_dir):
    return R.nearest_ancestor(_tree(spark, sf_dir), "v", F.length("v") > 6)


_CASCADE = """i AS (SELECT d.source AS doc_id, d.doc_id AS page, d.text AS native, NULL::VARCHAR AS ocr_text, CASE WHEN quality IS NOT NULL THEN 'drawn ' || d.doc_id END AS rendered_text,
    coalesce(l.quality, 0) = 1 AS has_form, coalesce(l.toxic, 0) = 1 AS has_vector
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'read', item_id, ' ' || chr(10) || chr(9), text, NULL, false, length(text) % 2 = 1 FROM benchmark
  UNION ALL SELECT 'drawn', item_id, NULL, '', text, length(text) % 2 = 1, false FROM benchmark)"""


def _cascade_sql(mode: str, least: int) -> str:
    may = {"Auto": "(has_form OR has_vector)", "Always": "true", "Never": "false"}[mode]
    seen = _SEEN("coalesce(native, '')")
    return f"""WITH {_CASCADE}, r AS (SELECT *, {seen} >= {least} AS enough, coalesce(ocr_text, '') AS o, coalesce(rendered_text, '') AS dr FROM i)
SELECT doc_id, page, CASE WHEN enough AND {str(mode == 'Always').lower()} AND dr <> '' THEN dr WHEN enough THEN native WHEN o <> '' THEN o WHEN {may} AND dr <> '' THEN dr ELSE '' END AS text,
  CASE WHEN enough AND {str(mode == 'Always').lower()} AND dr <> '' THEN 'Rendered' WHEN enough THEN 'Native' WHEN o <> '' THEN 'Ocr' WHEN {may} AND dr <> '' THEN 'Rendered' ELSE 'Ocr' END AS source FROM r"""


@query(_cascade_sql("Auto", 1))
def ocr_cascade(spark, sf_dir):
    return C.cascade(X.cascade_inputs(spark, sf_dir), "Auto", 1)


@query(_cascade_sql("Always", 400))
def ocr_cascade_always(spark, sf_dir):
    return C.cascade(X.cascade_inputs(spark, sf_dir), "Always", 400)


@query(_cascade_sql("Never", 400))
def ocr_cascade_never(spark, sf_dir):
    return C.cascade(X.cascade_inputs(spark, sf_dir), "Never", 400)


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn // 4 + 1 AS BIGINT) AS page, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text <> '' GROUP BY ALL")
def ocr_concat(spark, sf_dir):
    c = X.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.floor(F.col("turn") / 4) + 1).cast("long").alias("page"), F.col("turn").alias("image_index"), "text")
    return R.join_texts(c)


@query(f"WITH {_CASCADE} SELECT doc_id, page FROM i WHERE {_SEEN("coalesce(native, '')")} = 0 AND NOT has_form")
def render_auto(spark, sf_dir):
    pages = X.cascade_inputs(spark, sf_dir).select("doc_id", "page", F.coalesce("native", F.lit("")).alias("text"), "has_form")
    images = pages.where("has_form")
    return R.needs_render(pages, images).select("doc_id", "page")


@query("""WITH o AS (SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 're' WHEN 'view' THEN 'Tj' WHEN 'purchase' THEN 'f*' ELSE event_type END AS op FROM events)
SELECT doc_id, count(*) FILTER (op IN ('m','l','c','v','y','h','re','S','s','f','F','f*','B','B*','b','b*','n','W','W*')) > 10 AS has_vector FROM o GROUP BY doc_id""")
def vector_pages(spark, sf_dir):
    op = F.col("event_type")
    op = F.when(op == "click", "re").when(op == "view", "Tj").when(op == "purchase", "f*").otherwise(op)
    return X.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(G.has_vector_content(op).alias("has_vector"))


_SPACES = ("DeviceRGB", "DeviceGray", "DeviceCMYK", "ICCBased1", "ICCBased4", "Indexed", "CalGray")


@query(f"""WITH s AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS width, CAST(p_size * 3 AS BIGINT) AS height, (['{"', '".join(_SPACES)}'])[CAST(p_partkey % 7 + 1 AS BIGINT)] AS color_space, CASE WHEN p_partkey % 4 = 0 THEN 16 ELSE 8 END AS bits FROM part)
SELECT p_partkey, color_space, CAST(width * height * CASE WHEN color_space IN ('DeviceGray','ICCBased1','CalGray') THEN 1 WHEN color_space IN ('DeviceCMYK','ICCBased4') THEN 4 ELSE 3 END * (bits // 8) AS BIGINT) AS expected FROM s""")
def image_expected_bytes(spark, sf_dir):
    p = X.read(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*[F.lit(s) for s in _SPACES]), (F.col("p_partkey") % 7).cast("int")).alias("color_space"))
    return p.select("p_partkey", "color_space", G.expected_bytes(F.col("p_size"), F.col("p_size") * 3, F.col("color_space"), F.when(F.col("p_partkey") % 4 == 0, 16).otherwise(8)).alias("expected"))


@query("""WITH s AS (SELECT p_partkey, CAST(p_size * 24 AS FLOAT) AS points, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 900 AS INTEGER) END AS asked FROM part),
t AS (SELECT *, least(greatest(coalesce(asked, 300), 72), 600) AS dpi FROM s)
SELECT p_partkey, CAST(dpi AS BIGINT) AS dpi, CAST(trunc(CAST(CAST(points * CAST(dpi AS FLOAT) AS FLOAT) / CAST(72 AS FLOAT) AS FLOAT)) AS BIGINT) AS width FROM t""")
def render_size(spark, sf_dir):
    p = X.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 24).alias("points"), G.normalise_dpi(F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 900).cast("int"))).alias("dpi"))
    return p.select("p_partkey", "dpi", G.pixels(F.col("points"), F.col("dpi")).alias("width"))


_PAYLOAD = f"""{_ANNOTS},
tx AS (SELECT CAST(page_id // 10 AS VARCHAR) AS doc_id, CAST(page_id % 10 + 1 AS BIGINT) AS page, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS text FROM pages),
im0 AS (SELECT doc_id, page, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS l FROM t),
im AS (SELECT doc_id, page, list_transform(l, lambda x: 'data:image/png;base64,' || base64(encode(x))) AS images, len(l) AS n_images FROM im0 WHERE len(l) > 0),
ln AS (SELECT doc_id, page, list(uri ORDER BY uri) AS links FROM a WHERE uri IS NOT NULL GROUP BY doc_id, page)"""


@query(f"WITH {_PAYLOAD} SELECT tx.doc_id, tx.page, text, coalesce(images, []::VARCHAR[]) AS images, coalesce(links, []::VARCHAR[]) AS links FROM tx LEFT JOIN im ON tx.doc_id = im.doc_id AND tx.page = im.page LEFT JOIN ln ON tx.doc_id = ln.doc_id AND tx.page = ln.page")
def page_payload(spark, sf_dir):
    return R.page_payload(X.web_pages(spark, sf_dir), X.web_images(spark, sf_dir), X.annotations(spark, sf_dir))


@query(f"""WITH {_PAYLOAD},
p1 AS (SELECT doc_id, count(*) AS page_count FROM tx GROUP BY doc_id),
i1 AS (SELECT doc_id, CAST(sum(n_images) AS BIGINT) AS total_images, list_sort(list(DISTINCT page)) AS image_pages FROM im GROUP BY doc_id),
a1 AS (SELECT doc_id, count(*) AS total_annotations, list_sort(list(DISTINCT page)) AS annotation_pages FROM a GROUP BY doc_id)
SELECT p1.doc_id, page_count, coalesce(total_images, 0) AS total_images, coalesce(total_annotations, 0) AS total_annotations, coalesce(image_pages, []::BIGINT[]) AS image_pages, coalesce(annotation_pages, []::BIGINT[]) AS annotation_pages
FROM p1 LEFT JOIN i1 ON p1.doc_id = i1.doc_id LEFT JOIN a1 ON p1.doc_id = a1.doc_id""")
def document_summary(spark, sf_dir):
    count = lambda df, n, pages: df.groupBy("doc_id").agg(F.count("*").alias(n), F.sort_array(F.collect_set("page")).alias(pages))
    p = X.web_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("page_count"))
    j = p.join(count(X.web_images(spark, sf_dir), "total_images", "image_pages"), "doc_id", "left").join(count(X.annotations(spark, sf_dir), "total_annotations", "annotation_pages"), "doc_id", "left")
    none = F.array().cast("array<long>")
    return j.select("doc_id", "page_count", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total_images", "total_annotations")], *[F.coalesce(c, none).alias(c) for c in ("image_pages", "annotation_pages")])


@query("""WITH RECURSIVE ob AS (
  SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 64 <> 0 THEN 'o' || (o_orderkey - 1) ELSE 'c' || o_custkey END AS ref, NULL::VARCHAR AS name FROM orders
  UNION ALL SELECT 'c' || c_custkey, CASE c_custkey % 50 WHEN 1 THEN 'c' || (c_custkey + 1) WHEN 2 THEN 'c' || (c_custkey - 1) WHEN 3 THEN 'n99' ELSE 'n' || c_nationkey END, NULL FROM customer
  UNION ALL SELECT 'n' || n_nationkey, NULL, n_name FROM nation),
w AS (SELECT id, ref, name, 0 AS hops FROM ob UNION ALL SELECT w.id, ob.ref, ob.name, hops + 1 FROM w JOIN ob ON w.ref = ob.id WHERE hops < 100),
f AS (SELECT id, name, hops FROM w WHERE ref IS NULL),
r AS (SELECT 'e' || event_id AS source, 'c' || CAST(props::JSON->>'k' AS BIGINT) AS id FROM events UNION ALL SELECT 'o' || o_orderkey, 'o' || o_orderkey FROM orders)
SELECT source, r.id, CAST(hops AS BIGINT) AS hops, name FROM r LEFT JOIN f ON r.id = f.id""")
def reference_chains(spark, sf_dir):
    refs, objects = X.objects(spark, sf_dir)
    return dereference(cut(refs), objects).select("source", "id", "hops", F.try_variant_get("value", "$.name", "string").alias("name"))


_ORDER_TREE = """WITH RECURSIVE o AS (SELECT o_orderpriority AS doc_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS id, o_custkey % 7 AS place FROM orders),
t AS (SELECT *, CASE WHEN id = 0 THEN NULL WHEN id % 4 = 1 OR (doc_id = '5-LOW' AND id % 2 = 1) THEN id - 1 WHEN doc_id = '5-LOW' THEN id - 2 ELSE id // 2 END AS parent FROM o),
w AS (SELECT doc_id, id, [place, id] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.id, w.path || [t.place, t.id] FROM w JOIN t ON t.doc_id = w.doc_id AND t.parent = w.id)"""


@query(_ORDER_TREE + """
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS page FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.parent = w.id)""")
def tree_pages(spark, sf_dir):
    return enumerate_nodes(X.order_trees(spark, sf_dir))


@query(_ORDER_TREE + " SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS page FROM w")
def tree_reading_order(spark, sf_dir):
    return enumerate_nodes(X.order_trees(spark, sf_dir), leaves_only=False)


@query("""WITH r AS (SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 7 - 100 AS delta FROM lineitem)
SELECT l_linestatus, l_orderkey, l_linenumber, delta, CAST((sum(delta) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, delta ROWS UNBOUNDED PRECEDING) % 256 + 256) % 256 AS BIGINT) AS decoded FROM r""")
def predictor_rows(spark, sf_dir):
    rows = recurrence(X.coded_rows(spark, sf_dir), ["l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delta"], "delta")
    return rows.select("l_linestatus", "l_orderkey", "l_linenumber", "delta", "decoded")


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n,
CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_large FROM events""")
def event_numbers(spark, sf_dir):
    one = F.lit(1).cast("long")
    e = running(X.read(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], {"place": one, "n_large": F.when(F.col("value") > 20, one)}, {"n": one})
    return e.select("event_type", "event_id", (F.col("place") - 1).alias("place"), "n", "n_large")


_LONG = """r AS (SELECT l_returnflag AS doc_id, l_orderkey % 40 AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page FROM lineitem),
g AS (SELECT doc_id, page, CASE WHEN k < 5 THEN 842.0::DOUBLE WHEN k < 9 THEN 612 WHEN k = 9 THEN 0 ELSE 595 END AS width, CASE WHEN k < 5 THEN 595.0::DOUBLE WHEN k < 9 THEN 792 WHEN k = 9 THEN 0 ELSE 842 END AS height,
  CASE WHEN k < 9 THEN 'CropBox' WHEN k = 9 THEN 'Unknown' ELSE 'MediaBox' END AS box_type FROM r),
b AS (SELECT doc_id, width, height, box_type, row_number() OVER (PARTITION BY doc_id ORDER BY min(page)) AS box_index, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page) DESC) = 1 AS dominant FROM g GROUP BY doc_id, width, height, box_type),
i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, box_type, width ORDER BY page) AS run FROM g)"""


@query(f"""WITH {_LONG} SELECT i.doc_id, box_index, i.width, i.height, i.box_type, dominant, min(page) AS "first", max(page) AS "last" FROM i JOIN b ON i.doc_id = b.doc_id AND i.box_type = b.box_type AND i.width = b.width
GROUP BY i.doc_id, box_index, i.width, i.height, i.box_type, dominant, run""")
def box_ranges(spark, sf_dir):
    return B.box_ranges(B.page_geometry(X.long_documents(spark, sf_dir))).select("doc_id", "box_index", "width", "height", "box_type", "dominant", "first", "last")


@query(f"WITH {_LONG} SELECT doc_id, page, width, height, box_type FROM g")
def expand_ranges(spark, sf_dir):
    return B.expand_ranges(B.box_ranges(B.page_geometry(X.long_documents(spark, sf_dir)))).select("doc_id", "page", "width", "height", "box_type")


@query(f"WITH {_ANNOTS}, d AS (SELECT DISTINCT doc_id, subtype, page FROM a) SELECT doc_id, count(DISTINCT page) AS n_pages, count(DISTINCT page) FILTER (subtype = 'GoTo') AS n_goto FROM d GROUP BY doc_id")
def page_sets(spark, sf_dir):
    fine = cut(S.page_bitmaps(X.annotations(spark, sf_dir), ["doc_id", "subtype"]))
    every = S.pages_counted(S.merged_bitmaps(fine, ["doc_id"]), ["doc_id"])
    return every.join(S.pages_counted(fine.where("subtype = 'GoTo'"), ["doc_id"], "n_goto"), "doc_id", "left").select("doc_id", "n_pages", F.coalesce("n_goto", F.lit(0).cast("long")).alias("n_goto"))


@query(f"""WITH {_ANNOTS}, n AS (SELECT 'u' || (user_id % 3) AS doc_id, 1 AS page, event_type AS subtype, event_id AS annotation_index FROM events
  UNION ALL SELECT doc_id, page, subtype, length(coalesce(dest, uri)) FROM a)
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(annotation_index AS BIGINT) AS annotation_index, subtype, row_number() OVER (ORDER BY doc_id, page, annotation_index, subtype) - 1 AS place FROM n""")
def sorted_annotations(spark, sf_dir):
    path = removed_at_end(spark, f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}")
    write_sorted(X.ordered_annotations(spark, sf_dir), path, ["doc_id", "page", "annotation_index", "subtype"])
    return read_sorted(spark, path).select("doc_id", "page", "annotation_index", "subtype", "place")


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, CAST(count(*) OVER (PARTITION BY conv_id) AS VARCHAR) AS n FROM conversations),
t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page, n, string_split(CASE turn % 3 WHEN 0 THEN text || chr(10) || ' / ' || chr(10) || n WHEN 1 THEN '/' || chr(10) || n || chr(10) || '/' || chr(10) || text || chr(10) || '/' ELSE text END, chr(10)) AS l FROM c),
u AS (SELECT doc_id, page, n, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM t),
k AS (SELECT *, {_TRIM('line')} AS b, lead({_TRIM('line')}) OVER w AS after, lag({_TRIM('line')}) OVER w AS before FROM u WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos))
SELECT doc_id, page, pos, line FROM k WHERE NOT coalesce(b = '/' AND after = n, false) AND NOT coalesce(before = '/' AND b = n, false)""")
def artifact_lines(spark, sf_dir):
    register_table_functions(spark)
    X.conversation_lines(spark, sf_dir).createOrReplaceTempView("_lines")
    return spark.sql("SELECT doc_id, page, pos, line FROM strip_artifacts(TABLE(_lines) PARTITION BY (doc_id, page) ORDER BY pos)")


@query("""WITH p AS (SELECT source AS doc_id, doc_id AS page, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, page, unnest(range(0, greatest(length(text), 1), 4096)) AS piece, text FROM p),
s AS (SELECT doc_id, page, piece, substring(text, piece + 1, 4096) AS text FROM c),
k AS (SELECT *, CAST(floor((sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY page, piece ROWS UNBOUNDED PRECEDING) - strlen(text)) / 4096) AS BIGINT) AS chunk FROM s)
SELECT doc_id, chunk, min(page) AS first_page, max(page) AS last_page, string_agg(text, '' ORDER BY page, piece) AS text FROM k GROUP BY doc_id, chunk""")
def document_chunks(spark, sf_dir):
    return chunks(X.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"), limit=4096)


@query(f"WITH {_PAYLOAD} SELECT tx.doc_id, tx.page, text, coalesce(images, []::VARCHAR[]) AS images, coalesce(links, []::VARCHAR[]) AS links FROM tx LEFT JOIN im ON tx.doc_id = im.doc_id AND tx.page = im.page LEFT JOIN ln ON tx.doc_id = ln.doc_id AND tx.page = ln.page")
def page_payload_bucketed(spark, sf_dir):
    relations = {"text": X.web_pages(spark, sf_dir), "images": X.web_images(spark, sf_dir), "links": X.annotations(spark, sf_dir)}
    folder = removed_at_end(spark, f"{shared_folder(spark)}/bucketed-{uuid.uuid4().hex}")
    t = load_bucketed(spark, save_bucketed(relations, f"payload_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), folder=folder))
    return R.page_payload(t["text"], t["images"], t["links"])
