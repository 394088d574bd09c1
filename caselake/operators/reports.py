"""Material reports in HTML: cells, totals and breakdown; and rings of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.plans.relation import FORMS, Relations

#: Folded row labels of the breakdown and the element that each stands for.
ELEMENTS = {"pilares": "columns", "vigas": "beams", "lajes": "slabs", "fundacoes": "foundations", "outros": "other", "totais": "total"}
#: Folded column labels and the quantity that each stands for.
QUANTITIES = {"aco": "steel", "concreto": "concrete", "forma": "formwork", "fck": "fck"}


def html_cells(html: DataFrame) -> DataFrame:
    """(doc_id, tbl, row_no, cell_no, text), all numbered from 0; a table inside a table ends the outer one.

    Documents that are null or hold no table give no rows. ``html`` has (doc_id, html).
    """
    html = html.select("doc_id", "html").repartition("doc_id")  # small tables of large reports come in few parts
    tables = html.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("tbl", "t"))
    rows = tables.select("doc_id", "tbl", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "r"))
    cells = rows.select("doc_id", "tbl", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b.*?</t[dh]>"), F.lit(0))).alias("cell_no", "c"))
    text = F.trim(F.regexp_replace("c", "<[^>]*>", ""))
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return cells.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("tbl", "row_no", "cell_no")), text.alias("text"))


def _number(s: str) -> str:
    return f"@double(CASE WHEN position(',' IN {s}) > 0 AND position('.' IN {s}) > 0 THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '.') END)"


def breakdown_cells(rv1_html_cells: DataFrame) -> DataFrame:
    """The relation of this name, by windows over a document; Spark takes tables for small by the file they come from and would send their cells to all tasks to join them."""
    inside, whole = Window.partitionBy("doc_id", "tbl"), Window.partitionBy("doc_id")
    cells = rv1_html_cells.where("doc_id IS NOT NULL").withColumn("label", F.expr(FORMS["fold"][0].format("text")))
    cells = cells.withColumns({
        "_whole": F.size(F.collect_set(F.when(F.col("label").isin("pilares", "aco", "concreto", "forma"), F.col("label"))).over(inside)),
        "_named": F.count(F.when(F.col("label") == "resumo de materiais", 1)).over(inside),
    })
    first = lambda held: F.min(F.when(held, F.col("tbl"))).over(whole)
    cells = cells.withColumn("_tbl", F.coalesce(first(F.col("_whole") == 4), first(F.col("_named") > 0)))
    return cells.where("tbl = _tbl").select("doc_id", "row_no", "cell_no", "text", "label")


def report_breakdown(breakdown_cells: DataFrame) -> DataFrame:
    """The relation ``rv3_report_breakdown`` without its joins: a row is a struct, and its head the greatest one with steel and concrete above it."""
    number = FORMS["double"][0].format(_number("text").removeprefix("@double(").removesuffix(")"))
    at = {f"{v}_at": F.min(F.when(F.col("label") == k, F.col("cell_no"))) for k, v in QUANTITIES.items()}
    rows = breakdown_cells.groupBy("doc_id", "row_no").agg(
        F.max(F.when(F.col("cell_no") == 0, F.col("label"))).alias("name"), F.collect_list(F.struct("cell_no", F.expr(number).alias("number"))).alias("cells"), *[c.alias(n) for n, c in at.items()])
    is_head = F.col("steel_at").isNotNull() & F.col("concrete_at").isNotNull()
    above = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.max(F.when(is_head, F.struct("row_no", *at))).over(above))
    element = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in ELEMENTS.items()])
    rows = rows.where(F.col("head").isNotNull() & ~is_head).withColumn("element", element).where("element IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("doc_id", "element").orderBy(F.col("row_no").desc()))
    values = [F.expr(f"array_max(transform(filter(cells, c -> c.cell_no = head.{v}_at), c -> c.number))").alias(v) for v in QUANTITIES.values()]
    return rows.withColumn("_k", last).where("_k = 1").select("doc_id", "element", *values)


def define(r: Relations) -> None:
    row = lambda kind, *cells: "'<tr>' || " + " || ".join(f"'<{kind}>' || {c} || '</{kind}>'" for c in cells) + " || '</tr>'"
    steel, concrete = "'1.' || CAST(100 + p_size AS STRING) || ',5'", "CAST(p_size AS STRING) || ',25'"

    def table(*order: str) -> str:
        head = {"s": "'Aço'", "c": "'Concreto'"}
        value = {"s": steel, "c": concrete}
        body = [row("th", "'Elemento'", *(head[k] for k in order)), row("td", "'Pilares'", *(value[k] for k in order)), row("td", "'Vigas'", *(value[k] if k == "c" else "'-'" for k in order))]
        return " || ".join(["'<p>x</p><TABLE border=1>'", row("td", "'<b>Resumo de  Materiais</b>'"), *body, "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE " + row("td", "'Totais (geral)'", *(value[k] for k in order)) + " END", "'</TABLE>'"])

    # One report in three has a whole table of six elements besides.
    sizes = lambda k: ("'25'", f"CAST(p_size + {k} AS STRING) || ',5'", f"CASE WHEN p_size % 4 = {k % 4} THEN '-' ELSE CAST({k} * p_size AS STRING) END", "'' || CAST(p_size AS STRING)")
    whole = " || ".join(["'<table>'", row("th", "'Elemento'", "'fck'", "'Aço'", "'Concreto'", "'Fôrma'"), *[row("td", f"'{e}'", *sizes(k)) for k, e in enumerate(("Pilares", "Vigas", "Lajes", "Fundações", "Outros", "Totais"))], "'</table>'"])
    r.add("report_html", f"SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 = 0 THEN '<table><tr><td>outro</td></tr></table>' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN {table('s', 'c')} ELSE {table('c', 's')} END || CASE WHEN p_partkey % 3 = 0 THEN {whole} ELSE '' END AS html FROM {{part}}")
    each = lambda source, keep, column, pattern, at, out: f"SELECT {keep}, CAST(unnest(generate_series(0, len({column}) - 1)) AS BIGINT) AS {at}, unnest({column}) AS {out} FROM (SELECT {keep}, regexp_extract_all({source[1]}, '{pattern}') AS {column} FROM {source[0]})"
    tables = each(("{report_html}", "html"), "doc_id", "ts", "(?is)<table\\b.*?</table>", "tbl", "t")
    rows = each((f"({tables})", "t"), "doc_id, tbl", "rs", "(?is)<tr\\b.*?</tr>", "row_no", "r")
    cells = each((f"({rows})", "r"), "doc_id, tbl, row_no", "cs", "(?is)<t[dh]\\b.*?</t[dh]>", "cell_no", "c")
    r.add("rv1_html_cells", f"SELECT doc_id, tbl, row_no, cell_no, replace(replace(replace(replace(trim(regexp_replace(c, '<[^>]*>', '', 'g')), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM ({cells})", lambda report_html: html_cells(report_html))
    r.add("report_labels", """
SELECT c.doc_id, row_no, cell_no, text, @fold(text) AS label FROM {rv1_html_cells} c
JOIN (SELECT doc_id, min(tbl) AS tbl FROM {rv1_html_cells} WHERE @fold(text) = 'resumo de materiais' GROUP BY doc_id) t ON c.doc_id = t.doc_id AND c.tbl = t.tbl""")
    r.add("report_heads", "SELECT doc_id, max_by(CASE WHEN label = 'aco' THEN cell_no END, CASE WHEN label = 'aco' THEN row_no END) AS steel_at, max_by(CASE WHEN label = 'concreto' THEN cell_no END, CASE WHEN label = 'concreto' THEN row_no END) AS concrete_at FROM {report_labels} GROUP BY doc_id")
    pick = f"max(CASE WHEN cell_no = steel_at THEN {_number('text')} END) AS steel, max(CASE WHEN cell_no = concrete_at THEN {_number('text')} END) AS concrete"
    r.add("rv2_report_totals", f"""
SELECT d.doc_id, steel, concrete FROM {{report_html}} d LEFT JOIN (SELECT l.doc_id, {pick} FROM {{report_labels}} l JOIN {{report_heads}} h ON l.doc_id = h.doc_id
  JOIN (SELECT doc_id, max(row_no) AS last_row FROM {{report_labels}} WHERE cell_no = 0 AND label LIKE 'totais%' GROUP BY doc_id) t ON l.doc_id = t.doc_id AND l.row_no = t.last_row GROUP BY l.doc_id) v ON d.doc_id = v.doc_id""")
    # The breakdown reads the first table with columns, steel, concrete and formwork, or else that of the totals; a row goes by the last head above it, and of
    # two rows of one element the later counts.
    r.add("breakdown_cells", """
SELECT c.doc_id, row_no, cell_no, text, @fold(text) AS label FROM {rv1_html_cells} c JOIN (
  SELECT doc_id, coalesce(min(CASE WHEN whole = 4 THEN tbl END), min(CASE WHEN named > 0 THEN tbl END)) AS tbl FROM (
    SELECT doc_id, tbl, count(DISTINCT CASE WHEN l IN ('pilares', 'aco', 'concreto', 'forma') THEN l END) AS whole, count(CASE WHEN l = 'resumo de materiais' THEN 1 END) AS named
    FROM (SELECT doc_id, tbl, @fold(text) AS l FROM {rv1_html_cells}) GROUP BY doc_id, tbl) GROUP BY doc_id) t ON c.doc_id = t.doc_id AND c.tbl = t.tbl""", breakdown_cells)
    at = ", ".join(f"min(CASE WHEN label = '{k}' THEN cell_no END) AS {v}_at" for k, v in QUANTITIES.items())
    r.add("breakdown_rows", f"""
SELECT *, max(CASE WHEN steel_at IS NOT NULL AND concrete_at IS NOT NULL THEN row_no END) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head_row
FROM (SELECT doc_id, row_no, max(CASE WHEN cell_no = 0 THEN label END) AS name, {at} FROM {{breakdown_cells}} GROUP BY doc_id, row_no)""")
    names = ", ".join(f"('{k}', '{v}')" for k, v in ELEMENTS.items())
    values = ", ".join(f"max(CASE WHEN cell_no = h.{v}_at THEN {_number('text')} END) AS {v}" for v in QUANTITIES.values())
    r.add("rv3_report_breakdown", f"""
SELECT b.doc_id, b.element, {values} FROM (
  SELECT doc_id, element, row_no, head_row, row_number() OVER (PARTITION BY doc_id, element ORDER BY row_no DESC) AS k FROM {{breakdown_rows}} r JOIN (SELECT * FROM (VALUES {names}) AS v(label, element)) m ON r.name = m.label
  WHERE head_row IS NOT NULL AND (steel_at IS NULL OR concrete_at IS NULL)) b
JOIN {{breakdown_rows}} h ON b.doc_id = h.doc_id AND b.head_row = h.row_no JOIN {{breakdown_cells}} c ON b.doc_id = c.doc_id AND b.row_no = c.row_no WHERE k = 1 GROUP BY b.doc_id, b.element""", lambda breakdown_rows, breakdown_cells: report_breakdown(breakdown_cells))
    # Rings: one row per vertex; the edge leaving each vertex closes at the first.
    r.add("ring_points", """
SELECT case_id, seg_idx, corner, CASE WHEN corner IN (0, 3) THEN rx0 ELSE rx1 END AS px, CASE WHEN corner IN (0, 1) THEN ry0 ELSE ry1 END AS py
FROM {fn4_rectangles} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(corner)) c""")
    r.add("ring_edges", """
SELECT case_id, seg_idx, corner, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy FROM {ring_points} WINDOW w AS (PARTITION BY case_id, seg_idx ORDER BY corner)""")
    r.add("fn6_signed_area", "SELECT case_id, seg_idx, round(sum(px * qy - qx * py) / 2, 4) AS signed_area, CASE WHEN sum(px * qy - qx * py) >= 0 THEN 'ccw' ELSE 'cw' END AS turn FROM {ring_edges} GROUP BY case_id, seg_idx")
    r.add("fn7_ring_inertia", """
SELECT case_id, seg_idx, CASE WHEN a = 0 THEN 0.0E0 ELSE round(abs(ixx / 12 - sy * sy / (18 * a)), 3) END AS ixx, CASE WHEN a = 0 THEN 0.0E0 ELSE round(abs(iyy / 12 - sx * sx / (18 * a)), 3) END AS iyy FROM (
  SELECT case_id, seg_idx, sum(k) AS a, sum((px + qx) * k) AS sx, sum((py + qy) * k) AS sy, sum((py * py + py * qy + qy * qy) * k) AS ixx, sum((px * px + px * qx + qx * qx) * k) AS iyy
  FROM (SELECT *, px * qy - qx * py AS k FROM {ring_edges}) GROUP BY case_id, seg_idx)""")
