"""All registered queries of the image engine, each with SQL for DuckDB.

Every query runs over whole driver tables, or tables derived from them
(``derived``). Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import ladder as L
from ..operators import palette as K
from ..operators import state as S
from ..operators import stats as A
from ..operators import stencil as W
from ..operators import udx
from ..sources import files
from ..sources.folders import new_folder, settled
from ..streaming import streams as ST
from .derived import duck, files_of, rasters_of, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Colours of a palette and cuts to make, in the registered queries.
COLORS = 8


def query(name: str, sql: str | None = None, tables: str = "", round_: tuple[str, ...] = ()):
    """Register a function of (tables by name) with its SQL over the same derived tables."""

    def keep(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            found = f(lambda t: rasters_of(spark, sf_dir) if t == "rasters" else table(spark, sf_dir, t), spark)
            return found.withColumns({c: F.round(c, 6) for c in round_}) if round_ else found

        QUERIES[name] = run
        if sql is not None:
            head = duck(*tables.split()) if tables else ""
            body = sql.strip()
            ORACLE_SQL[name] = head.rstrip() + ", " + body[5:] if head and body.startswith("WITH ") else head + body
        return f

    return keep


_SAVED = "CASE WHEN original_size > 0 THEN (original_size - compressed_size) / CAST(original_size AS DOUBLE) * 100 ELSE 0.0 END"
_HALF = "CAST(floor({} + 0.5) AS BIGINT)"


def _half(x: str) -> str:
    return _HALF.format(x)


# --- projections -----------------------------------------------------------------


@query("p1_savings", f"SELECT id, round({_SAVED}, 6) AS savings, round(greatest({_SAVED}, 0.0), 6) AS savings_shown FROM outcomes", "outcomes", ("savings", "savings_shown"))
def _p1(t, spark):
    return P.with_savings(t("outcomes")).select("id", "savings", "savings_shown")


@query("p2_status", f"SELECT id, CASE WHEN raw_status = 'error' THEN 'error' WHEN {_SAVED} < 2 OR compressed_size >= original_size THEN 'already-optimized' ELSE 'completed' END AS status FROM outcomes", "outcomes")
def _p2(t, spark):
    return P.with_status(t("outcomes")).select("id", "status")


@query("p3_quality_score", f"SELECT id, round(greatest(60.0, least(100.0, 100 - ({_SAVED}) * 0.2)), 6) AS quality_score FROM outcomes", "outcomes", ("quality_score",))
def _p3(t, spark):
    return P.with_quality_score(t("outcomes")).select("id", "quality_score")


@query("p4_human_bytes", """SELECT id, CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s < 1048576 THEN printf('%.1f KB', floor(s / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(s / 1048576.0::DOUBLE * 100 + 0.5) / 100) END AS shown
FROM (SELECT id, original_size * (1 + id % 3 * 400) AS s FROM outcomes)""", "outcomes")  # fmt: skip
def _p4(t, spark):
    return t("outcomes").select("id", P.human_bytes(F.col("original_size") * (1 + F.col("id") % 3 * 400)).alias("shown"))


@query("p5_output_name", r"SELECT id, 'optimized-' || regexp_replace(name, '\.[^/.]+$', '') || '.' || CASE format WHEN 'jpeg' THEN 'jpg' ELSE format END AS file_name FROM outcomes", "outcomes")
def _p5(t, spark):
    return t("outcomes").select("id", P.output_name(F.col("name"), F.col("format")).alias("file_name"))


_NORM = """CASE WHEN raw = 'jpg' THEN 'jpeg' WHEN raw = 'svg+xml' THEN 'svg' WHEN raw = 'tif' THEN 'tiff'
 WHEN raw IN ('png','jpeg','webp','avif','heic','heif','svg','gif','tiff','bmp','jxl') THEN raw ELSE 'png' END"""
_RAW = "CASE WHEN mime LIKE 'image/%' THEN substr(lower(mime), 7) ELSE lower(regexp_extract(name, '[^.]*$')) END AS raw"


@query("p6_normalise_format", f"SELECT id, {_NORM} AS source_format FROM (SELECT id, {_RAW} FROM jobs)", "jobs")
def _p6(t, spark):
    return t("jobs").select("id", P.normalise_format(F.col("mime"), F.col("name")).alias("source_format"))


@query("p8_fit_dimensions", f"""WITH f AS (SELECT id, width, height, ['contain','inside','cover','outside','fill'][id % 5 + 1] AS fit,
   CASE WHEN id % 6 = 0 THEN NULL ELSE 400 + id % 900 END AS tw0, 300 + id % 700 AS th FROM jobs),
 s AS (SELECT *, coalesce(tw0, width) AS tw FROM f),
 q AS (SELECT *, CASE WHEN fit IN ('cover','outside') THEN greatest(tw / CAST(width AS DOUBLE), th / CAST(height AS DOUBLE)) ELSE least(tw / CAST(width AS DOUBLE), th / CAST(height AS DOUBLE)) END AS sc,
   fit IN ('contain','inside') AND width <= tw AND height <= th AS fits FROM s),
 o AS (SELECT *, CASE WHEN fit = 'fill' THEN tw WHEN fits THEN width ELSE greatest(1, {_half('width * sc')}) END AS out_width,
   CASE WHEN fit = 'fill' THEN th WHEN fits THEN height ELSE greatest(1, {_half('height * sc')}) END AS out_height FROM q)
 SELECT id, out_width, out_height, CASE WHEN fit = 'cover' THEN greatest(0, out_width - tw) // 2 END AS crop_x, CASE WHEN fit = 'cover' THEN greatest(0, out_height - th) // 2 END AS crop_y,
  CASE WHEN fit = 'cover' THEN least(tw, out_width) END AS crop_w, CASE WHEN fit = 'cover' THEN least(th, out_height) END AS crop_h FROM o""", "jobs")  # fmt: skip
def _p8(t, spark):
    fit = F.element_at(F.array(*map(F.lit, ["contain", "inside", "cover", "outside", "fill"])), (F.col("id") % 5 + 1).cast("int"))
    jobs = t("jobs").withColumn("fit", fit).withColumn("target_width", F.when(F.col("id") % 6 != 0, 400 + F.col("id") % 900)).withColumn("target_height", 300 + F.col("id") % 700)
    return P.fit_dimensions(jobs).select("id", "out_width", "out_height", "crop_x", "crop_y", "crop_w", "crop_h")


_PROBE = f"""n AS (SELECT *, {_NORM} AS src FROM (SELECT *, {_RAW} FROM jobs)),
 p AS (SELECT *, src = format AND target_kb IS NULL AS probe, least(0.5, 512 / CAST(greatest(width, height) AS DOUBLE)) AS sc FROM n),
 q AS (SELECT *, CASE WHEN probe THEN greatest(1, {_half('width * sc')}) END AS probe_width, CASE WHEN probe THEN greatest(1, {_half('height * sc')}) END AS probe_height FROM p)"""


@query("p9_plan_probe", f"WITH {_PROBE} SELECT id, probe, probe_width, probe_height FROM q", "jobs")
def _p9(t, spark):
    return P.plan_probe(t("jobs")).select("id", "probe", "probe_width", "probe_height")


@query("p10_probe_verdict", f"""WITH {_PROBE}, e AS (SELECT *, CASE WHEN id % 5 <> 0 THEN probe_width * probe_height * (id % 40) / CAST(400 AS DOUBLE) END AS probe_bytes,
   original_size * (probe_width * probe_height) / CAST(width * height AS DOUBLE) AS est FROM q),
 v AS (SELECT id, probe_bytes IS NULL OR est IS NULL OR est <= 0 AS failed, greatest(0.0, (1 - probe_bytes / nullif(est, 0)) * 100) AS saved FROM e)
 SELECT id, round(CASE WHEN failed THEN 100.0 ELSE saved END, 6) AS expected_savings, CASE WHEN failed THEN false ELSE saved < 3 END AS skip FROM v""", "jobs", ("expected_savings",))  # fmt: skip
def _p10(t, spark):
    planned = P.plan_probe(t("jobs"))
    planned = planned.withColumn("probe_bytes", F.when(F.col("id") % 5 != 0, F.col("probe_width") * F.col("probe_height") * (F.col("id") % 40) / 400.0))
    return P.probe_verdict(planned).select("id", "expected_savings", "skip")


@query("p11_resolve_options", f"""SELECT id, coalesce(nullif(quality, 0), 85) AS quality, round(coalesce(CASE WHEN id % 4 <> 0 THEN id % 100 END, 0) / 100.0, 6) AS sharpen,
  round(coalesce(CASE WHEN id % 3 <> 0 THEN id % 20 END, 0) / 2.0, 6) AS blur, {_half('coalesce(CASE WHEN id % 5 <> 0 THEN id % 90 END, 10) * CAST(2.55 AS DOUBLE)')} AS trim_threshold,
  coalesce(CASE WHEN id % 2 = 0 THEN 90 END, 0) AS rotate, 'Lanczos3' AS resize_filter, coalesce(CASE WHEN id % 2 = 0 THEN 'cover' END, 'contain') AS fit,
  coalesce(CASE WHEN id % 3 = 0 THEN CAST(0 AS DOUBLE) END, 1.0) AS dithering, 6 AS avif_speed, 8 AS avif_depth FROM jobs""", "jobs", ("sharpen", "blur"))  # fmt: skip
def _p11(t, spark):
    i, none = F.col("id"), F.lit(None)
    jobs = t("jobs").withColumns({
        "sharpen": F.when(i % 4 != 0, i % 100), "blur": F.when(i % 3 != 0, i % 20), "trim_threshold": F.when(i % 5 != 0, i % 90), "rotate": F.when(i % 2 == 0, 90),
        "resize_filter": none.cast("string"), "fit": F.when(i % 2 == 0, F.lit("cover")), "dithering": F.when(i % 3 == 0, F.lit(0.0)), "avif_speed": none.cast("int"), "avif_depth": none.cast("int"),
    })
    return P.resolve_options(jobs)


_KIND = "CASE id % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'graphic' WHEN 2 THEN 'mixed' END"


@query("p7_select_format", f"SELECT id, CASE WHEN id % 6 = 0 OR coalesce({_KIND}, 'photo') = 'photo' THEN 'webp' ELSE 'png' END AS chosen_format FROM jobs", "jobs")
def _p7(t, spark):
    return P.select_format(t("jobs").withColumn("type", F.expr(_KIND)).withColumn("has_transparency", F.col("id") % 6 == 0)).select("id", "chosen_format")


@query("p12_encode_policy", f"""SELECT id, coalesce(CASE WHEN id % 9 = 0 THEN true END, CASE WHEN format = 'png' THEN CASE WHEN k IN ('photo','mixed') THEN false WHEN k = 'graphic' THEN id % 500 < 256 END END) AS effective_lossless,
  CASE WHEN format = 'jpeg' AND k = 'photo' THEN greatest(quality, 70) ELSE quality END AS effective_quality FROM (SELECT *, {_KIND} AS k FROM jobs)""", "jobs")  # fmt: skip
def _p12(t, spark):
    jobs = t("jobs").withColumn("lossless", F.when(F.col("id") % 9 == 0, F.lit(True)))
    analysis = jobs.select("id", F.expr(_KIND).alias("type"), (F.col("id") % 500).alias("unique_colors"))
    return P.encode_policy(jobs, analysis).select("id", "effective_lossless", "effective_quality")


@query("p13_admit", """WITH j AS (SELECT id, CASE WHEN id % 3 = 0 THEN 7 ELSE id // 50 END AS batch, original_size * 20000 AS size, mime IN ('image/png','image/jpeg','image/webp','image/avif','image/heic','image/heif','image/svg+xml','image/gif','image/tiff','image/bmp')
   OR lower(regexp_extract(name, '[^.]*$')) IN ('png','jpg','jpeg','webp','avif','heic','heif','svg','gif','tiff','tif','bmp') AS ok FROM jobs),
 c AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY batch) AS n FROM j)
 SELECT id FROM c WHERE n <= 100 AND size <= 52428800 AND ok""", "jobs")  # fmt: skip
def _p13(t, spark):
    jobs = t("jobs").withColumn("batch_id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.expr("id div 50"))).withColumn("size", F.col("original_size") * 20000)
    return P.admit(jobs).select("id")


_CLEAN = r"""WITH a AS (SELECT id, markup, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markup,
  '(?i)<!doctype[^>]*>', '', 'g'), '<\?xml[^>]*\?>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<metadata[^>]*>.*?</metadata>', '', 'g'),
  '\s(?:xmlns:)?(?:sodipodi|inkscape|sketch|adobe|figma|serif|i|x):[A-Za-z-]+="[^"]*"', '', 'g'), '\s[A-Za-z:-]+=""', '', 'g'), '[ \t\r\n]+', ' ', 'g') AS c FROM markup)"""


@query("p14_clean_markup", _CLEAN + " SELECT id, c AS cleaned, CAST(strlen(markup) AS BIGINT) AS original_size, CAST(strlen(c) AS BIGINT) AS cleaned_size FROM a", "markup")
def _p14(t, spark):
    return P.clean_markup(t("markup")).select("id", "cleaned", "original_size", "cleaned_size")


@query("p15_clean_markup_aggressive", _CLEAN + r""", b AS (SELECT id, string_split_regex(c, '[0-9]+\.[0-9]{3,}') AS p, regexp_extract_all(c, '[0-9]+\.[0-9]{3,}') AS n FROM a)
 SELECT id, list_aggregate(list_transform(p, lambda x, i: x || CASE WHEN i <= len(n) THEN printf('%.2f', floor(CAST(n[i] AS DOUBLE) * 100 + 0.5) / 100) ELSE '' END), 'string_agg', '') AS cleaned FROM b""", "markup")  # fmt: skip
def _p15(t, spark):
    return P.clean_markup(t("markup"), mode="aggressive").select("id", "cleaned")


# --- joins -----------------------------------------------------------------------


@query("j1_new_only", "SELECT seq, name FROM hashed h WHERE hash NOT IN (SELECT hash FROM hashed WHERE seq % 3 = 0)", "hashed")
def _j1(t, spark):
    return J.new_only(t("hashed"), t("hashed").where("seq % 3 = 0")).select("seq", "name")


@query("j2_apply_preset", """SELECT id, p AS preset, CASE p WHEN 'photo' THEN 'webp' WHEN 'graphic' THEN 'png' WHEN 'social' THEN 'jpeg' ELSE 'auto' END AS preset_format,
  CASE p WHEN 'photo' THEN 78 WHEN 'graphic' THEN 85 WHEN 'social' THEN 72 ELSE 80 END AS preset_quality, CASE p WHEN 'photo' THEN 2560 WHEN 'social' THEN 1200 END AS max_width,
  CASE p WHEN 'photo' THEN 1440 WHEN 'social' THEN 1200 END AS max_height, CASE p WHEN 'graphic' THEN 0 ELSE 1 END AS dithering, p = 'graphic' AS lossless
 FROM (SELECT id, CASE WHEN preset_id IN ('photo','graphic','social','custom') THEN preset_id ELSE 'photo' END AS p FROM jobs)""", "jobs")  # fmt: skip
def _j2(t, spark):
    return J.apply_preset(t("jobs"), J.presets(spark)).select("id", "preset", "preset_format", "preset_quality", "max_width", "max_height", "dithering", "lossless")


_CURVES = "curves(f, q, r) AS (VALUES " + ", ".join(f"('{f}', {q}, CAST({r} AS DOUBLE))" for f, rs in J.SIZE_RATIOS.items() for q, r in zip(J.QUALITIES, rs, strict=False)) + ")"


def _estimates(source: str) -> str:
    """CTEs from ``source(id, width, height, quality, format, ...)`` to ``est`` with estimated_size."""
    return f"""{_CURVES}, seg AS (SELECT f, q, r, lead(q) OVER w AS q2, lead(r) OVER w AS r2, row_number() OVER w AS n FROM curves WINDOW w AS (PARTITION BY f ORDER BY q)),
 est AS (SELECT j.*, {_half('j.width * j.height * 3 * (CASE WHEN q2 IS NULL OR quality <= q THEN r ELSE r + (quality - q) / CAST(q2 - q AS DOUBLE) * (r2 - r) END)')} AS estimated_size
  FROM {source} j JOIN seg ON f = CASE WHEN format = 'auto' THEN 'webp' WHEN format IN ('jpeg','webp','avif','png') THEN format ELSE 'jpeg' END
   AND quality < coalesce(q2, 1000000) AND (n = 1 OR quality >= q))"""


@query("j3_estimate_size", f"WITH {_estimates('jobs')} SELECT id, estimated_size FROM est", "jobs")
def _j3(t, spark):
    return J.estimate_size(t("jobs"), J.size_ratios(spark)).select("id", "estimated_size")


@query("j4_quality_ladder", f"WITH s AS (SELECT * EXCLUDE (quality), quality AS asked, unnest([100, 92, 85, 70]) AS quality FROM jobs), {_estimates('s')} SELECT id, quality, estimated_size, quality = asked AS selected FROM est", "jobs")
def _j4(t, spark):
    return J.quality_ladder(t("jobs"), J.size_ratios(spark)).select("id", "quality", "estimated_size", "selected")


@query("j5_overlap_join", "SELECT qid, id FROM boxes b JOIN query_boxes q ON q.w > 5 AND q.h > 5 AND b.x <= q.x + q.w AND b.x + b.w >= q.x AND b.y <= q.y + q.h AND b.y + b.h >= q.y", "boxes query_boxes")
def _j5(t, spark):
    return J.overlap_join(t("boxes"), t("query_boxes"))


@query("j7_resolve_blob", "SELECT id, CASE WHEN id % 4 = 0 THEN 'orig-' || id ELSE 'out-' || id END AS resolved_blob FROM outcomes", "outcomes")
def _j7(t, spark):
    out = t("outcomes").select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("out-"), "id")).alias("output_blob"))
    return J.resolve_blob(out, t("outcomes").select("id", F.concat(F.lit("orig-"), "id").alias("original_blob"))).select("id", "resolved_blob")


@query("j8_compare_runs", """SELECT id, compressed_size - original_size AS delta, round(CASE WHEN original_size > 0 THEN (original_size - compressed_size) / CAST(original_size AS DOUBLE) * 100 ELSE 0.0 END, 6) AS savings,
  round(greatest(width / CAST(height AS DOUBLE), (width // 2 + 1) / CAST(height // 2 + 1 AS DOUBLE)), 6) AS aspect FROM outcomes""", "outcomes", ("savings", "aspect"))  # fmt: skip
def _j8(t, spark):
    o = t("outcomes")
    before = o.select("id", "width", "height", F.col("original_size").alias("size"))
    after = o.select("id", F.expr("width div 2 + 1").alias("width"), F.expr("height div 2 + 1").alias("height"), F.col("compressed_size").alias("size"))
    return J.compare_runs(before, after).select("id", "delta", "savings", "aspect")


_MARK = "mark AS (SELECT x, y, r, g, b, a FROM pixels WHERE image_id = (SELECT min(image_id) FROM pixels WHERE image_id % 5 = 2) AND x < 8 AND y < 6)"


_PLACES = {"bottom-right": ("width - 8 - 10", "height - 6 - 10"), "top-left": ("10", "10"), "top-right": ("width - 8 - 10", "10"), "bottom-left": ("10", "height - 6 - 10"), "center": ("(width - 8) // 2", "(height - 6) // 2")}


def _overlay(position: str) -> None:
    left, top = _PLACES[position]
    mixed = lambda c: f"CASE WHEN m.a IS NULL THEN p.{c} ELSE {_half(f'p.{c} * (1 - m.a / 255.0::DOUBLE * 0.5::DOUBLE) + m.{c} * (m.a / 255.0::DOUBLE * 0.5::DOUBLE)')} END AS {c}"
    sql = f"WITH {_MARK} SELECT image_id, p.x, p.y, {', '.join(map(mixed, 'rgb'))} FROM pixels p LEFT JOIN mark m ON m.x = p.x - ({left}) AND m.y = p.y - ({top})"

    @query("j9_overlay" if position == "bottom-right" else f"j9_overlay_{position.replace('-', '_')}", sql, "pixels")
    def _j9(t, spark):
        p = t("pixels")
        first = p.where("image_id % 5 = 2").agg(F.min("image_id").alias("image_id"))
        mark = p.join(first, "image_id").where("x < 8 AND y < 6").withColumn("width", F.lit(8)).withColumn("height", F.lit(6))
        return J.overlay(p, mark, position).select("image_id", "x", "y", "r", "g", "b")


for _position in _PLACES:
    _overlay(_position)


# --- aggregations ----------------------------------------------------------------

_KEPT = "coalesce(nullif(compressed_size, 0), original_size)"


@query("a1_library_totals", f"""SELECT count(*) AS images, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum({_KEPT}) AS BIGINT) AS compressed, CAST(sum(original_size) - sum({_KEPT}) AS BIGINT) AS saved,
  round((sum(original_size) - sum({_KEPT})) / CAST(sum(original_size) AS DOUBLE) * 100, 6) AS percent FROM outcomes WHERE raw_status <> 'error'""", "outcomes", ("percent",))  # fmt: skip
def _a1(t, spark):
    return A.library_totals(t("outcomes"))


@query("a2_batch_summary", f"SELECT batch_id, count(*) AS images, {_half('sum(original_size) / 1024.0')} AS original_kb, {_half('sum(compressed_size) / 1024.0')} AS compressed_kb, {_half('avg(' + _SAVED + ')')} AS savings FROM outcomes WHERE raw_status <> 'error' GROUP BY batch_id", "outcomes")
def _a2(t, spark):
    return A.batch_summary(t("outcomes"))


_HIST = f"""hist AS (SELECT image_id, {_half('r * (a / CAST(255.0 AS DOUBLE))')} AS r, {_half('g * (a / CAST(255.0 AS DOUBLE))')} AS g, {_half('b * (a / CAST(255.0 AS DOUBLE))')} AS b, a, count(*) AS cnt FROM pixels GROUP BY 1, 2, 3, 4, 5)"""


@query("a4_color_histogram", f"WITH {_HIST} SELECT * FROM hist", "pixels")
def _a4(t, spark):
    return A.color_histogram(t("pixels"))


_COLORS = f"""s AS (SELECT *, width * height AS n, greatest(1, (width * height) // least(10000, width * height)) AS step FROM rasters),
 c0 AS (SELECT image_id, n, step, count(DISTINCT r * 65536 + g * 256 + b) AS raw FROM s WHERE (y * width + x) % step = 0 GROUP BY ALL),
 colors AS (SELECT image_id, CASE WHEN (n + step - 1) // step >= n THEN raw ELSE least({_half('raw * (ln(n) / ln((n + step - 1) // step))')}, n) END AS unique_colors FROM c0)"""
_CLEAR = """t0 AS (SELECT image_id, n, step, count(*) FILTER (WHERE a < 255 AND (y * width + x) % step = 0) AS hits, bool_or(a < 255) AS any_transparent FROM s GROUP BY ALL),
 clear AS (SELECT image_id, hits / CAST((n + step - 1) // step AS DOUBLE) AS transparency, any_transparent FROM t0)"""
_SOLID = """b0 AS (SELECT image_id, y // 4 AS by_, x // 4 AS bx, max(r) - min(r) + max(g) - min(g) + max(b) - min(b) AS spread FROM rasters WHERE y // 4 * 4 < height - 4 AND x // 4 * 4 < width - 4 GROUP BY ALL),
 solid AS (SELECT image_id, avg(CASE WHEN spread < 5 THEN 1.0 ELSE 0.0 END) AS solid_ratio FROM b0 GROUP BY 1)"""
_EDGES = """e0 AS (SELECT image_id, width, height, x, greatest(1, height // 100) AS st, abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS d1,
   abs(r - lead(r) OVER w) + abs(g - lead(g) OVER w) + abs(b - lead(b) OVER w) AS d2 FROM rasters WHERE y % greatest(1, height // 100) = 0 WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 e1 AS (SELECT image_id, width, height, st, count(*) FILTER (WHERE x >= 1 AND x < width - 1 AND greatest(d1, d2) > 100) AS hard, count(*) FILTER (WHERE x >= 1 AND x < width - 1 AND greatest(d1, d2) > 0 AND greatest(d1, d2) < 30) AS smooth FROM e0 GROUP BY ALL),
 edges AS (SELECT image_id, hard / CAST(greatest(1, width - 2) * greatest(1, (height + st - 1) // st) AS DOUBLE) AS edge_ratio, smooth / CAST(greatest(1, width - 2) * greatest(1, (height + st - 1) // st) AS DOUBLE) AS smooth_ratio FROM e1)"""


@query("a5_unique_colors", f"WITH {_COLORS} SELECT * FROM colors", "rasters")
def _a5(t, spark):
    return A.unique_colors(t("rasters"))


@query("a5_unique_colors_exact", "SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS unique_colors FROM rasters GROUP BY 1", "rasters")
def _a5x(t, spark):
    return A.unique_colors(t("rasters"), "exact")


@query("a5_unique_colors_approx", "SELECT image_id, true AS is_close FROM rasters GROUP BY 1", "rasters")
def _a5a(t, spark):
    near, exact = A.unique_colors(t("rasters"), "approx"), A.unique_colors(t("rasters"), "exact").withColumnRenamed("unique_colors", "exact")
    return near.join(exact, "image_id").select("image_id", (F.abs(F.col("unique_colors") - F.col("exact")) <= 0.25 * F.col("exact") + 1).alias("is_close"))


@query("a6_transparency", f"WITH {_COLORS}, {_CLEAR} SELECT image_id, round(transparency, 6) AS transparency, transparency > 0.01 AS has_transparency, transparency > 0.05 AS has_significant_transparency, any_transparent FROM clear", "rasters", ("transparency",))
def _a6(t, spark):
    return A.transparency(t("rasters"))


@query("a7_solid_ratio", f"WITH {_SOLID} SELECT image_id, round(solid_ratio, 6) AS solid_ratio FROM solid", "rasters", ("solid_ratio",))
def _a7(t, spark):
    return A.solid_ratio(t("rasters"))


@query("a8_edge_stats", f"WITH {_EDGES} SELECT image_id, round(edge_ratio, 6) AS edge_ratio, round(smooth_ratio, 6) AS smooth_ratio, edge_ratio > 0.05 AS has_hard_edges, smooth_ratio > 0.6 AS has_smooth_gradients FROM edges", "rasters", ("edge_ratio", "smooth_ratio"))
def _a8(t, spark):
    return A.edge_stats(t("rasters"))


def _classes(colors: str) -> str:
    return f"""WITH {_COLORS}, exact AS (SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS unique_colors FROM rasters GROUP BY 1), {_CLEAR}, {_SOLID}, {_EDGES}
 SELECT image_id, CASE WHEN unique_colors < 5000 OR (edge_ratio > 0.05 AND solid_ratio > 0.3) THEN 'graphic' WHEN unique_colors > 50000 AND smooth_ratio > 0.6 THEN 'photo' ELSE 'mixed' END AS type, unique_colors,
  edge_ratio > 0.05 AS has_hard_edges, smooth_ratio > 0.6 AS has_smooth_gradients, transparency > 0.01 AS has_transparency, transparency > 0.05 AS has_significant_transparency, round(solid_ratio, 6) AS solid_ratio
 FROM {colors} JOIN clear USING (image_id) JOIN solid USING (image_id) JOIN edges USING (image_id)"""


@query("a9_classify_images", _classes("colors"), "rasters", ("solid_ratio",))
def _a9(t, spark):
    return A.classify_images(t("rasters"))


@query("a9_classify_images_exact", _classes("exact"), "rasters", ("solid_ratio",))
def _a9x(t, spark):
    return A.classify_images(t("rasters"), "exact")


_BOUNDS = """w0 AS (SELECT *, (x = 0 AND y = 0)::INT + (x = width - 1 AND y = 0)::INT + (x = 0 AND y = height - 1)::INT + (x = width - 1 AND y = height - 1)::INT AS wt FROM pixels),
 back AS (SELECT image_id, sum(r * wt) // 4 AS br, sum(g * wt) // 4 AS bg, sum(b * wt) // 4 AS bb FROM w0 WHERE wt > 0 GROUP BY 1),
 box0 AS (SELECT p.image_id, width, height, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pixels p JOIN back USING (image_id) WHERE abs(r - br) > 25 OR abs(g - bg) > 25 OR abs(b - bb) > 25 GROUP BY ALL),
 bounds AS (SELECT image_id, x, y, w, h FROM box0 WHERE NOT (w = width AND h = height))"""


@query("a10_content_bounds", f"WITH {_BOUNDS} SELECT * FROM bounds", "pixels")
def _a10(t, spark):
    return A.content_bounds(t("pixels"))


def _median_cut_sql(k: int) -> str:
    """The rounds of a median cut, written out one after another."""
    parts = [_HIST, "m0 AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS colors, row_number() OVER (PARTITION BY image_id ORDER BY r, g, b, a) - 1 AS own FROM hist)",
             f"done AS MATERIALIZED (SELECT image_id, r, g, b, a, cnt, own AS box FROM m0 WHERE colors <= {k})", f"live1 AS MATERIALIZED (SELECT image_id, r, g, b, a, cnt, 0 AS box FROM m0 WHERE colors > {k})"]
    for made in range(1, k):
        score = "pop" if made < k * 0.75 else "(sr + 1) * (sg + 1) * (sb + 1) * pop"
        parts.append(f"""st{made} AS (SELECT image_id, box, count(*) AS n, sum(cnt) AS pop, max(r) - min(r) AS sr, max(g) - min(g) AS sg, max(b) - min(b) AS sb FROM live{made} GROUP BY 1, 2),
 pk{made} AS (SELECT image_id, box, n, pop, CASE WHEN sr >= sg AND sr >= sb THEN 'r' WHEN sg >= sb THEN 'g' ELSE 'b' END AS axis FROM st{made} WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {score} DESC, box) = 1),
 rk{made} AS (SELECT l.*, n, pop, row_number() OVER w - 1 AS pos, sum(cnt) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM live{made} l JOIN pk{made} USING (image_id, box)
   WINDOW w AS (PARTITION BY image_id ORDER BY CASE axis WHEN 'r' THEN r WHEN 'g' THEN g ELSE b END, r, g, b, a)),
 sp{made} AS (SELECT image_id, box, greatest(least(greatest(min(pos) FILTER (WHERE cum * 2 >= pop), 1), any_value(n) - 2), 0) AS cut FROM rk{made} GROUP BY 1, 2),
 live{made + 1} AS MATERIALIZED (SELECT l.image_id, l.r, l.g, l.b, l.a, l.cnt, CASE WHEN k.pos > s.cut THEN {made} ELSE l.box END AS box FROM live{made} l LEFT JOIN rk{made} k USING (image_id, box, r, g, b, a) LEFT JOIN sp{made} s ON s.image_id = l.image_id AND s.box = l.box)""")
    mean = ", ".join(_half(f"sum({c} * cnt) / CAST(sum(cnt) AS DOUBLE)") + f" AS {c}" for c in "rgba")
    parts.append(f"palette AS MATERIALIZED (SELECT image_id, box AS idx, {mean}, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM done UNION ALL SELECT * FROM live{k}) GROUP BY 1, 2)")
    return ", ".join(parts)


_CUT = _median_cut_sql(COLORS)
_DIST = " + ".join(f"(h.{c} - p.{c}) * (h.{c} - p.{c})" for c in "rgba")
_NEAR = f"near AS (SELECT h.image_id, h.r, h.g, h.b, h.a, h.cnt, p.idx, {_DIST} AS dist FROM hist h JOIN palette p USING (image_id) QUALIFY row_number() OVER (PARTITION BY h.image_id, h.r, h.g, h.b, h.a ORDER BY {_DIST}, p.idx) = 1)"


@query("a11_median_cut", f"WITH {_CUT} SELECT * FROM palette", "pixels")
def _a11(t, spark):
    return K.median_cut(A.color_histogram(t("pixels")), COLORS)


def _kmeans_sql(rounds: int) -> str:
    parts, prev = [_CUT], "palette"
    for i in range(rounds):
        mean = ", ".join(_half(f"sum({c} * cnt) / CAST(sum(cnt) AS DOUBLE)") + f" AS {c}" for c in "rgba")
        keep = ", ".join(f"coalesce(m.{c}, p.{c}) AS {c}" for c in "rgba")
        parts.append(f"nr{i} AS ({_NEAR.split(' AS (', 1)[1][:-1].replace('JOIN palette', f'JOIN {prev}')}), mv{i} AS (SELECT image_id, idx, {mean} FROM nr{i} GROUP BY 1, 2), pl{i} AS MATERIALIZED (SELECT p.image_id, p.idx, {keep} FROM {prev} p LEFT JOIN mv{i} m USING (image_id, idx))")
        prev = f"pl{i}"
    return "WITH " + ", ".join(parts) + f" SELECT * FROM {prev}"


@query("a12_kmeans_refine", _kmeans_sql(5), "pixels")
def _a12(t, spark):
    return K.refined_palettes(A.color_histogram(t("pixels")), COLORS)


@query("j6_nearest_color", f"WITH {_CUT}, {_NEAR} SELECT * FROM near", "pixels")
def _j6(t, spark):
    return K.nearest_of_cut(A.color_histogram(t("pixels")), COLORS)


@query("g7_remap", f"WITH {_CUT}, {_NEAR} SELECT image_id, count(DISTINCT idx) AS colors_left, round(sum(dist * cnt) / CAST(sum(cnt) AS DOUBLE), 6) AS mse FROM near GROUP BY 1", "pixels", ("mse",))
def _g7(t, spark):
    return K.remap_of_cut(A.color_histogram(t("pixels")), COLORS)


@query("a13_duplicate_report", "WITH d AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq) AS k FROM hashed) SELECT hash, count(*) AS skipped, string_agg(name, ',' ORDER BY name) AS names, CAST(sum(size) AS BIGINT) AS bytes FROM d WHERE k > 1 GROUP BY 1", "hashed")
def _a13(t, spark):
    return A.duplicate_report(S.rank_duplicates(t("hashed")))


@query("a13_duplicate_names", "SELECT hash, name, size FROM hashed QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) > 1", "hashed")
def _a13_names(t, spark):
    return A.duplicate_names(t("hashed"))


@query("a14_savings_by_format", f"""SELECT format, count(*) AS images, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum({_KEPT}) AS BIGINT) AS compressed, grouping(format)::INT AS is_total,
  round((sum(original_size) - sum({_KEPT})) / CAST(sum(original_size) AS DOUBLE) * 100, 6) AS percent FROM outcomes WHERE raw_status <> 'error' GROUP BY ROLLUP (format)""", "outcomes", ("percent",))  # fmt: skip
def _a14(t, spark):
    return A.savings_by_format(t("outcomes"))


# --- windows and neighbourhoods --------------------------------------------------


def _blur_sql(source: str, radius: int) -> str:
    one = lambda c, w: f"CASE WHEN width < 3 OR height < 3 THEN {c} ELSE sum({c}) OVER {w} // count(*) OVER {w} END AS {c}"
    return f"""bh AS (SELECT image_id, width, height, x, y, {', '.join(one(c, 'w') for c in 'rgba')} FROM {source} WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
 blurred AS (SELECT image_id, width, height, x, y, {', '.join(one(c, 'w') for c in 'rgba')} FROM bh WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING))"""


def _sharpen_sql(source: str, amount: float) -> str:
    n = lambda c: f"lag({c}) OVER wx + lead({c}) OVER wx + lag({c}) OVER wy + lead({c}) OVER wy"
    out = ", ".join(f"CASE WHEN x >= 1 AND y >= 1 AND x < width - 1 AND y < height - 1 THEN floor(greatest(0.0, least(255.0, {c} + (CAST(4.0 AS DOUBLE) * {c} - ({n(c)})) * CAST({amount} AS DOUBLE))))::BIGINT ELSE {c} END AS {c}" for c in "rgb")
    return f"sharp AS (SELECT image_id, width, height, x, y, {out}, a FROM {source} WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"


_PX = "image_id, width, height, x, y, r, g, b, a"
_INT = "SELECT image_id, width, height, x, y, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a FROM "


@query("w1_box_blur", f"WITH {_blur_sql('pixels', 3)} {_INT} blurred", "pixels")
def _w1(t, spark):
    return W.box_blur(t("pixels"), 3)


@query("w2_sharpen", f"WITH {_sharpen_sql('pixels', 0.5)} {_INT} sharp", "pixels")
def _w2(t, spark):
    return W.sharpen(t("pixels"), 0.5)


@query("w4_smooth_mask", """WITH f AS (SELECT image_id, x, y, count(*) OVER w AS n, sum(r * r + g * g + b * b) OVER w AS q, sum(r) OVER w AS r, sum(g) OVER w AS g, sum(b) OVER w AS b FROM pixels WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 s AS (SELECT image_id, x, y, sum(n) OVER w AS n, sum(q) OVER w AS q, sum(r) OVER w AS r, sum(g) OVER w AS g, sum(b) OVER w AS b FROM f WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT image_id, x, y, n * q - (r * r + g * g + b * b) < 500 * n * n AS smooth FROM s""", "pixels")  # fmt: skip
def _w4(t, spark):
    return W.smooth_mask(t("pixels"))


@query("w3_rank_duplicates", "SELECT seq, row_number() OVER (PARTITION BY hash ORDER BY seq) AS dup_rank FROM hashed", "hashed")
def _w3(t, spark):
    return S.rank_duplicates(t("hashed")).select("seq", "dup_rank")


@query("w5_pick_for_target", f"""WITH s AS (SELECT * EXCLUDE (quality), unnest([100, 92, 85, 70, 60, 50]) AS quality FROM jobs), {_estimates('s')},
 k AS (SELECT id, quality, estimated_size AS bytes, target_kb * 1024 AS t, target_kb IS NULL OR estimated_size <= target_kb * 1024 AS met FROM est
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY met DESC, CASE WHEN met THEN -quality ELSE estimated_size END, -quality) = 1)
 SELECT id, quality, bytes, met, CASE WHEN NOT met THEN 'Could not meet target size of ' || {_half('t / 1024.0')} || 'KB (best: ' || {_half('bytes / 1024.0')} || 'KB)' END AS warning FROM k""", "jobs")  # fmt: skip
def _w5(t, spark):
    steps = t("jobs").withColumn("quality", F.explode(F.array(*map(F.lit, [100, 92, 85, 70, 60, 50]))))
    trials = J.estimate_size(steps, J.size_ratios(spark)).select("id", "quality", F.col("estimated_size").alias("bytes"), (F.col("target_kb") * 1024).alias("target_bytes"))
    return L.pick_for_target(trials)




def _shrink_sql(side: str) -> str:
    out, cases = side, [f"WHEN 0 THEN {side}"]
    for i in (1, 2, 3):
        out = f"greatest(CAST(floor(({out}) * 0.75::DOUBLE + 0.5) AS BIGINT), 100)"
        cases.append(f"WHEN {i} THEN {out}")
    return f"CASE step {' '.join(cases)} END"


@query("w6_resize_fallback", f"""WITH d AS (SELECT id, format, target_kb, width AS w0, height AS h0, unnest([0, 1, 2, 3]) AS step FROM jobs WHERE target_kb IS NOT NULL),
 s AS (SELECT id, format, target_kb, step, {_shrink_sql('w0')} AS width, {_shrink_sql('h0')} AS height, unnest([100, 92, 85, 70]) AS quality FROM d), {_estimates('s')}
 SELECT id, step, width, height, quality, estimated_size AS bytes, estimated_size <= target_kb * 1024 AS met FROM est
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY met DESC, CASE WHEN met THEN step ELSE -step END, CASE WHEN met THEN -quality ELSE estimated_size END, -quality) = 1""", "jobs")  # fmt: skip
def _w6(t, spark):
    return L.resize_fallback(t("jobs"), J.size_ratios(spark))


@query("w7_size_guard", f"""WITH s AS (SELECT * EXCLUDE (quality), quality AS asked, unnest(list_distinct([quality, least(quality, 70) - 10, least(quality, 70) - 20, least(quality, 70) - 30, least(quality, 70) - 40])) AS quality FROM jobs), {_estimates('s')},
 u AS (SELECT id, quality, asked, original_size * 300 AS original_size, estimated_size AS bytes FROM est),
 k AS (SELECT id, quality, bytes FROM u WHERE bytes < original_size AND (quality = asked OR (quality < least(asked, 70) AND (least(asked, 70) - quality) % 10 = 0 AND quality + 10 >= 40)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY quality = asked DESC, quality DESC) = 1),
 o AS (SELECT DISTINCT id, original_size FROM u)
 SELECT o.id, k.quality, coalesce(k.bytes, original_size) AS bytes, k.id IS NULL AS kept_original, round(CASE WHEN k.id IS NULL OR original_size = 0 THEN 0.0 ELSE (original_size - k.bytes) / CAST(original_size AS DOUBLE) * 100 END, 6) AS savings FROM o LEFT JOIN k USING (id)""", "jobs", ("savings",))  # fmt: skip
def _w7(t, spark):
    top = F.least("asked", F.lit(70))
    steps = t("jobs").withColumn("asked", F.col("quality")).withColumn("quality", F.explode(F.array_distinct(F.array(F.col("asked"), *(top - 10 * k for k in (1, 2, 3, 4))))))
    trials = J.estimate_size(steps, J.size_ratios(spark)).select("id", "quality", "asked", F.col("estimated_size").alias("bytes"), (F.col("original_size") * 300).alias("original_size"))
    return L.size_guard(trials)


_LIB = """lib AS (SELECT library_id, coalesce(max(seq) FILTER (WHERE type = 'CLEAR_ALL'), -1) AS clr, coalesce(max(seq) FILTER (WHERE type IN ('CLEAR_ALL','SELECT_ALL','DESELECT_ALL')), -1) AS wide, arg_max(type, seq) FILTER (WHERE type IN ('CLEAR_ALL','SELECT_ALL','DESELECT_ALL')) AS wide_type FROM actions GROUP BY 1),
 own AS (SELECT a.*, l.clr, l.wide, l.wide_type FROM actions a JOIN lib l USING (library_id) WHERE type NOT IN ('CLEAR_ALL','SELECT_ALL','DESELECT_ALL')),
 img AS (SELECT library_id, image_id, clr, wide, wide_type, coalesce(max(seq) FILTER (WHERE type = 'ADD_FILES'), -1) AS added, coalesce(max(seq) FILTER (WHERE type = 'REMOVE_IMAGE'), -1) AS removed,
   coalesce(max(seq) FILTER (WHERE type = 'ADD_FILES' AND seq < wide), -1) AS added_b, coalesce(max(seq) FILTER (WHERE type = 'REMOVE_IMAGE' AND seq < wide), -1) AS removed_b,
   greatest(wide, coalesce(max(seq) FILTER (WHERE type IN ('SELECT_IMAGE','DESELECT_IMAGE','REMOVE_IMAGE')), -1)) AS setter FROM own GROUP BY library_id, image_id, clr, wide, wide_type)"""
_STATE = f"""{_LIB}, st AS (SELECT i.library_id, i.image_id, i.added, coalesce((SELECT arg_max(o.status, o.seq) FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.type = 'UPDATE_STATUS' AND o.status IS NOT NULL AND o.seq > i.added), 'queued') AS status
  FROM img i WHERE i.added > i.removed AND i.added > i.clr)"""


@query("w8_library_state", f"WITH {_STATE} SELECT * FROM st", "actions")
def _w8(t, spark):
    return S.library_state(t("actions"))


@query("w9_selection_state", f"""WITH {_LIB}, sel AS (SELECT i.*, EXISTS (SELECT 1 FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.seq = i.setter AND o.type = 'SELECT_IMAGE') AS by_own,
   (SELECT count(*) FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.type = 'TOGGLE_SELECT' AND o.seq > i.setter) AS toggles FROM img i)
 SELECT library_id, image_id FROM sel WHERE added > removed AND added > clr AND ((by_own OR (setter = wide AND coalesce(wide_type, '') = 'SELECT_ALL' AND added_b > removed_b AND added_b > clr))::INT + toggles) % 2 = 1""", "actions")  # fmt: skip
def _w9(t, spark):
    return S.selection_state(t("actions"))


@query("a3_status_counts", f"""WITH {_STATE} SELECT library_id, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status IN ('analyzing','compressing')) AS active, count(*) FILTER (WHERE status IN ('completed','already-optimized')) AS done,
  count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status IN ('queued','analyzing','compressing')) = 0 AS idle FROM st GROUP BY 1""", "actions")  # fmt: skip
def _a3(t, spark):
    return A.status_counts(S.library_state(t("actions")))


@query("u1_append", "WITH lib AS (SELECT * FROM hashed WHERE seq % 3 = 0), inc AS (SELECT * FROM hashed WHERE seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1) SELECT seq, name, hash FROM lib UNION ALL SELECT seq, name, hash FROM inc WHERE hash NOT IN (SELECT hash FROM lib)", "hashed")
def _u1(t, spark):
    h = t("hashed")
    return S.append(h.where("seq % 3 = 0"), h.where("seq % 3 <> 0")).select("seq", "name", "hash")


@query("u2_requeue", f"WITH {_STATE} SELECT library_id, image_id, CASE WHEN status IN ('completed','already-optimized','error') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('completed','already-optimized','error') THEN 0 ELSE 50 END AS progress FROM st", "actions")
def _u2(t, spark):
    return S.requeue(S.library_state(t("actions")).withColumn("progress", F.lit(50))).select("library_id", "image_id", "status", "progress")


# --- geometry --------------------------------------------------------------------

_BOX = "image_id % 10 AS bx, image_id % 7 AS by_, 5 + image_id % 20 AS bw, 6 + image_id % 30 AS bh"


@query("g1_crop", f"SELECT image_id, least(bx + bw, 32) - bx AS width, least(by_ + bh, 32) - by_ AS height, x - bx AS x, y - by_ AS y, r, g, b, a FROM (SELECT *, {_BOX} FROM pixels) WHERE x >= bx AND y >= by_ AND x < bx + bw AND y < by_ + bh", "pixels")
def _g1(t, spark):
    p = t("pixels")
    boxes = p.groupBy("image_id").agg(F.lit(1)).selectExpr("image_id", "image_id % 10 AS x", "image_id % 7 AS y", "5 + image_id % 20 AS w", "6 + image_id % 30 AS h")
    return G.crop(p, boxes)


_OPS = "CASE image_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 270 END"


def _turn_sql(source: str) -> str:
    return f"""tr AS (SELECT *, {_OPS} AS t, image_id % 3 = 0 AS fh, image_id % 2 = 0 AS fv FROM {source}),
 t2 AS (SELECT image_id, CASE WHEN t IN (90, 270) THEN height ELSE width END AS width, CASE WHEN t IN (90, 270) THEN width ELSE height END AS height,
  CASE t WHEN 90 THEN height - 1 - y WHEN 180 THEN width - 1 - x WHEN 270 THEN y ELSE x END AS x, CASE t WHEN 90 THEN x WHEN 180 THEN height - 1 - y WHEN 270 THEN width - 1 - x ELSE y END AS y, r, g, b, a, fh, fv FROM tr),
 turned AS (SELECT image_id, width, height, CASE WHEN fh THEN width - 1 - x ELSE x END AS x, CASE WHEN fv THEN height - 1 - y ELSE y END AS y, r, g, b, a FROM t2)"""


def _ops(p: DataFrame) -> DataFrame:
    return p.groupBy("image_id").agg(F.lit(1)).select("image_id", F.expr(_OPS).alias("rotate"), (F.col("image_id") % 3 == 0).alias("flip_h"), (F.col("image_id") % 2 == 0).alias("flip_v"))


@query("g2_transform", f"WITH {_turn_sql('pixels')} SELECT {_PX} FROM turned", "pixels")
def _g2(t, spark):
    p = t("pixels")
    return G.transform(p, _ops(p)).select(*_PX.split(", "))


_TRIM = f"{_BOUNDS}, trimmed AS (SELECT p.image_id, coalesce(o.w, p.width) AS width, coalesce(o.h, p.height) AS height, p.x - coalesce(o.x, 0) AS x, p.y - coalesce(o.y, 0) AS y, p.r, p.g, p.b, p.a FROM pixels p LEFT JOIN bounds o USING (image_id) WHERE o.w IS NULL OR (p.x >= o.x AND p.y >= o.y AND p.x < o.x + o.w AND p.y < o.y + o.h))"


@query("g3_auto_trim", f"WITH {_TRIM} SELECT {_PX} FROM trimmed", "pixels")
def _g3(t, spark):
    return G.auto_trim(t("pixels")).select(*_PX.split(", "))


@query("g4_resize_nearest", """WITH g AS (SELECT image_id, 10 + image_id % 30 AS ow, 12 + image_id % 25 AS oh FROM (SELECT DISTINCT image_id FROM pixels)),
 q AS (SELECT image_id, ow, oh, nx, ny, CAST(floor((nx + 0.5::DOUBLE) * 32 / ow) AS BIGINT) AS x, CAST(floor((ny + 0.5::DOUBLE) * 32 / oh) AS BIGINT) AS y FROM g, range(40) a(nx), range(40) c(ny) WHERE nx < ow AND ny < oh)
 SELECT image_id, ow AS width, oh AS height, nx AS x, ny AS y, r, g, b, a FROM q JOIN pixels p USING (image_id, x, y)""", "pixels")  # fmt: skip
def _g4(t, spark):
    p = t("pixels")
    dims = p.groupBy("image_id").agg(F.lit(1)).selectExpr("image_id", "cast(10 + image_id % 30 AS int) AS out_w", "cast(12 + image_id % 25 AS int) AS out_h")
    return G.resize(p, dims, "Nearest")


_TO = [(20, 24), (40, 16), (32, 48)]
_PRE = ", ".join(_half(f"{c} * (a / CAST(255.0 AS DOUBLE))") + f" AS {c}" for c in "rgb")


_CUBIC = {"CatmullRom": (0.0, 0.5), "Mitchell": (1 / 3, 1 / 3)}


def _resize_sql(source: str, name: str = "Bilinear", sources: tuple[int, ...] = (32,)) -> str:
    """A resize by a kernel's weights in whole units, over x and then y."""
    kernel = "greatest(0, 1 - d)"
    if name == "Lanczos3":
        kernel = "CASE WHEN d = 0 THEN 1 WHEN d < 3 THEN sin(pi() * d) / (pi() * d) * (sin(pi() * (d / 3)) / (pi() * (d / 3))) ELSE 0 END"
    if name in _CUBIC:
        b, c = _CUBIC[name]
        num = lambda v: f"CAST({v!r} AS DOUBLE)"
        kernel = f"""CASE WHEN d < 1 THEN ({num(12 - 9 * b - 6 * c)} * d * d * d + {num(-18 + 12 * b + 6 * c)} * d * d + {num(6 - 2 * b)}) / 6 WHEN d < 2
   THEN ({num(-b - 6 * c)} * d * d * d + {num(6 * b + 30 * c)} * d * d + {num(-12 * b - 48 * c)} * d + {num(8 * b + 24 * c)}) / 6 ELSE 0 END"""
    sizes = ", ".join(f"({m}, {n})" for m in sources for n in sorted({n for p in _TO for n in p}))
    gain = lambda c: f"greatest(0, least(255, CAST(floor((sum({c} * weight) + 8192) / 16384) AS BIGINT))) AS {c}"
    back = lambda c: f"CASE WHEN a = 0 THEN 0 ELSE least(255, {_half(f'least({c}, a) / (a / CAST(255.0 AS DOUBLE))')}) END AS {c}"
    return f"""sz(src, dst) AS (VALUES {sizes}), taps AS (SELECT src, dst, at_, f, {kernel} AS k FROM (SELECT *, abs((f + 0.5::DOUBLE - c) / greatest(1.0, src / CAST(dst AS DOUBLE))) AS d FROM (SELECT src, dst, at_, (at_ + 0.5::DOUBLE) * (src / CAST(dst AS DOUBLE)) AS c FROM sz, range(64) t(at_) WHERE at_ < dst), range(256) s(f) WHERE f < src)),
 wt AS (SELECT src, dst, at_, f, {_half('k / sum(k) OVER (PARTITION BY src, dst, at_) * 16384')} AS weight FROM taps WHERE k <> 0),
 pm AS (SELECT image_id, width, height, x, y, {_PRE}, a, CASE image_id % 3 WHEN 0 THEN {_TO[0][0]} WHEN 1 THEN {_TO[1][0]} ELSE {_TO[2][0]} END AS ow, CASE image_id % 3 WHEN 0 THEN {_TO[0][1]} WHEN 1 THEN {_TO[1][1]} ELSE {_TO[2][1]} END AS oh FROM {source}),
 px AS (SELECT image_id, height, ow, oh, y, at_ AS x, {', '.join(map(gain, 'rgba'))} FROM pm JOIN wt ON src = width AND dst = ow AND f = x GROUP BY ALL),
 py AS (SELECT image_id, ow, oh, x, at_ AS y, {', '.join(map(gain, 'rgba'))} FROM px JOIN wt ON src = height AND dst = oh AND f = px.y GROUP BY image_id, ow, oh, x, at_),
 resized AS (SELECT image_id, ow AS width, oh AS height, x, y, {', '.join(map(back, 'rgb'))}, a FROM py)"""


def _dims(p: DataFrame) -> DataFrame:
    pick = lambda k: F.when(F.col("image_id") % 3 == 0, _TO[0][k]).when(F.col("image_id") % 3 == 1, _TO[1][k]).otherwise(_TO[2][k])
    return p.groupBy("image_id").agg(F.lit(1)).select("image_id", pick(0).alias("out_w"), pick(1).alias("out_h"))


@query("g5_resize_bilinear", f"WITH {_resize_sql('pixels')} SELECT {_PX} FROM resized", "pixels")
def _g5(t, spark):
    p = t("pixels")
    return G.resize(p, _dims(p), "Bilinear")


@query("g5_resize_mitchell", f"WITH {_resize_sql('pixels', 'Mitchell')} SELECT {_PX} FROM resized", "pixels")
def _g5m(t, spark):
    p = t("pixels")
    return G.resize(p, _dims(p), "Mitchell")


@query("g5_resize_catmull_rom", f"WITH {_resize_sql('pixels', 'CatmullRom')} SELECT {_PX} FROM resized", "pixels")
def _g5c(t, spark):
    p = t("pixels")
    return G.resize(p, _dims(p), "CatmullRom")


@query("g5_resize_lanczos", f"WITH {_resize_sql('pixels', 'Lanczos3')} SELECT {_PX} FROM resized", "pixels")
def _g5l(t, spark):
    p = t("pixels")
    return G.resize(p, _dims(p), "Lanczos3")


@query("g5_resize_lanczos_big", f"WITH {_resize_sql('pixels_big', 'Lanczos3', (125, 160))} SELECT {_PX} FROM resized", "pixels_big")
def _g5l_big(t, spark):
    """From 160 x 125: up to 54 taps a place."""
    p = t("pixels_big")
    return G.resize(p, _dims(p), "Lanczos3")


@query("g6_premultiply", f"SELECT image_id, x, y, {_PRE}, a FROM pixels", "pixels")
def _g6(t, spark):
    return G.premultiply(t("pixels")).select("image_id", "x", "y", "r", "g", "b", "a")


@query("g6_unpremultiply", f"WITH m AS (SELECT image_id, x, y, {_PRE}, a FROM (SELECT image_id, x, y, r, g, b, CASE WHEN a = 0 THEN 0 ELSE 1 + x * 7 END AS a FROM pixels)) SELECT image_id, x, y, " + ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE least(255, {_half(f'{c} / (a / CAST(255.0 AS DOUBLE))')}) END AS {c}" for c in "rgb") + ", a FROM m", "pixels")
def _g6u(t, spark):
    p = t("pixels").withColumn("a", F.when(F.col("a") == 0, 0).otherwise(1 + F.col("x") * 7))
    return G.unpremultiply(G.premultiply(p)).select("image_id", "x", "y", "r", "g", "b", "a")


@query("g8_apply_edits", f"WITH {_TRIM}, {_turn_sql('trimmed')}, {_sharpen_sql('turned', 0.25)}, {_blur_sql('sharp', 2)} {_INT} blurred", "pixels")
def _g8(t, spark):
    p = t("pixels")
    return G.apply_edits(p, trim=25, ops=_ops(p), sharpen_amount=0.25, blur_radius=2)


@query("g8_apply_edits_tall", f"WITH {_TRIM}, {_turn_sql('trimmed')}, {_sharpen_sql('turned', 0.25)}, {_blur_sql('sharp', 9)} {_INT} blurred".replace("FROM pixels", "FROM pixels_tall").replace("JOIN pixels", "JOIN pixels_tall"), "pixels_tall")
def _g8_tall(t, spark):
    """Images of 600 lines: every step crosses bands."""
    p = t("pixels_tall")
    return G.apply_edits(p, trim=25, ops=_ops(p), sharpen_amount=0.25, blur_radius=9)


@query("w1_box_blur_tall", f"WITH {_sharpen_sql('pixels_tall', 0.5)}, {_blur_sql('sharp', 50)} {_INT} blurred", "pixels_tall")
def _w1_tall(t, spark):
    return W.filtered(t("pixels_tall"), 0.5, 50)


@query("w1_box_blur_big", f"WITH {_blur_sql('pixels_big', 7)} {_INT} blurred", "pixels_big")
def _w1_big(t, spark):
    return W.box_blur(t("pixels_big"), 7)


_CROPPED = "boxed AS (SELECT image_id, 24 AS width, 28 AS height, x - 4 AS x, y - 2 AS y, r, g, b, a FROM pixels WHERE x >= 4 AND y >= 2 AND x < 28 AND y < 30)"


@query("g8_apply_edits_crop_resize", f"WITH {_CROPPED}, {_resize_sql('boxed', sources=(24, 28))}, {_turn_sql('resized')}, {_sharpen_sql('turned', 0.25)}, {_blur_sql('sharp', 2)} {_INT} blurred", "pixels")
def _g8x(t, spark):
    p = t("pixels")
    boxes = p.select("image_id").distinct().select("image_id", F.lit(4).alias("x"), F.lit(2).alias("y"), F.lit(24).alias("w"), F.lit(28).alias("h"))
    return G.apply_edits(p, boxes=boxes, dims=_dims(p), filter="Bilinear", ops=_ops(p), sharpen_amount=0.25, blur_radius=2)


# --- sources and user functions --------------------------------------------------

#: Leading bytes; two of them only begin like a known format.
_MAGIC = ["89504E470D0A1A0A0000", "FFD8FFE0000000000000", "49492A00080000000000", "0000001866747970686569630000", "474946383961", "424D0000", "4D4D002A0000", "00", "4D4D00780000", "474946383061"]
_HEX = "[" + ", ".join(f"'{m}'" for m in _MAGIC) + "][id % 10 + 1]"


@query("s2_sniff_format", f"""SELECT id, coalesce(CASE mime WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpeg' WHEN 'image/webp' THEN 'webp' WHEN 'image/svg+xml' THEN 'svg' WHEN 'image/x-tiff' THEN 'tiff' END,
  CASE lower(regexp_extract(name, '[^.]*$')) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'webp' THEN 'webp' WHEN 'tif' THEN 'tiff' WHEN 'heic' THEN 'heic' END,
  CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'tiff' WHEN h[9:16] = '66747970' AND h[17:24] IN ('68656963', '6D696631', '6D736631') THEN 'heic'
   WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' END) AS sniffed FROM (SELECT id, name, CASE WHEN id % 35 = 4 THEN 'image/x-tiff' ELSE mime END AS mime, {_HEX} AS h FROM jobs)""", "jobs")  # fmt: skip
def _s2(t, spark):
    content = F.unhex(F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("id") % 10 + 1).cast("int")))
    mime = F.when(F.col("id") % 35 == 4, F.lit("image/x-tiff")).otherwise(F.col("mime"))
    return t("jobs").select("id", files.sniff_format(content, F.col("name"), mime).alias("sniffed"))


def _packed(p: DataFrame) -> DataFrame:
    """Rasters put together from pixels again, each of which is one number: its place above its colour."""
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    # the highest bit but one is set, so that all numbers have sixteen digits
    value = F.lit(1 << 62).bitwiseOR(F.shiftleft(place, 32))
    for k, c in enumerate("rgba"):
        value = value.bitwiseOR(F.shiftleft(F.col(c).cast("long").bitwiseAND(255), 24 - 8 * k))
    rows = p.groupBy("image_id", "width", "height").agg(F.sort_array(F.collect_list(value)).alias("cells"))
    return rows.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("cells", lambda c: F.substring(F.hex(c), 9, 8)), "")).alias("data"))


@query("s4_explode_pixels", f"SELECT {_PX} FROM pixels", "pixels")
def _s4(t, spark):
    return files.explode_pixels(_packed(t("pixels")))


def _pngs(docs: DataFrame) -> DataFrame:
    """A PNG's chunks around each document's text."""
    word = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    chunk = lambda name, body: F.concat(word(F.octet_length(body)), F.encode(F.lit(name), "UTF-8"), body, F.unhex(F.lit("00000000")))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    extra = F.when(F.col("doc_id") % 3 == 0, chunk("tIME", F.unhex(F.lit("07E80101000000")))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk("IHDR", F.unhex(F.lit("00" * 13))), chunk("tEXt", text), extra, chunk("IEND", F.unhex(F.lit(""))))
    return docs.select(F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 10 != 9, content).otherwise(text).alias("content"))


_CHUNKS = """chunks AS (SELECT doc_id AS image_id, n.seq, n.name, n.length FROM (SELECT doc_id, unnest(list_concat([{seq: 0, name: 'IHDR', length: 13}, {seq: 1, name: 'tEXt', length: strlen(coalesce(text, ''))}],
   CASE WHEN doc_id % 3 = 0 THEN [{seq: 2, name: 'tIME', length: 7}, {seq: 3, name: 'IEND', length: 0}] ELSE [{seq: 2, name: 'IEND', length: 0}] END)) AS n FROM documents WHERE doc_id % 10 <> 9))"""


def _documents(name: str, sql: str):
    """Register a query over documents as they are."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return keep


@_documents("s5_png_chunks", f"WITH {_CHUNKS} SELECT image_id, seq, name, length, name IN ('tEXt','tIME') AS is_metadata FROM chunks")
def _s5(docs):
    return files.png_chunks(_pngs(docs))


@_documents("s5_metadata_audit", f"WITH {_CHUNKS} SELECT name, count(DISTINCT image_id) AS images, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM chunks WHERE name IN ('tEXt','tIME') GROUP BY 1")
def _s5a(docs):
    return files.metadata_audit(_pngs(docs))


def _sizes(batch):
    return batch.assign(bytes=batch["data"].map(len).astype("int64"), first=batch["data"].map(lambda d: d[0]).astype("int64"))[["image_id", "bytes", "first"]]


@query("f1_map_rasters", "SELECT image_id, count(*) * 4 AS bytes, max(CASE WHEN x = 0 AND y = 0 THEN r END) AS first FROM pixels GROUP BY 1", "pixels")
def _f1(t, spark):
    return udx.map_rasters(_packed(t("pixels")), _sizes, "image_id long, bytes long, first long")


# --- streams, in their batch form ------------------------------------------------


_TEXT = {"format": "format", "presetId": "presetId", "ctaName": "ctaName", "location": "location", "destination": "destination", "stage": "stage", "errorType": "errorType", "errorMessage": "errorMessage", "context": "context"}
_NUMBERS = {"count": "BIGINT", "totalSizeKb": "DOUBLE", "originalSizeKb": "DOUBLE", "compressedSizeKb": "DOUBLE", "savingsPercent": "DOUBLE", "imageCount": "BIGINT", "totalOriginalKb": "DOUBLE", "totalCompressedKb": "DOUBLE", "avgSavingsPercent": "DOUBLE", "quality": "BIGINT", "timestamp": "BIGINT"}
_PARSED = ", ".join([*(f"props->>'$.{k}' AS \"{k}\"" for k in _TEXT), *(f"CAST(props->>'$.{k}' AS {t}) AS \"{k}\"" for k, t in _NUMBERS.items())])
_USED = f"used AS (SELECT event_id, ts, user_id, name, {_PARSED} FROM usage WHERE name <> 'mystery' UNION ALL SELECT event_id, ts, user_id, name, {', '.join(['NULL'] * (len(_TEXT) + len(_NUMBERS)))} FROM usage WHERE name = 'mystery')"


@query("st3_parse_telemetry", f"WITH {_USED} SELECT event_id, user_id, name, {', '.join(f'\"{k}\"' for k in [*_TEXT, *_NUMBERS])}, name = 'mystery' AS is_rejected FROM used", "usage")
def _st3(t, spark):
    return ST.parse_telemetry(t("usage")).select("event_id", "user_id", "name", *_TEXT, *_NUMBERS, F.col("rejected").isNotNull().alias("is_rejected"))


_SUM = "CAST(coalesce(sum({c}) FILTER (WHERE name = '{n}'), 0) AS {t}) AS {a}"
_KPI = ", ".join([
    "count(*) AS events", _SUM.format(c="count", n="image_upload", t="BIGINT", a="uploads"), _SUM.format(c="totalSizeKb", n="image_upload", t="DOUBLE", a="upload_kb"), "count(*) FILTER (WHERE name = 'compression_complete') AS completed",
    _SUM.format(c="originalSizeKb", n="compression_complete", t="DOUBLE", a="kb_in"), _SUM.format(c="compressedSizeKb", n="compression_complete", t="DOUBLE", a="kb_out"), _SUM.format(c="count", n="download", t="BIGINT", a="downloads"),
    *(f"count(*) FILTER (WHERE name = 'download' AND format = '{f}') AS downloads_{f}" for f in ("png", "jpeg", "webp", "avif", "jxl", "svg")), *(f"count(*) FILTER (WHERE name = 'preset_select' AND presetId = '{p}') AS picks_{p}" for p in ("photo", "graphic", "social", "custom")),
    "count(*) FILTER (WHERE name = 'error') AS errors", "round(count(*) FILTER (WHERE name = 'error') / CAST(count(*) AS DOUBLE), 6) AS error_rate",
])


@query("st4_tumbling_kpis", f"WITH {_USED} SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS \"end\", {_KPI} FROM used GROUP BY 1, 2", "usage", ("error_rate",))
def _st4(t, spark):
    return ST.windowed_kpis(ST.parse_telemetry(t("usage")), "1 hour")


@query("st4_sliding_kpis", f"WITH {_USED}, w AS (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour' * k AS start FROM used, range(2) r(k)) SELECT start, start + INTERVAL '2 hours' AS \"end\", {_KPI} FROM w GROUP BY 1, 2", "usage", ("error_rate",))
def _st4s(t, spark):
    return ST.windowed_kpis(ST.parse_telemetry(t("usage")), "2 hours", "1 hour")


@query("st5_funnel", """WITH a AS (SELECT user_id, min(ts) AS t FROM telemetry WHERE stage = 'landing' GROUP BY 1),
 b AS (SELECT user_id, min(e.ts) AS t FROM telemetry e JOIN a USING (user_id) WHERE stage = 'upload' AND e.ts >= a.t GROUP BY 1),
 c AS (SELECT user_id, min(e.ts) AS t FROM telemetry e JOIN b USING (user_id) WHERE stage = 'completed' AND e.ts >= b.t GROUP BY 1),
 d AS (SELECT user_id, min(e.ts) AS t FROM telemetry e JOIN c USING (user_id) WHERE stage = 'download' AND e.ts >= c.t GROUP BY 1),
 n AS (SELECT (SELECT count(*) FROM a) AS n0, (SELECT count(*) FROM b) AS n1, (SELECT count(*) FROM c) AS n2, (SELECT count(*) FROM d) AS n3)
 SELECT s.step, s.stage, s.users, round(CASE WHEN s.prev > 0 THEN s.users / CAST(s.prev AS DOUBLE) ELSE 0.0 END, 6) AS conversion FROM (SELECT unnest([{step: 0, stage: 'landing', users: n0, prev: n0}, {step: 1, stage: 'upload', users: n1, prev: n0}, {step: 2, stage: 'completed', users: n2, prev: n1}, {step: 3, stage: 'download', users: n3, prev: n2}]) AS s FROM n)""", "telemetry", ("conversion",))  # fmt: skip
def _st5(t, spark):
    return ST.funnel(t("telemetry"))


_DONE = "FILTER (WHERE name = 'compression_complete')"


@query("st6_session_batches", f"""WITH {_USED}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM used WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS events, count(*) FILTER (WHERE name = 'error') AS errors, count(*) {_DONE} AS images,
  {_half(f'coalesce(sum(originalSizeKb) {_DONE}, 0)')} AS original_kb, {_half(f'coalesce(sum(compressedSizeKb) {_DONE}, 0)')} AS compressed_kb, {_half(f'avg(savingsPercent) {_DONE}')} AS savings FROM s GROUP BY user_id, k""", "usage")  # fmt: skip
def _st6(t, spark):
    return ST.session_batches(ST.parse_telemetry(t("usage")), "30 minutes")


@query("st2_state_view", f"""WITH {_STATE}, sel AS (SELECT i.*, EXISTS (SELECT 1 FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.seq = i.setter AND o.type = 'SELECT_IMAGE') AS by_own,
   (SELECT count(*) FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.type = 'TOGGLE_SELECT' AND o.seq > i.setter) AS toggles FROM img i)
 SELECT library_id, image_id, status, ((by_own OR (setter = wide AND coalesce(wide_type, '') = 'SELECT_ALL' AND added_b > removed_b AND added_b > clr))::INT + toggles) % 2 = 1 AS selected FROM sel JOIN st USING (library_id, image_id)""", "actions")  # fmt: skip
def _st2(t, spark):
    return ST.state_view(t("actions"))


# --- files ------------------------------------------------------------------------


_ENDINGS = ["png", "JPG", "Jpeg", "webp", "txt", "tif"]
_NAMED = "SELECT 'f' || doc_id || '.' || ['png', 'JPG', 'Jpeg', 'webp', 'txt', 'tif'][doc_id % 6 + 1] AS name, coalesce(text, '') AS content FROM documents"


def _texts(docs: DataFrame) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select(F.concat(F.lit("f"), "doc_id", F.lit("."), ending).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@_documents("s1_scan_catalog", f"SELECT name, strlen(content) AS length, sha256(content) AS hash FROM ({_NAMED}) WHERE NOT ends_with(name, 'txt')")
def _s1(docs):
    folder = new_folder(docs.sparkSession)
    files_of(_texts(docs), folder, number=docs.count())
    return settled(files.scan_catalog(docs.sparkSession, folder).select("name", "length", "hash"), folder)


@_documents("st1_ingest", f"SELECT DISTINCT sha256(content) AS hash, strlen(content) AS length FROM ({_NAMED}) WHERE NOT ends_with(name, 'txt')")
def _st1(docs):
    folder = new_folder(docs.sparkSession)
    files_of(_texts(docs), folder, number=docs.count())
    return settled(ST.ingest(files.scan_catalog(docs.sparkSession, folder).drop("hash")).select("hash", "length"), folder)


def _bitmaps(p: DataFrame) -> DataFrame:
    """A 32-bit bitmap file of each raster, from its lowest line up."""
    word = lambda n: struct.pack("<I", n)

    def run(batches):
        for batch in batches:
            for name, w, h, data in zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "height", "data")), strict=True):
                cells = np.frombuffer(data, np.uint8).reshape(h, w, 4)[::-1, :, 2::-1]
                lines = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
                lines[:, : 3 * w] = cells.reshape(h, -1)
                head = b"BM" + word(54 + lines.size) + word(0) + word(54) + word(40) + word(w) + word(h) + struct.pack("<HH", 1, 24) + word(0) * 6
                yield pa.RecordBatch.from_arrays([pa.array([f"i{name}.bmp"]), pa.array([head + lines.tobytes()], pa.binary())], ["name", "content"])

    return _packed(p).mapInArrow(run, "name string, content binary")


@query("s3_read_rasters", "SELECT 'i' || image_id || '.bmp' AS name, max(width) AS width, max(height) AS height, CAST(sum(r * (1 + x + 7 * y)) AS BIGINT) AS r, CAST(sum(g * (1 + x + 7 * y)) AS BIGINT) AS g, CAST(sum(b * (1 + x + 7 * y)) AS BIGINT) AS b, 255 AS a FROM pixels GROUP BY image_id", "pixels")
def _s3(t, spark):
    folder = new_folder(spark)
    files_of(_bitmaps(t("pixels")), folder)
    found = files.explode_pixels(files.read_rasters(spark, folder))
    place = 1 + F.col("x") + 7 * F.col("y")
    sums = found.groupBy(F.element_at(F.split("image_id", "/"), -1).alias("name")).agg(F.max("width").alias("width"), F.max("height").alias("height"), *(F.sum(F.col(c) * place).alias(c) for c in "rgb"), F.min("a").alias("a"))
    return settled(sums, folder)


@query("s6_write_outcomes", r"SELECT id, 'optimized-' || regexp_replace(name, '\.[^/.]+$', '') || '.' || CASE format WHEN 'jpeg' THEN 'jpg' ELSE format END AS file_name, format, CASE WHEN id % 4 = 0 THEN 'orig-' || id ELSE 'out-' || id END AS resolved_blob FROM outcomes WHERE raw_status <> 'error'", "outcomes")
def _s6(t, spark):
    folder = new_folder(spark)
    path = f"{folder}/outcomes"
    out = t("outcomes").withColumn("output_blob", F.when(F.col("id") % 4 != 0, F.concat(F.lit("out-"), "id")))
    files.write_outcomes(out, path, t("outcomes").select("id", F.concat(F.lit("orig-"), "id").alias("original_blob")))
    return settled(spark.read.parquet(path).select("id", "file_name", "format", "resolved_blob"), folder)
