"""Projections and predicates over outcomes and jobs (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted MIME types and extensions.
ACCEPTED_MIME = ["image/png", "image/jpeg", "image/webp", "image/avif", "image/heic", "image/heif", "image/svg+xml", "image/gif", "image/tiff", "image/bmp"]
ACCEPTED_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".avif", ".heic", ".heif", ".svg", ".gif", ".tiff", ".tif", ".bmp"]
MAX_FILE_SIZE, MAX_FILES = 50 * 1024 * 1024, 100
SKIP_BELOW = 3.0
# Namespaces that vector editors leave behind.
EDITOR_PREFIXES = ["sodipodi", "inkscape", "sketch", "adobe", "figma", "serif", "i", "x"]


def half_up(c: Column) -> Column:
    """Round to the nearest integer, halves up."""
    return F.floor(c + 0.5)


def savings(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, (original - compressed) / original * 100).otherwise(0.0)


def with_savings(df: DataFrame) -> DataFrame:
    """Percent saved, and the same floored at 0."""
    s = savings(F.col("original_size"), F.col("compressed_size"))
    return df.withColumn("savings", s).withColumn("savings_shown", F.greatest(s, F.lit(0.0)))


def with_status(df: DataFrame, min_savings: float = 2.0) -> DataFrame:
    """Already-optimized where too little is saved; errors pass through."""
    s = savings(F.col("original_size"), F.col("compressed_size"))
    small = (s < min_savings) | (F.col("compressed_size") >= F.col("original_size"))
    return df.withColumn("status", F.when(F.col("raw_status") == "error", F.lit("error")).when(small, F.lit("already-optimized")).otherwise(F.lit("completed")))


def with_quality_score(df: DataFrame) -> DataFrame:
    """An estimate between 60 and 100."""
    s = savings(F.col("original_size"), F.col("compressed_size"))
    return df.withColumn("quality_score", F.greatest(F.lit(60.0), F.least(F.lit(100.0), 100 - s * 0.2)))


def human_bytes(c: Column) -> Column:
    """B, KB with one decimal, MB with two."""
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long")))
        .when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024.0))
        .otherwise(F.format_string("%.2f MB", c / (1024.0 * 1024.0)))
    )


def output_name(name: Column, fmt: Column) -> Column:
    """P5: the name without its last extension, prefixed, with the format's extension."""
    return F.concat(F.lit("optimized-"), F.regexp_replace(name, r"\.[^/.]+$", ""), F.lit("."), F.when(fmt == "jpeg", F.lit("jpg")).otherwise(fmt))


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def normalise_format(mime: Column, name: Column) -> Column:
    """The MIME subtype, else the extension, else png; usual aliases merged."""
    subtype = F.when(mime.startswith("image/"), F.substring(F.lower(mime), 7, 1000)).otherwise(F.lit(""))
    raw = F.when(subtype != "", subtype).otherwise(extension(name))
    known = F.when(raw == "jpg", F.lit("jpeg")).when(raw == "svg+xml", F.lit("svg")).when(raw == "tif", F.lit("tiff")).otherwise(raw)
    return F.when(known.isin("png", "jpeg", "webp", "avif", "heic", "heif", "svg", "gif", "tiff", "bmp", "jxl"), known).otherwise(F.lit("png"))


def select_format(df: DataFrame) -> DataFrame:
    """Webp for transparency and photos (missing analysis counts as a photo), else png."""
    return df.withColumn("chosen_format", F.when(F.col("has_transparency"), F.lit("webp")).when(F.coalesce(F.col("type") == "photo", F.lit(True)), F.lit("webp")).otherwise(F.lit("png")))


def fit_dimensions(df: DataFrame) -> DataFrame:
    """Scaled sides and the centre crop for contain, inside, cover, outside and fill."""
    w, h = F.col("width"), F.col("height")
    tw, th = F.coalesce("target_width", "width"), F.coalesce("target_height", "height")
    sx, sy = tw / w, th / h
    inside = F.col("fit").isin("contain", "inside") | F.col("fit").isNull()
    scale = F.when(F.col("fit").isin("cover", "outside"), F.greatest(sx, sy)).otherwise(F.least(sx, sy))
    fits = inside & (w <= tw) & (h <= th)
    side = lambda own, target: F.when(F.col("fit") == "fill", target).when(fits, own).otherwise(F.greatest(F.lit(1), half_up(own * scale)))
    out = df.withColumn("out_width", side(w, tw).cast("long")).withColumn("out_height", side(h, th).cast("long"))
    cover = F.col("fit") == "cover"
    centre = lambda out_side, target: F.when(cover, F.floor(F.greatest(F.lit(0), F.col(out_side) - target) / 2))
    return out.withColumn("crop_x", centre("out_width", tw)).withColumn("crop_y", centre("out_height", th)).withColumn("crop_w", F.when(cover, F.least(tw, "out_width"))).withColumn("crop_h", F.when(cover, F.least(th, "out_height")))


def plan_probe(jobs: DataFrame) -> DataFrame:
    """The probe's scale and size; only where source and target format agree and no size is asked for."""
    scale = F.least(F.lit(0.5), 512 / F.greatest("width", "height"))
    probe = (normalise_format(F.col("mime"), F.col("name")) == F.col("format")) & F.col("target_kb").isNull()
    size = lambda c: F.greatest(F.lit(1), half_up(F.col(c) * scale))
    return jobs.withColumn("probe", probe).withColumn("probe_width", F.when(probe, size("width"))).withColumn("probe_height", F.when(probe, size("height")))


def probe_verdict(df: DataFrame, skip_below: float = SKIP_BELOW) -> DataFrame:
    """P10: savings expected from a probe of ``probe_bytes``; a failed probe is never skipped."""
    estimate = F.col("original_size") * (F.col("probe_width") * F.col("probe_height")) / (F.col("width") * F.col("height"))
    saved = F.greatest(F.lit(0.0), (1 - F.try_divide(F.col("probe_bytes"), estimate)) * 100)
    failed = F.col("probe_bytes").isNull() | F.coalesce(estimate <= 0, F.lit(True))
    return df.withColumn("expected_savings", F.when(failed, 100.0).otherwise(saved)).withColumn("skip", F.when(failed, False).otherwise(saved < skip_below))


def resolve_options(jobs: DataFrame) -> DataFrame:
    """Defaults and units: quality 85 (0 counts as missing), sharpen in 0..1, blur halved, trim in 0..255."""
    get = lambda c, d: F.coalesce(c, F.lit(d))
    return jobs.select(
        "id",
        F.coalesce(F.nullif(F.col("quality"), F.lit(0)), F.lit(85)).alias("quality"),
        (get("sharpen", 0) / 100).alias("sharpen"),
        (get("blur", 0) / 2).alias("blur"),
        half_up(get("trim_threshold", 10) * 2.55).alias("trim_threshold"),
        get("rotate", 0).alias("rotate"),
        get("resize_filter", "Lanczos3").alias("resize_filter"),
        get("fit", "contain").alias("fit"),
        get("dithering", 1.0).alias("dithering"),
        get("avif_speed", 6).alias("avif_speed"),
        get("avif_depth", 8).alias("avif_depth"),
    )


def encode_policy(jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Lossless and quality by format and image class; a set lossless flag stays."""
    both = jobs.join(analysis, "id", "left")
    png = F.when(F.col("type").isin("photo", "mixed"), False).when(F.col("type") == "graphic", F.col("unique_colors") < 256)
    photo = (F.col("format") == "jpeg") & (F.col("type") == "photo")
    return both.withColumn("effective_lossless", F.coalesce("lossless", F.when(F.col("format") == "png", png))).withColumn("effective_quality", F.when(photo, F.greatest("quality", F.lit(70))).otherwise(F.col("quality")))


def admit(df: DataFrame, max_size: int = MAX_FILE_SIZE, max_files: int = MAX_FILES) -> DataFrame:
    """Accepted files of at most 50 MB; a batch with over 100 files of accepted kinds is refused whole.

    Batches are counted by sums before the shuffle and the full ones taken out, so a
    batch with very many files is many tasks.
    """
    ok = F.col("mime").isin(ACCEPTED_MIME) | F.concat(F.lit("."), extension(F.col("name"))).isin(ACCEPTED_EXTENSIONS)
    full = df.where(ok).groupBy("batch_id").agg(F.count("*").alias("batch_files")).where(F.col("batch_files") > max_files).select("batch_id")
    return df.join(full, "batch_id", "left_anti").where(ok & (F.col("size") <= max_size))


def clean_markup(df: DataFrame, col: str = "markup", mode: str = "safe") -> DataFrame:
    """A text approximation of an optimiser for vector markup, set at a time.

    Safe mode strips doctype, prolog, comments, metadata, editors' attributes and
    empty attributes, and collapses white space. Aggressive mode also rounds
    decimals of three and more places to two.
    """
    out = F.col(col)
    editors = "|".join(EDITOR_PREFIXES)
    for pattern, by in (
        (r"(?i)<!doctype[^>]*>", ""), (r"<\?xml[^>]*\?>", ""), (r"(?s)<!--.*?-->", ""), (r"(?s)<metadata[^>]*>.*?</metadata>", ""),
        (rf'\s(?:xmlns:)?(?:{editors}):[A-Za-z-]+="[^"]*"', ""), (r'\s[A-Za-z:-]+=""', ""), (r"[ \t\r\n]+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    if mode == "aggressive":
        decimal = r"[0-9]+\.[0-9]{3,}"
        plain, numbers = F.split(out, decimal), F.regexp_extract_all(out, F.lit(f"({decimal})"))
        rounded = F.transform(numbers, lambda n: F.format_string("%.2f", F.floor(n.cast("double") * 100 + 0.5) / 100))
        out = F.array_join(F.flatten(F.transform(F.arrays_zip(plain.alias("p"), rounded.alias("n")), lambda z: F.array(z["p"], F.coalesce(z["n"], F.lit(""))))), "")
    sized = df.withColumn("cleaned", out).withColumn("original_size", F.octet_length(col).cast("long"))
    return sized.withColumn("cleaned_size", F.octet_length("cleaned").cast("long")).withColumn("savings", savings(F.col("original_size"), F.col("cleaned_size")))
