"""Benchmark decontamination by template windows (DataFrame functions only).

Texts become templates: words lose outer punctuation, a number and the unit attached to
it become two words, then units, numbers in digits or words, and words with a capital
(but ``A`` and ``I``) turn into typed placeholders and other words lose case. Every window of
``window`` tokens of a document is looked up among those of the benchmark by a hash
join. Matches on one diagonal (document place minus item place) fill the placeholders
with values; where a value of the item stands for several of the document, or the
other way round, the commonest pair counts and windows that hold another go. An item
counts as leaked where the windows left cover enough of it, so questions with new
numbers or names are found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, COVERAGE = 8, 0.5
#: Keys of benchmark windows (8 bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion"]
UNITS = ["km", "m", "cm", "mm", "miles", "mile", "feet", "ft", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "litres", "liters", "l", "ml", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees", "meters", "metres"]


_ATTACHED = rf"([0-9](?:[0-9.,:/]*[0-9])?)((?i:{'|'.join(UNITS)}))"


def _bare(text: Column) -> Column:
    """The words without outer punctuation, each between single spaces; what is punctuation alone goes."""
    outer = r"(?<=\s)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?=\s)"
    bare = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), outer, "")
    return F.regexp_replace(bare, rf"(?<=\s){_ATTACHED}(?=\s)", "$1 $2")


def _template(bare: Column) -> Column:
    """The same words with placeholders, in lower case."""
    units = F.regexp_replace(bare, rf"\s(?i:{'|'.join(UNITS)})(?=\s)", " <unit>")
    words = F.regexp_replace(units, rf"\s(?i:{'|'.join(NUMBERS)})(?=\s)", " <num>")
    names = F.regexp_replace(words, r"\s(?!(?:A|I)\s)\p{Lu}(?:\p{L}\S*)?(?=\s)", " <name>")
    return F.lower(F.regexp_replace(names, r"\s[0-9][0-9.,:/]*(?=\s)", " <num>"))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _formed(df: DataFrame, id_name: str, window: int) -> DataFrame:
    """``id, n, raw, form`` of each text of at least ``window`` words."""
    bare = df.where("text is not null").select(id_name, _bare(F.col("text")).alias("bare"))
    rows = bare.select(id_name, _words(F.col("bare")).alias("raw"), _words(_template(F.col("bare"))).alias("form"))
    return rows.withColumn("n", F.size("form")).where(F.col("n") >= window)


def _windows(df: DataFrame, id_name: str, window: int) -> DataFrame:
    """``id, n, at, key, raw, form`` for each window; ``at`` counts from 0, raw and form are whole texts."""
    rows = _formed(df, id_name, window)
    rows = rows.select(id_name, "raw", "form", "n", F.explode(F.sequence(F.lit(1), F.col("n") - (window - 1))).alias("i"))
    return rows.select(id_name, "n", (F.col("i") - 1).alias("at"), F.xxhash64(F.slice("form", F.col("i"), window)).alias("key"), "raw", "form")


def _met(docs: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """``doc_id, at, key, raw, form`` of the windows of ``doc_id, text`` whose key is among the distinct keys, cut out of their texts."""
    if keys.count() <= BROADCAST_KEYS:
        # most windows end here, before anything is cut out of their texts
        met = _windows(docs, "doc_id", window).join(F.broadcast(keys), "key", "left_semi")
    else:
        # keys meet windows without their texts, which are fetched once for each text that has a match
        named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("own")).alias("name"), "text")
        found = _windows(named, "name", window).select("key", "name.own", "at").join(keys, "key", "left_semi")
        places = found.groupBy("own").agg(F.collect_set(F.struct("at", "key")).alias("places"))
        texts = _formed(named, "name", window).select(F.col("name.doc_id").alias("doc_id"), F.col("name.own").alias("own"), "n", "raw", "form")
        met = texts.join(places, "own").select("doc_id", "n", "raw", "form", F.explode("places").alias("place")).select("doc_id", "n", "place.at", "place.key", "raw", "form")
    return _cut(met, window)


def _cut(df: DataFrame, window: int) -> DataFrame:
    return df.withColumns({c: F.slice(c, F.col("at") + 1, window) for c in ("raw", "form")})


def leaked_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, covered, coverage`` for each leaked item of each document.

    Only matches are returned. Null and empty texts, and texts with fewer tokens
    than a window, match nothing; the same holds for such items. Repeated rows of
    an id are one document. Null ids form one group of their own. Empty tables give
    an empty result; other columns are ignored.
    """
    get = lambda name: F.col(f"`{name}`")
    items = _cut(_windows(benchmark.select(get(item_col).alias("item_id"), get(item_text_col).alias("text")), "item_id", window), window)
    items = items.select("item_id", F.col("n").alias("item_n"), F.col("at").alias("item_at"), "key", F.col("raw").alias("item_raw"), F.col("form").alias("item_form"))
    keys = items.select("key").distinct()
    met = _met(docs.select(get(id_col).alias("doc_id"), get(text_col).alias("text")), keys, window)
    found = met.join(items, "key").where(F.col("form") == F.col("item_form"))
    place = F.sequence(F.col("item_at"), F.col("item_at") + (window - 1))
    slots = F.transform(
        F.filter(F.arrays_zip("form", "raw", "item_raw", place.alias("place")), lambda z: z.form.isin("<num>", "<unit>", "<name>")),
        lambda z: F.struct(z.place.alias("place"), z.form.alias("kind"), z.item_raw.alias("item"), z.raw.alias("doc")),
    )
    found = found.select("doc_id", "item_id", "item_n", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), slots.alias("slots"))
    lines = found.groupBy("doc_id", "item_id", "item_n", "diagonal").agg(F.collect_set("item_at").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    same = lambda s, t: (s.kind == t.kind) & (s.item == t.item) & (s.doc == t.doc)
    lines = lines.withColumn("slots", F.transform("slots", lambda s: F.struct(*(s[c].alias(c) for c in ("place", "kind", "item", "doc")), F.size(F.filter("slots", lambda t: same(s, t))).alias("times"))))

    def beaten(s: Column) -> Column:
        """Whether a commoner pair of values, or as common a pair that comes first, shares one value only."""
        other = lambda t: (s.kind == t.kind) & ((s.item == t.item) != (s.doc == t.doc))
        ahead = lambda t: (t.times > s.times) | ((t.times == s.times) & (F.struct(t.doc, t.item) < F.struct(s.doc, s.item)))
        return F.exists("slots", lambda t: other(t) & ahead(t))

    lines = lines.withColumn("odd", F.transform(F.filter("slots", beaten), lambda s: s.place))
    kept = F.filter("at", lambda a: ~F.exists("odd", lambda p: (p >= a) & (p < a + window)))
    places = F.array_distinct(F.flatten(F.transform(kept, lambda a: F.sequence(a, a + (window - 1)))))
    whole = lines.select("doc_id", "item_id", "item_n", F.explode(places).alias("place")).groupBy("doc_id", "item_id", "item_n").agg(F.count_distinct("place").alias("covered"))
    return whole.withColumn("coverage", F.col("covered") / F.col("item_n")).where(F.col("coverage") >= coverage).select("doc_id", "item_id", "covered", "coverage")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_BARE = r"list_filter(list_transform(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: t <> '')"
_RAW = rf"list_filter(string_split(array_to_string(list_transform({_BARE}, lambda t: regexp_replace(t, '^{_ATTACHED}$', '\1 \2')), ' '), ' '), lambda t: t <> '')"
_FORM = rf"""list_transform(raw, lambda t: CASE WHEN lower(t) IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN '<unit>'
  WHEN lower(t) IN ({", ".join(f"'{u}'" for u in NUMBERS)}) THEN '<num>'
  WHEN regexp_matches(t, '^\p{{Lu}}(\p{{L}}.*)?$') AND t NOT IN ('A', 'I') THEN '<name>' WHEN regexp_matches(t, '^[0-9][0-9.,:/]*$') THEN '<num>' ELSE lower(t) END)"""
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, raw, {_FORM} AS form FROM (SELECT doc_id, {_RAW} AS raw FROM documents) WHERE len(raw) >= {WINDOW}),
b AS (SELECT item_id, raw, {_FORM} AS form FROM (SELECT item_id, {_RAW} AS raw FROM benchmark) WHERE len(raw) >= {WINDOW}),
dw AS (SELECT doc_id, i - 1 AS at, raw[i:i + {WINDOW - 1}] AS raw, form[i:i + {WINDOW - 1}] AS form FROM (SELECT *, unnest(range(1, len(raw) - {WINDOW - 2})) AS i FROM d)),
bw AS (SELECT item_id, n, i - 1 AS at, raw[i:i + {WINDOW - 1}] AS raw, form[i:i + {WINDOW - 1}] AS form FROM (SELECT *, len(raw) AS n, unnest(range(1, len(raw) - {WINDOW - 2})) AS i FROM b)),
found AS (SELECT doc_id, item_id, n, bw.at AS item_at, dw.at - bw.at AS diagonal, dw.raw AS raw, bw.raw AS item_raw, dw.form AS form FROM dw JOIN bw ON dw.form = bw.form),
slots AS (SELECT DISTINCT doc_id, item_id, diagonal, item_at + k - 1 AS place, form[k] AS kind, item_raw[k] AS i, raw[k] AS d FROM (SELECT *, unnest(range(1, {WINDOW + 1})) AS k FROM found) WHERE form[k] IN ('<num>', '<unit>', '<name>')),
pairs AS (SELECT doc_id, item_id, diagonal, kind, i, d, count(*) AS times FROM slots GROUP BY ALL),
beaten AS (SELECT DISTINCT p.doc_id, p.item_id, p.diagonal, p.kind, p.i, p.d FROM pairs p JOIN pairs q USING (doc_id, item_id, diagonal, kind)
  WHERE (p.i = q.i) <> (p.d = q.d) AND (q.times > p.times OR (q.times = p.times AND (q.d < p.d OR (q.d = p.d AND q.i < p.i))))),
odd AS (SELECT DISTINCT doc_id, item_id, diagonal, place FROM slots JOIN beaten USING (doc_id, item_id, diagonal, kind, i, d)),
kept AS (SELECT DISTINCT doc_id, item_id, n, diagonal, item_at FROM found f WHERE NOT EXISTS (SELECT 1 FROM odd o WHERE o.doc_id = f.doc_id AND o.item_id = f.item_id AND o.diagonal = f.diagonal AND o.place BETWEEN f.item_at AND f.item_at + {WINDOW - 1})),
places AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(item_at, item_at + {WINDOW})) AS place FROM kept)
SELECT doc_id, item_id, count(*) AS covered, count(*) / CAST(n AS DOUBLE) AS coverage FROM places GROUP BY doc_id, item_id, n HAVING count(*) / CAST(n AS DOUBLE) >= {COVERAGE}
"""
