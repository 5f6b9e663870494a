"""License scans: sparse TF-IDF cosine to templates, then inheritance.

A page's words are the runs of ASCII letters and digits, in lower case, of its
whole html without tags and entities; so line feeds, comment marks and markup
inside a notice part nothing. Templates are headings and notices, whole texts
of short licences and the openings of long ones. A template is compared with
the page's windows of as many words: each that has the template's key word in
the template's own place for it (clipped at the page's ends). Vectors weigh a
word by tf * idf, idf = 1 + ln((1 + N) / (1 + df)), with N pages of which df
have the word, over all pages and for every word, in a template or not. A page
declares the template of its most similar window if that cosine reaches the
threshold; ties go to the first licence by name.

A directory's licence is that of its licence files (pages named license,
licence, copying or notice), else the one that most of its own pages declare;
ties go to the first name. A url that ends in a slash or has only a host is the
index page of that very directory. A page that declares nothing inherits from
its own or its nearest ancestor directory that has a licence.

Everything is DataFrame operations. Pages are cut into words once, and written.
Windows meet the weights of template words first, and words beyond them with
the least weight there is: those that cannot reach the threshold even so need
no look-up of other words.

Null and empty texts declare nothing. A null url has no path: the page neither
inherits nor gives. Every row is a page of its own, repeated ones too. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import discard, finished, materialize
from arterial.llm.templates import TEMPLATES

THRESHOLD = 0.8
#: What parts words: tags, entities, other signs. (A < that opens no tag is a sign.)
SEPARATOR = r"</?[a-z][^<>]*>|&#?[a-z0-9]{1,10};|[^a-z0-9<&]+|[<&]"
#: Words of a page among which keys are looked for at a time.
STRETCH = 2_000
LONGEST = max(len(t.words) for t in TEMPLATES)
KEYS = sorted({t.key for t in TEMPLATES})
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})


def page_words(html: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(html, F.lit(""))), SEPARATOR), lambda w: w != "")


def page_path(url: Column) -> Column:
    """Host and path, without scheme, query and fragment; a lone host ends in a
    slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.when(bare.contains("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def _idf(n: int, df: Column | int) -> Column:
    return F.lit(1.0) + F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + df))


def windows(cut: DataFrame) -> DataFrame:
    """row, t, start, word, tf of the windows of pages (row, words) that are
    laid against the templates by their keys."""
    spark = cut.sparkSession
    some = cut.filter(F.arrays_overlap("words", F.array(*map(F.lit, KEYS)))).select("row", "words")
    # stretches of bounded length, with the words around them that windows reach into
    first = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH))
    begin = lambda at: F.greatest(at - LONGEST, F.lit(0))
    parts = some.select(
        "row", F.explode(F.transform(first, lambda at: F.struct(at.alias("at"), begin(at).alias("begin"), F.slice("words", begin(at) + 1, at - begin(at) + F.lit(STRETCH + LONGEST)).alias("words")))).alias("p")
    ).select("row", "p.*")
    marked = F.transform("words", lambda w, i: F.when(w.isin(KEYS), F.struct(i.alias("i"), w.alias("key"))))
    own = lambda m: m.isNotNull() & (m["i"] + F.col("begin") >= F.col("at")) & (m["i"] + F.col("begin") < F.col("at") + STRETCH)
    hits = parts.select("row", "begin", "words", F.explode(F.filter(marked, own)).alias("hit")).select("row", "begin", "words", "hit.i", "hit.key")
    # one row a template
    plans = F.broadcast(spark.createDataFrame([(n, t.key, t.place, len(t.words)) for n, t in enumerate(TEMPLATES)], "t int, key string, place int, length int"))
    laid = hits.join(plans, "key").withColumn("from", F.col("i") - F.col("place"))
    span = F.slice("words", F.greatest("from", F.lit(0)) + 1, F.col("length") + F.least("from", F.lit(0)))
    each = laid.select("row", "t", (F.col("from") + F.col("begin")).alias("start"), F.explode(span).alias("word"))
    return each.groupBy("row", "t", "start", "word").agg(F.count(F.lit(1)).alias("tf"))


def declared(pages: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[DataFrame]]:
    """row, page_id, url, license, score of every row of pages: the template of
    the most similar window, or nulls; and the tables that this is read from."""
    spark = pages.sparkSession
    cut = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", page_words(F.col("html")).alias("words"))
    cut = materialize(cut, "page-words")
    n = cut.count()
    df = materialize(cut.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "page-frequencies")
    # as many rows as templates have words come to the driver
    seen = {r.word: r.df for r in df.filter(F.col("word").isin(VOCABULARY)).collect()}
    idf = {w: 1 + math.log((1 + n) / (1 + seen.get(w, 0))) for w in VOCABULARY}
    weight = [{w: k * idf[w] for w, k in Counter(t.words).items()} for t in TEMPLATES]
    length = [math.sqrt(sum(x * x for x in w.values())) for w in weight]
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    # a template's weights over its length: dot products with them are cosines but for the window's length
    unit = F.broadcast(spark.createDataFrame([(i, w, x / length[i]) for i, own in enumerate(weight) for w, x in own.items()], "t int, word string, unit double"))

    laid = materialize(windows(cut), "windows")
    weighed = laid.join(known, "word", "left").join(unit, ["t", "word"], "left")
    own = F.col("tf") * F.col("idf")
    sums = weighed.groupBy("row", "t", "start").agg(
        F.sum(F.coalesce(own * F.col("unit"), F.lit(0.0))).alias("dot"),
        F.sum(F.coalesce(own * own, F.lit(0.0))).alias("square"),
        F.sum(F.when(F.col("idf").isNull(), F.col("tf")).otherwise(0)).alias("others"),
    )
    # a word weighs 1 at least; a hair below the threshold, for scores are rounded
    able = materialize(sums.filter(F.col("dot") >= (threshold - 1e-5) * F.sqrt(F.col("square") + F.col("others"))), "able-windows")
    beyond = laid.join(known, "word", "left_anti").join(able.filter("others > 0").select("row", "t", "start"), ["row", "t", "start"])
    more = beyond.join(df, "word").groupBy("row", "t", "start").agg(F.sum(F.pow(F.col("tf") * _idf(n, F.col("df")), 2)).alias("rest"))
    score = F.round(F.col("dot") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), 6)
    scored = able.join(more, ["row", "t", "start"], "left").select("row", "t", score.alias("score")).filter(F.col("score") >= threshold)
    names = F.broadcast(spark.createDataFrame([(i, t.license) for i, t in enumerate(TEMPLATES)], "t int, license string"))
    best = scored.join(names, "t").groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    best = materialize(best.select("row", "b.license", (-F.col("b.minus")).alias("score")), "best-windows")
    discard(laid, able, df)
    return cut.select("row", "page_id", "url").join(best, "row", "left"), [cut, best]


def directory_licenses(files: DataFrame) -> DataFrame:
    """dir, dir_license from files (path, license): licence files first, then
    most declarations, then the first name."""
    named = F.lower(F.regexp_extract("path", r"[^/]*$", 0)).rlike(r"^(licen[cs]e|copying|notice)(\.|$)")
    each = files.filter("license is not null and path is not null").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "license", named.alias("file"))
    votes = each.groupBy("dir", "license").agg(F.max("file").alias("file"), F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((~F.col("file")).alias("no_file"), (-F.col("n")).alias("minus"), "license")).alias("b")
    return votes.groupBy("dir").agg(best).select("dir", F.col("b.license").alias("dir_license"))


def scan(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, path, license, score, inherited, inherited_from."""
    found, tables = declared(pages, threshold)
    files = finished(found.withColumn("path", page_path(F.col("url"))), "declared", *tables)
    licences = materialize(directory_licenses(files), "directories")
    # every distinct directory looks its ancestors up once; pages then meet their own directory's answer
    home = F.regexp_replace("path", "/[^/]*$", "")
    bare = files.filter("license is null and path is not null").select(home.alias("home")).distinct()
    parts = F.split("home", "/")
    own = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))
    ways = bare.select("home", F.posexplode(own).alias("up", "dir"))
    near = ways.join(licences, "dir").groupBy("home").agg(F.min(F.struct("up", "dir", "dir_license")).alias("b"))
    answers = materialize(near.select("home", F.col("b.dir").alias("from_dir"), F.col("b.dir_license").alias("dir_license")), "inherited")
    keyed = files.withColumn("home", F.when(F.col("license").isNull(), home))
    out = keyed.join(answers, "home", "left").select("page_id", "path", "license", "score", F.col("dir_license").alias("inherited"), F.col("from_dir").alias("inherited_from"))
    return finished(out, "license-scan", files, licences, answers)
