"""From candidate addresses to classified files: the cascade of sources (X4), the fallback
scan (X5), the deeper second pass (X12), relevant pages (C13), classes of files (C8), the
choice among extractions (X6), and what a finished job leaves and teaches (X7),
known addresses (C14) and the jobs that classified files start (X14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.catalogs import KNOWN_DOCUMENTS, PAGE_WORDS, WINDOW_ADDRESSES
from gridsmith.functions import urls
from gridsmith.operators.ranking import pick

c = F.col


def cascade(sources: list[tuple[str, DataFrame]], known: DataFrame, most: int = 80) -> DataFrame:
    """(site, url, score, source) of each site's candidates, `most` a site.

    Sources of (site, url, score) come in order of precedence: the first that names an address
    gives its score, and later ones only fill what earlier ones left free, best first. Addresses
    that `known` (url, class) calls irrelevant go, unclassified ones lose 30 points."""
    all_ = None
    for i, (name, df) in enumerate(sources):
        one = df.select("site", "url", c("score").cast("double").alias("score"), F.lit(name).alias("source"), F.lit(i).alias("_i"))
        all_ = one if all_ is None else all_.unionByName(one)
    first = all_.groupBy("site", "url").agg(F.min(F.struct("_i", (-c("score")).alias("s"), "source")).alias("b"))
    judged = first.join(known.groupBy("url").agg(F.max("class").alias("class")), "url", "left").filter("class is null or class != 'irrelevant'")
    rows = judged.select("site", "url", (-c("b.s") - F.when(c("class") == "unclassified", 30).otherwise(0)).alias("score"), "b.source", c("b._i").alias("_i"), c("b.s").alias("_s"))
    return pick(rows, ["site"], [c("_i"), c("_s"), c("url")], most).select("site", "url", "score", "source")


def with_scan(found: DataFrame, pages: DataFrame, top: int = 10, least: float = 30, bonus: float = 50, most: int = 20) -> DataFrame:
    """(site, url, score), `most` a site: documents found (site, url, score) and, for sites
    whose `top` best name no time windows in their addresses, pages (site, url, points) that
    have more than `least` points, with a bonus. Sites without documents get none."""
    named = F.greatest(*[F.lower("url").contains(w) for w in WINDOW_ADDRESSES])
    best = pick(found, ["site"], [c("score").desc(), c("url")], top)
    bare = best.groupBy("site").agg(F.bool_or(named).alias("named")).filter("not named").select("site")
    more = pages.filter(c("points") > least).join(bare, "site", "left_semi").select("site", "url", (c("points") + bonus).alias("score"))
    return pick(found.select("site", "url", c("score").cast("double").alias("score")).unionByName(more), ["site"], [c("score").desc(), c("url")], most)


def deepened(pages: DataFrame, passes: tuple[tuple[int, int], tuple[int, int]] = ((3, 50), (5, 150))) -> DataFrame:
    """(job, url, crawl_pass): pages of (job, url, depth, classified) that the last pass of
    a job looked at. The first goes to a depth and number of pages; only if it classifies
    nothing, a second goes further and leaves out what the first has seen."""
    (d1, n1), (d2, n2) = passes
    order = [c("depth"), c("url")]
    near = pages.filter(c("depth") <= d2).withColumn("k", F.row_number().over(Window.partitionBy("job").orderBy(*order))).filter(c("k") <= max(n1, n2))
    first = (c("depth") <= d1) & (c("k") <= n1)
    told = near.withColumn("one", first).withColumn("done", F.bool_or(c("one") & c("classified")).over(Window.partitionBy("job")))  # n2 rows a job at most
    return told.filter(F.when(c("done"), c("one")).otherwise(~c("one") & (c("k") <= n2))).select("job", "url", F.when(c("done"), 1).otherwise(2).alias("crawl_pass"))


def relevant_pages(pages: DataFrame, doc: str, text: str, words: list[str] = PAGE_WORDS, least: int = 3) -> DataFrame:
    """Pages with any of the words; documents of fewer than `least` pages, and those without
    such a page, stay whole. Documents are counted before they are joined."""
    hit = F.coalesce(F.greatest(*[F.lower(text).contains(w) for w in words]), F.lit(False))
    marked = pages.withColumn("_hit", hit)
    cuttable = marked.groupBy(doc).agg(F.count("*").alias("_n"), F.bool_or("_hit").alias("_any")).filter((c("_n") >= least) & c("_any")).select(doc, F.lit(True).alias("_cut"))
    return marked.join(cuttable, doc, "left").filter(c("_hit") | c("_cut").isNull()).drop("_hit", "_cut")


def classified(files: DataFrame, year: int) -> DataFrame:
    """(job, path, class) of (job, path, format, year, n_prices, n_hours, said_prices,
    said_hours): a file counts for a kind with two records, or with none if its words say so.
    Of each job, kind and year the file with most records wins, PDF first; one that wins both
    kinds of a year keeps that with more records, or prices. Losers are unclassified, files
    without any record or word irrelevant. Counting for neither and having one record is
    unclassified too. Of wins under several years, time windows name the file."""
    of = lambda n, said: F.when(c(n) >= 2, c(n)).when(c(said), 0)
    when = lambda y: F.when(y != year, y)
    kinds = F.array(
        F.struct(F.lit("netzentgelte").alias("kind"), of("n_prices", "said_prices").alias("n"), when(c("year")).alias("y")),
        F.struct(F.lit("hlzf").alias("kind"), of("n_hours", "said_hours").alias("n"), F.when(c("n_hours") <= 0, when(c("year"))).alias("y")),
    )
    pdf = F.when(c("format") == "pdf", 1).otherwise(0)
    could = files.select("job", "path", pdf.alias("pdf"), F.explode(kinds).alias("x")).select("job", "path", "pdf", "x.*").filter("n is not null")
    top = F.struct(c("n"), c("pdf"), c("path"))
    # of equal files the first path, as a maximum can't have it: least of (-n, -pdf, path)
    low = F.struct((-top["n"]).alias("n"), (-top["pdf"]).alias("pdf"), top["path"].alias("path"))
    best = could.groupBy("job", "y").agg(*[F.min(F.when(c("kind") == k, low)).alias(k) for k in ("netzentgelte", "hlzf")])
    same = F.coalesce(c("netzentgelte.path") == c("hlzf.path"), F.lit(False))
    hours_win = c("hlzf.n") < c("netzentgelte.n")  # negated numbers
    won = best.select("job", F.explode(F.array(F.struct(F.when(~same | ~hours_win, c("netzentgelte.path")).alias("path"), F.lit("netzentgelte").alias("kind")), F.struct(F.when(~same | hours_win, c("hlzf.path")).alias("path"), F.lit("hlzf").alias("kind")))).alias("w"))
    named = won.select("job", "w.path", "w.kind").filter("path is not null").groupBy("job", "path").agg(F.min("kind").alias("kind"))
    nothing = (c("n_prices") <= 0) & (c("n_hours") <= 0) & ~c("said_prices") & ~c("said_hours")
    return files.join(named, ["job", "path"], "left").select("job", "path", F.coalesce("kind", F.when(nothing, "irrelevant").otherwise("unclassified")).alias("class"))


def chosen(own: DataFrame, other: DataFrame, least: int = 2) -> DataFrame:
    """(file, method, n, flagged) of the records (file, valid) that patterns and a fallback
    extracted. Extractions are sane with `least` records, of which as many are valid. Sane ones
    by patterns stand; else the fallback's are taken if there are any, else those by patterns
    after all. What is taken without being sane is flagged for review."""
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name), F.count_if("valid").alias(f"{name}_valid"))
    both = count(own, "own").join(count(other, "other"), "file", "full")
    sane = lambda name: F.coalesce(c(f"{name}_valid") >= least, F.lit(False))
    fall = ~sane("own") & c("other").isNotNull()
    return both.select("file", F.when(fall, "fallback").otherwise("patterns").alias("method"), F.when(fall, c("other")).otherwise(c("own")).alias("n"), F.when(fall, ~sane("other")).otherwise(~sane("own")).alias("flagged"))


def finalized(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """(job, url, via, n, saved, flagged) of jobs (job, url, via): records (job, error,
    warning) are saved if there are any and none has an error, and flagged if one has a warning."""
    seen = records.groupBy("job").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("error", F.lit(False))).alias("e"), F.bool_or(F.coalesce("warning", F.lit(False))).alias("w"))
    saved = F.coalesce(~c("e"), F.lit(False))
    return jobs.select("job", "url", "via").join(seen, "job", "left").select("job", "url", "via", F.when(saved, c("n")).otherwise(0).alias("n"), saved.alias("saved"), (saved & c("w")).alias("flagged"))


def learned(done: DataFrame) -> DataFrame:
    """(pattern, success, fail): each path pattern of a saved job's address succeeded, the
    pattern by which an unsaved job was found failed."""
    good = done.filter("saved").select(F.explode(urls.path_patterns(c("url"))).alias("pattern"), F.lit(True).alias("ok"))
    bad = done.filter("not saved and via is not null").select(c("via").alias("pattern"), F.lit(False).alias("ok"))
    return good.unionByName(bad).groupBy("pattern").agg(F.count_if("ok").alias("success"), F.count_if(~c("ok")).alias("fail"))


def known_documents(asked: DataFrame, name: str, kind: str, year: str) -> DataFrame:
    """C14: the rows with the `address` of a company's document if it is known; null else."""
    known = asked.sparkSession.createDataFrame(KNOWN_DOCUMENTS, "_n string, _k string, _y int, address string")  # a fixed list
    on = (F.lower(F.trim(F.col(name))) == c("_n")) & (F.col(kind) == c("_k")) & (F.col(year) == c("_y"))
    return asked.join(F.broadcast(known), on, "left").drop("_n", "_k", "_y")


def extract_jobs(jobs: DataFrame) -> DataFrame:
    """A job for each classified file of (job, operator, year, priority, context, files), where files maps a kind to
    (path, format, source_url): parent, operator, year, priority, kind, step and context, in which the file is named too. Kinds
    as kind:year are of other years: those files are kept and not extracted. A job has a few files."""
    one = jobs.select("job", "operator", "year", "priority", "context", F.explode("files").alias("kind", "file")).filter(~c("kind").contains(":"))
    more = F.create_map(F.lit("downloaded_file"), c("file.path"), F.lit("file_to_process"), c("file.path"), F.lit("file_format"), c("file.format"), F.lit("strategy"), F.lit("classified"), F.lit("source_url"), c("file.source_url"), F.lit("found_url"), c("file.source_url"))
    own = F.map_filter(F.coalesce("context", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return one.select(c("job").alias("parent"), "operator", "year", "priority", "kind", F.lit("extract").alias("job_type"), F.lit("Queued for extraction").alias("step"), F.map_concat(own, more).alias("context"))
