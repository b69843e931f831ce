"""URL filtering: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models of characters are learned, from URLs that an
allow rule accepts and that a block rule rejects.  A character's probability
after a context of ORDER characters is smoothed towards that after the context
one character shorter, down to the single character and an even share; contexts
seen fewer than MIN_CONTEXT times are left out, so contexts are as long as the
counts support.  A URL's figure is the mean over its characters of the
difference of log-probabilities; it is allowed at or above a threshold that
errs least on a quarter of them, by a hash, that is kept from the models.

Only DataFrame functions are used.  Characters are folded to SYMBOLS, so a model
has at most len(SYMBOLS)**(ORDER + 1) entries at any input size, and its contexts
and shorter grams are at most len(SYMBOLS)**ORDER (about 70,000), which is what is
broadcast; a level with more entries than SENT is joined in the plain way instead.
Counts are summed before they are shuffled, and no step groups by host, so a hot
host costs nothing extra.  A URL is looked at once; its figure is joined back to
its rows, where a hot or null URL's rows are split by adaptive execution.

A null URL, or one without "://", has an empty host and path and fits no rule.
A URL without characters has the figure 0.  If either kind of URL is missing
there is no model and all figures are 0.  Ties of the figure with the threshold
are allowed.  URLs of any length are read whole.  Repeated rows, and rows of one
URL, are judged alike from one look at the URL.  An empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path prefix)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ORDER, MIN_CONTEXT, PULL = 3, 4, 2.0
#: Entries of a level that are broadcast at most, about 50 bytes each.
SENT = 200_000
#: Symbols of the models; digits share one, and all other characters share "*".
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./:-_?=&#%+~^*"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _symbols(url: Column) -> Column:
    text = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(text, r"[^a-z0./:\-_?=&#%+~]", "*")


def _grams(rows: DataFrame) -> DataFrame:
    """One row for each character: its contexts of length ORDER .. 0 with the character, as g3 .. g0."""
    padded = F.concat(F.lit("^" * ORDER), F.col("symbols"))
    rows = rows.withColumn("padded", padded).withColumn("i", F.explode(F.sequence(F.lit(ORDER + 1), F.length("padded"))))
    return rows.where(F.length("symbols") > 0).select(*[c for c in rows.columns if c not in ("padded", "i", "symbols")], *[F.substring("padded", F.col("i") - k, F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)])


def markov_models(labelled: DataFrame) -> DataFrame:
    """(k, gram, ratio): log-probability of the gram's last character after its first k under the accepted less the rejected."""
    grams = _grams(labelled.select("symbols", "accepted")).select("accepted", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gram")) for k in range(ORDER + 1)])).alias("x"))
    counts = grams.groupBy("x.k", "x.gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    counts = counts.withColumn("context", F.expr("substring(gram, 1, k)"))
    totals = counts.groupBy("k", "context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr")).where((F.col("ta") + F.col("tr") >= MIN_CONTEXT) | (F.col("k") == 0))
    level = counts.join(F.broadcast(totals), ["k", "context"])  # len(SYMBOLS)**ORDER rows at most
    share = 1.0 / len(SYMBOLS)
    model = None
    for k in range(ORDER + 1):
        here = level.where(F.col("k") == k).select("gram", "a", "r", "ta", "tr")
        if model is None:
            here = here.withColumn("pa", (F.col("a") + PULL * share) / (F.col("ta") + PULL)).withColumn("pr", (F.col("r") + PULL * share) / (F.col("tr") + PULL))
        else:
            short = last.select(F.col("gram").alias("shorter"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))
            here = here.join(F.broadcast(short), F.substring("gram", 2, k) == F.col("shorter"))
            here = here.withColumn("pa", (F.col("a") + PULL * F.col("sa")) / (F.col("ta") + PULL)).withColumn("pr", (F.col("r") + PULL * F.col("sr")) / (F.col("tr") + PULL))
        last = here.select("gram", "pa", "pr")
        part = last.select(F.lit(k).alias("k"), "gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))
        model = part if model is None else model.union(part)
    return model


def figures(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, figure): the mean difference over the characters, each by its longest known context."""
    grams = _grams(rows)
    sizes = {r["k"]: r["n"] for r in model.groupBy("k").agg(F.count("*").alias("n")).collect()}  # ORDER + 1 rows
    for k in range(ORDER + 1):
        entries = model.where(F.col("k") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        grams = grams.join(F.broadcast(entries) if sizes.get(k, 0) <= SENT else entries, f"g{k}", "left")
    best = F.coalesce(*[F.col(f"r{k}") for k in range(ORDER, -1, -1)], F.lit(0.0))
    return grams.groupBy(key).agg(F.avg(best).alias("figure"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, figure (of the model; rules override it)."""
    from .common import materialize

    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("ruled", verdict).withColumn("symbols", _symbols(F.col("url")))
    urls = pages.where("url is not null").groupBy("url").agg(F.min("symbols").alias("symbols"), F.min("ruled").alias("ruled"))
    urls = materialize(urls, "urls")
    labelled = urls.where("ruled is not null").withColumn("accepted", F.col("ruled") == "allow").withColumn("tests", F.substring(F.md5(F.col("url").cast("binary")), 1, 1) < "4")
    model = materialize(markov_models(labelled.where("not tests")), "url-models")
    found = materialize(figures(urls.select("url", "symbols"), model, "url"), "url-figures")
    kinds = labelled.where("not tests").agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    if not all(kinds):
        found = found.withColumn("figure", F.lit(0.0))
    bins = labelled.where("tests").join(found, "url").groupBy(F.round(F.col("figure") * 50).cast("int").alias("b")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).orderBy("b").collect()  # a row for each fiftieth: the figures are bounded
    cut = _threshold([(x["b"], x["a"], x["r"]) for x in bins])
    scored = pages.join(found, "url", "left").withColumn("figure", F.coalesce("figure", F.lit(0.0)))
    kind = F.coalesce("ruled", F.when(F.col("figure") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", kind.alias("verdict"), "figure")


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """Halfway between the bin from which allowing errs least, each kind weighing the same, and the one before; 0 without bins."""
    accepted, rejected = sum(a for _, a, _ in bins) or 1, sum(r for _, _, r in bins) or 1
    if not bins:
        return 0.0
    best, at, lost, kept, last = None, 0.0, 0, sum(r for _, _, r in bins), bins[0][0] - 1
    for b, a, r in bins:
        errors = lost / accepted + kept / rejected
        if best is None or errors < best:
            best, at = errors, (b + last) / 100
        lost, kept, last = lost + a, kept - r, b
    return at
