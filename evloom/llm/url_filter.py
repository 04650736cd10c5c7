"""URL filter: ratio of two smoothed variable-order character models, calibrated by length; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, materialize, owned

#: (verdict, host, path, rule as text)
RULES = [("allow", "com", "/", "com/"), ("block", "example.com", "/en/", "example.com/en/"), ("allow", "www.example.com", "/en/", "www.example.com/en/"), ("block", "net", "/es/", "net/es/"), ("block", "net", "/fr/", "net/fr/")]
#: The longest strings that the models know.
ORDER = 4
END = "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty if it is null or has no `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substr(__url, instr(__url, '://') + 3)")), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict (null where no rule fits); the longest rule wins, then the first by code point."""
    found = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(-len(text)).alias("n"), F.lit(text).alias("rule"), F.lit(v).alias("v"))) for v, h, p, text in rules]
    best = F.array_min(F.array_compact(F.array(*found)))
    return df.withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("rule_verdict", F.col("__best.v")).drop("__best")


def _positions(strings: DataFrame) -> DataFrame:
    """One row for each character: c1..c4 are the character with 0 to 3 before it, null where the text begins later."""
    i = strings.select("*", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    return i.select("*", *[F.when(F.col("i") >= k, F.expr(f"substring(s, i - {k - 1}, {k})")).alias(f"c{k}") for k in range(1, ORDER + 1)], *[F.when(F.col("i") > k, F.expr(f"substring(s, i - {k}, {k})")).alias(f"x{k}") for k in range(1, ORDER)])


def fit(labelled: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """The model from rows (s, accepted), all of them: for each string g of up to ORDER characters the smoothed probability of its last
    character after the others (pa, pb, for accepted and rejected), and the weight (ba, bb) that g, as a context, leaves to the
    next shorter context: p(c|ctx) = (n(ctx c) + smoothing * p(c|shorter ctx)) / (n(ctx) + smoothing)."""
    return _model(_counts(labelled.withColumns({"n": F.lit(1), "fold": F.lit(0)})), smoothing)


def _counts(labelled: DataFrame) -> DataFrame:
    """(g, fold, na, nb): how often each string of up to ORDER characters is in the accepted and the rejected texts of a fold; rows (s, accepted, n, fold) stand for n."""
    pos = _positions(labelled)
    grams = pos.select("accepted", "n", "fold", F.explode(F.array(*[F.col(f"c{k}") for k in range(1, ORDER + 1)])).alias("g")).filter("g is not null")
    of = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0)).cast("long")
    return materialize(grams.groupBy("g", "fold").agg(of(F.col("accepted")).alias("na"), of(~F.col("accepted")).alias("nb")), "url-grams")


def _model(counts: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """The model, as fit() has it, of the folds that counts has."""
    n = counts.groupBy("g").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    all_a, all_b, kinds = n.filter("length(g) = 1").agg(F.coalesce(F.sum("na"), F.lit(0)), F.coalesce(F.sum("nb"), F.lit(0)), F.count("*")).first()
    u = lambda c, total: (F.col(c) + 0.5) / (total + 0.5 * (kinds + 1))
    level = n.filter("length(g) = 1").select("g", u("na", all_a).alias("pa"), u("nb", all_b).alias("pb"), "na", "nb")
    out = level
    side = _side(n)
    for k in range(2, ORDER + 1):
        here = n.filter(F.length("g") == k)
        short = side(level.select(F.col("g").alias("sg"), F.col("pa").alias("spa"), F.col("pb").alias("spb")))
        ctx = side(n.filter(F.length("g") == k - 1).select(F.col("g").alias("cg"), F.col("na").alias("ca"), F.col("nb").alias("cb")))
        level = here.join(short, F.expr("substring(g, 2)") == F.col("sg")).join(ctx, F.expr(f"substring(g, 1, {k - 1})") == F.col("cg"))
        level = level.select("g", *[((F.col(f"n{c}") + smoothing * F.col(f"sp{c}")) / (F.col(f"c{c}") + smoothing)).alias(f"p{c}") for c in "ab"], "na", "nb")
        out = out.unionByName(level)
    weight = lambda c: (smoothing / (F.col(f"n{c}") + smoothing)).alias(f"b{c}")
    out = materialize(out.select("g", "pa", "pb", weight("a"), weight("b")), "url-model")
    out._evloom_floor = (0.5 / (all_a + 0.5 * (kinds + 1)), 0.5 / (all_b + 0.5 * (kinds + 1)))
    return out


def _side(model: DataFrame):
    """What a model's tables are joined by: a broadcast where they fit. A level and its contexts have no more rows than all of it."""
    return F.broadcast if fits(model) is not model else lambda t: t


def ratio(strings: DataFrame, model: DataFrame) -> DataFrame:
    """(s, llr) for distinct strings s: the log-likelihood difference per character, end included.

    Every character is a row only within a task: the models' tables are broadcast, and the sums by string are
    partly added up before the one shuffle.
    """
    pos = _positions(strings.select("s").distinct())
    side = _side(model)
    p = {c: F.lit(f) for c, f in zip("ab", model._evloom_floor, strict=True)}
    for k in range(1, ORDER + 1):
        of = model.filter(F.length("g") == k)
        pos = pos.join(side(of.select(F.col("g").alias(f"c{k}"), *[F.col(f"p{c}").alias(f"p{c}{k}") for c in "ab"])), f"c{k}", "left")
        if k > 1:
            of = model.filter(F.length("g") == k - 1)
            pos = pos.join(side(of.select(F.col("g").alias(f"x{k - 1}"), *[F.col(f"b{c}").alias(f"b{c}{k - 1}") for c in "ab"])), f"x{k - 1}", "left")
        for c in "ab":
            shorter = p[c] if k == 1 else F.coalesce(F.col(f"b{c}{k - 1}"), F.lit(1.0)) * p[c]
            p[c] = F.coalesce(F.col(f"p{c}{k}"), shorter)
    return pos.select("s", (F.log(p["a"]) - F.log(p["b"])).alias("d")).groupBy("s").agg(F.avg("d").alias("llr"))


@owned("urls")
def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, llr, threshold) for every row of df.

    verdict is the longest fitting rule's; where none fits, allow if llr >= threshold. The models count all urls with a rule's verdict, as often as they occur. The
    threshold is where both classes' ratios are equally many standard deviations away, over all these urls, each scored by models of the half that it is not in. The models read
    the whole url, query and fragment too. Null, empty and malformed urls have an empty host and path and fit no rule; a null
    url is scored as an empty text, a malformed one as it is. If a class has no
    labelled url, nothing can be learned, and such urls are allowed. Repeated urls are scored once; no row is dropped.
    """
    base = df.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"))
    host, path = host_path(F.col("__url"))
    base = apply_rules(base.select(F.col(id_col), host.alias("host"), path.alias("path"), "__url"), rules)
    # the whole url, its host in lower case
    at = F.instr("__url", "://") + 2
    url = F.when(F.instr("__url", "://") > 0, F.concat(F.substring("__url", F.lit(1), at), "host", F.substring("__url", at + F.length("host") + 1, F.length("__url")))).otherwise(F.coalesce("__url", F.lit("")))
    base = base.withColumn("s", F.concat(url, F.lit(END))).drop("__url")
    labelled = base.filter(F.col("rule").isNotNull()).groupBy("s", (F.col("rule_verdict") == "allow").alias("accepted")).agg(F.count("*").alias("n"))
    labelled = materialize(labelled.withColumn("fold", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(2)).cast("int")), "url-labelled")
    if labelled.select("accepted").distinct().count() < 2:
        return base.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"), F.lit(None).cast("double").alias("threshold"))
    counts = _counts(labelled)
    model = _model(counts)
    half = lambda f: ratio(labelled.filter(F.col("fold") == f), _model(counts.filter(F.col("fold") != f)))
    checks = half(0).unionByName(half(1)).join(labelled.select("s", "accepted"), "s")
    seen = {r.accepted: r for r in checks.groupBy("accepted").agg(F.avg("llr").alias("m"), F.coalesce(F.stddev("llr"), F.lit(0.0)).alias("d")).collect()}
    threshold = 0.0
    if len(seen) == 2:
        a, b = seen[True], seen[False]
        threshold = (a.m * (b.d + 1e-9) + b.m * (a.d + 1e-9)) / (a.d + b.d + 2e-9)
    scored = base.join(ratio(base, model), "s")
    verdict = F.coalesce("rule_verdict", F.when(F.col("llr") >= threshold, "allow").otherwise("block"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "llr", F.lit(float(threshold)).alias("threshold"))
