"""Secret scan: fixed patterns, and randomness tests of long strings; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, owned
from .quality import let

#: kind: (pattern whose matches do not overlap, condition on a match m)
PATTERNS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""^((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    "access": (r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    "hex": (r"[0-9a-f]{24,}", r"^.{24,}$"),
}
KINDS = ["assign", "access", "hex", "random"]
#: What the randomness tests look at: long runs of the letters of base64 and its kin.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: encoding: its symbols; the first that holds all of a string's is inferred.
ENCODINGS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
#: Share of ordinary strings among those reported that is allowed.
FALSE_SHARE = 0.05
#: Combined p-values are counted by decade: above the first, above the second, and so on.
DECADES = (0.1, 0.01, 0.001, 0.0001)


def spans_of(text: Column, pattern: str, fits: str, kind: str) -> Column:
    """Array of (start, kind number, end) of the fitting matches, in code points: the matches and the gaps between them add up to the text."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["m"].rlike("(?s)" + fits), F.lit(False)), F.array_append(a["out"], found)).otherwise(a["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(both, start, step)["out"]).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def normal_tail(z: Column) -> Column:
    """The probability of a standard normal beyond |z|, by a rational approximation that is right to seven places."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


def _poisson_upto(c: Column, mean: Column) -> Column:
    """The probability of c events or fewer, by the cube-root approximation."""
    nu = 2 * (c + 1)
    z = (F.pow(2 * mean / nu, F.lit(1 / 3)) - 1 + 2 / (9 * nu)) / F.sqrt(2 / (9 * nu))
    return F.when(c < 0, 0.0).when(z > 0, normal_tail(z)).otherwise(1 - normal_tail(z))


def _battery(token: Column) -> Column:
    """Struct of the encoding, three p-values of a string against uniform symbols, and the one combined of them.

    chi: the chi-squared statistic of the symbols' counts, taken as the number of equal pairs, which is nearly Poisson however few symbols
    there are; runs: changes between the lower and the upper half of the alphabet (Wald-Wolfowitz, both halves equally likely);
    serial: the correlation of each symbol's place in the alphabet with the next one's. All are two-sided. p: Fisher's
    combination. The work is linear in the string.
    """
    enc = F.lit(None).cast("string")
    for name, letters in reversed(ENCODINGS.items()):
        enc = F.when(F.translate(token, letters, "") == "", name).otherwise(enc)

    def tests(name: str, letters: str) -> Column:
        size = 64 if name == "base64" else len(letters)
        n = F.length(token).cast("double")
        pairs = F.aggregate(F.array(*map(F.lit, letters)), F.lit(0.0), lambda a, c: a + let(n - F.length(F.replace(token, c, F.lit(""))), lambda k: k * (k - 1) / 2))
        mean = n * (n - 1) / (2 * size)
        chi = let(pairs, lambda c: F.least(F.lit(1.0), 2 * F.least(_poisson_upto(c, mean), 1 - _poisson_upto(c - 1, mean))))
        half = "".join("0" if i < len(letters) // 2 else "1" for i in range(len(letters)))
        share = half.count("1") / len(half)
        p = 2 * share * (1 - share)
        changed = let(F.translate(token, letters, half), lambda b: (2 * n - F.length(F.replace(b, F.lit("01"), F.lit(""))) - F.length(F.replace(b, F.lit("10"), F.lit("")))) / 2)
        runs = let((changed - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p)), lambda z: 2 * normal_tail(z))
        k = len(letters)
        middle, spread = (k + 1) / 2, (k * k - 1) / 12
        at = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(letters), c) - middle)
        both = F.aggregate(at, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last")), lambda a, x: F.struct((a["sum"] + a["last"] * x).alias("sum"), x.cast("double").alias("last")))["sum"]
        serial = let(both / (spread * F.sqrt(n - 1)), lambda z: 2 * normal_tail(z))
        logs = lambda t: -sum(F.log(F.greatest(t[x], F.lit(1e-300))) for x in ("chi", "runs", "serial"))
        three = F.struct(F.lit(name).alias("encoding"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))
        return let(three, lambda t: let(logs(t), lambda x: F.struct(t["encoding"].alias("encoding"), t["chi"].alias("chi"), t["runs"].alias("runs"), t["serial"].alias("serial"), (F.exp(-x) * (1 + x + x * x / 2)).alias("p"))))

    out = F.lit(None).cast("struct<encoding:string,chi:double,runs:double,serial:double,p:double>")
    for name, letters in ENCODINGS.items():
        out = F.when(enc == name, tests(name, letters)).otherwise(out)
    return out


def thresholds(classes: list[dict]) -> dict[str, float]:
    """class: the lowest p-value that is reported; classes without one are left out.

    A class has the numbers of strings whose p-value lies in each of DECADES. Random strings have evenly spread p-values, so the
    highest decade bounds their number; what is beyond their share, and two of its standard deviations, in the third and fourth decade is
    ordinary, and its
    fall from the fourth to the third is carried on to the second and first. A decade is reported while the ordinary
    strings expected at or above it are within FALSE_SHARE of the strings found there.
    """
    out = {}
    for row in classes:
        found = [row[f"d{k}"] for k in range(len(DECADES))]
        random = found[0] / (1 - DECADES[0])
        share = [random * (DECADES[k - 1] - DECADES[k]) for k in (2, 3)]
        third, fourth = (max(0.0, found[k] - x - 2 * math.sqrt(x)) for k, x in zip((2, 3), share, strict=True))
        fall = min(1.0, third / fourth) if fourth else 1.0
        ordinary = [third * fall * fall, third * fall]
        for k in (0, 1):
            if found[0] and sum(ordinary[: k + 1]) <= FALSE_SHARE * sum(found[: k + 1]):
                out[row["class"]] = DECADES[k]
    return out


@owned("secrets")
def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of df.

    The patterns' spans always stay. The method adds `random` spans: strings of CANDIDATE, 20 to any number of characters, that
    overlap none of the patterns' and whose battery does not tell them from uniform symbols of the inferred encoding. How much that
    says depends on the length: a short word of few kinds of letters may pass. So strings are classed by encoding and length
    (powers of two), each class has its own threshold, set by all its strings of all documents, and strings are
    reported by their own p-value; see thresholds(). The classes' table, with a bounded number of rows, is all that goes to the driver.

    A null text is empty and has no spans (the digest of an empty string). Whole texts are scanned; equal rows get equal results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col), text.alias("__t"))
    found = {k: spans_of(F.col("__t"), p, fits, k) for k, (p, fits) in PATTERNS.items()}
    rows = base.select(id_col, "__t", *[v.alias(f"__{k}") for k, v in found.items()], spans_of(F.col("__t"), CANDIDATE, "^.{20,}$", "random").alias("__r"))
    # each candidate beside its tests; a handful for a document
    length = lambda x: x["end"] - x["start"]
    tested = F.transform("__r", lambda x: F.struct(x.alias("span"), _battery(F.substring(F.col("__t"), x["start"] + 1, length(x))).alias("z")))
    rows = materialize(rows.select(id_col, "__assign", "__access", "__hex", tested.alias("__x")), "secret-candidates")
    klass = lambda x: F.concat_ws("/", x["z"]["encoding"], F.floor(F.log2(length(x["span"]).cast("double"))).cast("int").cast("string"))
    each = rows.select(F.explode("__x").alias("x")).select(klass(F.col("x")).alias("class"), F.col("x.z.p").alias("p"))
    edges = (float("inf"), *DECADES)
    counts = [F.sum(((F.col("p") > low) & (F.col("p") <= high)).cast("long")).alias(f"d{k}") for k, (high, low) in enumerate(zip(edges, DECADES, strict=False))]
    limits = thresholds([r.asDict() for r in each.groupBy("class").agg(*counts).collect()])
    base_spans = F.array_sort(F.concat("__assign", "__access", "__hex"))
    apart = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"]))
    lows = F.create_map(*[F.lit(v) for kv in sorted(limits.items()) for v in kv]) if limits else None
    rows = rows.withColumn("__base", base_spans)
    random = F.transform(F.filter("__x", lambda x: F.coalesce(x["z"]["p"] > lows[klass(x)], F.lit(False)) & apart(x)), lambda x: x["span"]) if limits else F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select(id_col, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("__base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"))
