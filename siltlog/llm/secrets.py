"""Secret detection with DataFrame functions only: fixed patterns, and a battery of randomness tests."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# The kinds of secrets, their patterns (matched from left to right, without overlaps) and the least
# length of the group that is named.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
#: Runs of base64 characters that the battery looks at.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets that an encoding is inferred from: the first that has all characters of a run.
ENCODINGS = {
    r"^[0-9a-f]+$": DIGITS + LOWER[:6],
    r"^[0-9A-F]+$": DIGITS + UPPER[:6],
    r"^[A-Z2-7]+$": UPPER + "234567",
    r"^[0-9a-z]+$": DIGITS + LOWER,
    r"^[0-9A-Z]+$": DIGITS + UPPER,
    r"^[0-9A-Za-z]+$": DIGITS + UPPER + LOWER,
    r"^[0-9A-Za-z+/]+$": DIGITS + UPPER + LOWER + "+/",
    r"^[0-9A-Za-z_-]+$": DIGITS + UPPER + LOWER + "-_",
}
#: The alphabet of runs that none of these has.
OTHER = DIGITS + UPPER + LOWER + "+/-_="
#: Longest run whose characters' uniformity is tested exactly; beyond, chi-squared by Wilson and Hilferty's normal form.
EXACT = 64
#: Least exact p-value, in bits.
LEAST_BITS = 100.0
#: Share of random strings, at most, that the tests may wrongly call not random, by length.
FALSE_DISCOVERY = 0.01
#: Quarter bits of a p-value that are told apart.
BINS = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, also where body uses it inside of another lambda."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(lengths: Column) -> Column:
    """The sum of all earlier elements, for each; in n ** 1.5 steps."""

    def of(x: Column) -> Column:
        n, step = F.size(x), F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil((n - 1) / step).cast("int")), lambda b: total(F.slice(x, b * step + 1, step)))

        def spread(s: Column) -> Column:
            return F.transform(
                s["x"],
                lambda _, i: s["before"][F.floor(i / s["step"]).cast("int")] + total(F.slice(s["x"], F.floor(i / s["step"]).cast("int") * s["step"] + 1, i % s["step"])),
            )

        before = let(blocks, lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))))
        return let(F.struct(x.alias("x"), before.alias("before"), step.alias("step")), spread)

    return F.when(F.size(lengths) > 0, let(lengths, of)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right with their places: array of struct(start, end, found), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def places(x: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def shift(s: Column) -> Column:
            ahead = sums_before(F.transform(s["x"], lambda m, i: (F.length(m) + F.length(s["gaps"][i])).cast("long")))
            return let(
                F.struct(ahead.alias("ahead"), s["x"].alias("x"), s["gaps"].alias("gaps")),
                lambda t: F.transform(
                    t["x"],
                    lambda m, i: F.struct(
                        (t["ahead"][i] + F.length(t["gaps"][i])).alias("start"),
                        (t["ahead"][i] + F.length(t["gaps"][i]) + F.length(m)).alias("end"),
                        m.alias("found"),
                    ),
                ),
            )

        return let(F.struct(x.alias("x"), gaps.alias("gaps")), shift)

    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return let(found, lambda x: F.when(F.size(x) > 0, places(x)).otherwise(none))


def log_upper(z: Column) -> Column:
    """Natural logarithm of the upper tail of the standard normal distribution, within 2 % of the tail at any z: Boyd's bound of Mills' ratio."""
    x = F.abs(z)
    tail = -x * x / 2 - math.log(2 * math.pi) / 2 + F.log(math.pi / ((math.pi - 1) * x + F.sqrt(x * x + 2 * math.pi)))
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))


def _log_two_sided(z: Column) -> Column:
    return F.least(F.lit(0.0), math.log(2) + log_upper(F.abs(z)))


@cache
def pair_tails(letters: int, most: int = EXACT) -> list[list[float]]:
    """For runs of 0 to `most` characters drawn evenly from so many letters: minus log2 of the chance of at least 0, 1, 2... pairs of equal characters.

    Letter by letter, the chances of (characters placed, pairs so far) are carried
    along: a letter that is met j times makes j * (j - 1) / 2 pairs.
    """
    least = 2.0**-LEAST_BITS
    pairs = min(most * (most - 1) // 2, int(6 * most * most / letters) + 12 * most // 10 + 400)
    state = np.zeros((most + 1, pairs + 1))  # chances times letters ** placed / placed!
    state[0, 0] = 1.0
    weight = [1.0 / math.factorial(j) for j in range(most + 1)]
    for _ in range(letters):
        new = state.copy()
        for j in range(1, most + 1):
            more = j * (j - 1) // 2
            if more > pairs:
                break
            new[j:, more:] += weight[j] * state[: most + 1 - j, : pairs + 1 - more]
        state = new
    out = []
    for n in range(most + 1):
        chances = state[n] * (math.factorial(n) / float(letters) ** n)
        tails = np.cumsum(chances[::-1])[::-1]
        tails = tails[: int((tails >= least).sum())]
        out.append([max(0.0, round(-math.log2(t), 3)) for t in tails])
    return out


def _log_uniform(v: Column, size: Column) -> Column:
    """Logarithm of the p-value of "all letters are drawn evenly" against some being met too often: by the sum of squared counts."""
    n = F.size(v)
    squares = F.aggregate(F.array_distinct(v), F.lit(0).cast("long"), lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)), 2).cast("long"))
    chi, df = squares * size / n - n, size - 1
    spread = 2 / (9 * df)
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread)
    sizes = sorted({len(x) for x in [*ENCODINGS.values(), OTHER]})
    tables = F.from_json(F.lit(json.dumps([pair_tails(x) for x in sizes])), "array<array<array<double>>>")  # a constant: folded once
    which = F.create_map(*[F.lit(x) for i, k in enumerate(sizes) for x in (k, i)])[size]
    bits = F.get(F.get(F.get(tables, which), n), ((squares - n) / 2).cast("int"))
    return F.when(n <= EXACT, -F.coalesce(bits, F.lit(LEAST_BITS)) * math.log(2)).otherwise(log_upper(z))


def randomness(found: Column) -> Column:
    """Natural logarithm of the p-value of "each character is drawn from its encoding's alphabet at random"; null for runs without both letters and digits.

    Three tests: chi-squared for uniform use of the alphabet (exact for up to EXACT
    characters, whose expected counts are small), the number of runs above and below the alphabet's
    middle, and correlation of neighbours. The least p-value counts three times.
    """
    bare = F.regexp_replace(found, "=+$", "")
    alphabet = F.lit(OTHER)
    for pattern, letters in reversed(ENCODINGS.items()):
        alphabet = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def battery(s: Column) -> Column:
        n, size, v = F.size(s["v"]), F.length(s["alphabet"]), s["v"]
        high = F.size(F.filter(v, lambda y: y * 2 >= size)).cast("double")
        runs = 1 + F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: (v[i] * 2 >= size) != (v[i - 1] * 2 >= size)))
        mean_runs = 2 * high * (n - high) / n + 1
        z_runs = F.when((high > 0) & (high < n) & (mean_runs > 2), (runs - mean_runs) / F.sqrt((mean_runs - 1) * (mean_runs - 2) / (n - 1))).otherwise(F.sqrt(n))
        return let(
            F.struct((total(v) / n).alias("mean"), _log_uniform(v, size).alias("chi"), z_runs.alias("runs")),
            lambda t: F.least(
                F.lit(0.0),
                math.log(3) + F.least(t["chi"], _log_two_sided(t["runs"]), _log_two_sided(_correlation(v, n, t["mean"]) * F.sqrt(n))),
            ),
        )

    values = let(
        F.struct(bare.alias("bare"), alphabet.alias("alphabet")),
        lambda s: F.struct(
            s["alphabet"].alias("alphabet"),
            F.transform(F.split(s["bare"], ""), lambda c: (F.position(c, s["alphabet"]) - 1).cast("long")).alias("v"),
        ),
    )
    mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]") & (F.length(bare) >= 16)
    return F.when(mixed, let(values, battery))


def _correlation(v: Column, n: Column, mean: Column) -> Column:
    spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    joint = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + (v[i] - mean) * (v[i - 1] - mean))
    return F.when(spread > 0, joint / spread).otherwise(F.lit(1.0))


def _stratum(span: Column) -> Column:
    return F.floor(F.log2((span["end"] - span["start"]).cast("double"))).cast("int")


def _cutoffs(tests: DataFrame) -> Column:
    """Benjamini and Hochberg's procedure within each length class: a map from the class to the first bin of p-values that are rejected.

    The p-values are counted by class and bin first; at most 64 classes with one number each reach the driver.
    """
    bins = tests.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("bin"), "n")))  # at most BINS + 1
    by_class = bins.groupBy("stratum").agg(entries.alias("e"), F.sum("n").alias("m"))
    passed = by_class.select(
        "stratum",
        F.explode(F.transform("e", lambda x, i: F.struct((-x["bin"]).alias("bin"), total(F.transform(F.slice("e", F.lit(1), i + 1), lambda y: y["n"])).alias("k")))).alias("x"),
        "m",
    ).filter(F.pow(F.lit(2.0), -F.col("x.bin") / 4) <= FALSE_DISCOVERY * F.col("x.k") / F.col("m"))
    rows = passed.groupBy("stratum").agg(F.min("x.bin").alias("bin")).collect()
    flat = [F.lit(x) for r in rows for x in (r["stratum"], r["bin"])]
    return F.create_map(*flat) if flat else F.create_map().cast("map<int,int>")


def find_secrets(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row of docs: the id and spans, an array of struct(start, kind, end) by start and kind.

    start and end are code points, end exclusive; kind is an index of KINDS. The first three kinds
    are the matches of ASSIGN (with a value of ASSIGN_VALUE characters or
    more), ACCESS and HEX. The fourth are the runs of base64 characters, with letters
    and digits, that pass for random in the encoding they are inferred to have:
    randomness() gives each a p-value, and the procedure of Benjamini and
    Hochberg, over all runs of the table with about the same length, rejects
    those that are not random, so that no more than FALSE_DISCOVERY of the
    rejected are random. That bounds the secrets that are missed; how many of the
    reported are no secrets is not bounded, as any run that passes for random is reported. Runs may overlap other spans.

    A null text has no spans, nor has an empty one. Equal rows and rows with
    null ids are treated like others; other columns aren't read.
    """
    read = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    text = F.col("text")

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_VALUE)
    fixed = F.concat(spans(assign, 0), spans(matches(text, ACCESS), 1), spans(matches(text, HEX), 2))

    def tested(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), _stratum(x).alias("stratum"), randomness(x["found"]).alias("p"))

    runs = F.filter(F.transform(matches(text, RUN), tested), lambda x: x["p"].isNotNull())
    runs = F.transform(
        runs,
        lambda x: F.struct(x["start"], x["end"], x["stratum"], F.least(F.floor(x["p"] * (-4 / math.log(2))), F.lit(BINS)).cast("int").alias("bin")),
    )
    found = cut(read.select("id", fixed.alias("fixed"), runs.alias("runs")))
    tests = found.filter(F.size("runs") > 0).select(F.explode("runs").alias("x")).select("x.stratum", "x.bin")
    cutoff = _cutoffs(tests)
    random = F.filter("runs", lambda x: F.coalesce(x["bin"] < cutoff[x["stratum"]], F.lit(True)))
    return found.select(F.col("id").alias(id_column), F.array_sort(F.concat("fixed", spans(random, 3))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def _count(kind: int) -> Column:
    # one parameter only: Spark gives a second one the element's index, whatever its default is
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    counts = [_count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    base = F.sha2(_joined(F.filter("spans", lambda x: x["kind"] < 3)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
