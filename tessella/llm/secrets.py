"""Secrets: fixed formats, and a battery of randomness tests on them and on what else looks like a key.

All work on rows is done by built-in functions. Base spans (assign, access, hex) are found by format alone
and always stay. Further candidates are runs of key characters. From each of both its encoding is inferred,
and three two-sided tests ask whether it could be a random string of that encoding:

* uniformity of the alphabet: chi-squared, which for one length and alphabet is a count of pairs of equal
  characters. Its tails are exact up to EXACT characters, from the counts' generating function, and
  those of a chi-squared variable beyond.
* runs of one class of characters (digits, capitals, small letters, others).
* serial correlation of neighbours' places in the alphabet.

Their p-values are combined by Fisher's rule. A candidate is taken for a secret unless randomness is
rejected; a base span of which it is rejected, or that has no encoding, is called doubtful. False
discoveries are controlled both ways within strata of length, as the tests' power depends on it: of the
strings rejected in a stratum about FALSE_REJECTIONS are random, and of those that pass about FALSE_SECRETS are
not, as far as MOST_LOST allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import native as N
from tessella.llm.scratch import stored

#: Java knows no letters but ASCII's for the part in (?i:...).
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

#: On shorter strings the tests tell compound words with digits from keys too seldom: of 16 to 19 characters, two in three that passed were keys, among as many of either.
LEAST_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}={{0,2}}"
CANDIDATE_HINT = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH}}}"
#: Lengths from which a new stratum begins, and the share of random strings among those rejected in one.
STRATA = (20, 28, 40, 64, 128)
FALSE_REJECTIONS = 0.05
#: Share of other strings among those that pass in a stratum, and the most p that is asked for to come down to it.
FALSE_SECRETS, MOST_LOST = 0.1, 0.2
#: p-values are counted in steps of a twentieth of a power of ten, down to 1e-20.
STEPS, DEEPEST = 20, 400
#: Longest string whose uniformity has exact tails.
EXACT = 64

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: name, form, alphabet. Letters of one case alone are words; of both cases they are base64 if there are three of each.
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-zA-Z])(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base64", "^(?:(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])|(?=(?:.*[a-z]){3})(?=(?:.*[A-Z]){3}))[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/"),
)


def base(text: Column) -> dict[str, Column]:
    assign = F.filter(N.where(text.rlike(ASSIGN_HINT), N.found(text, ASSIGN)), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    return {"assign": assign, "access": N.where(F.contains(text, F.lit("AKIA")), N.found(text, ACCESS)), "hex": N.where(text.rlike(HEX), N.found(text, HEX))}


def _step_of(p: float) -> int:
    return DEEPEST if p < 1e-30 else min(DEEPEST, math.floor(-math.log10(min(p, 1.0)) * STEPS))


def _times(a: list[np.ndarray], b: list[np.ndarray], most: int) -> list[np.ndarray]:
    out = []
    for n in range(EXACT + 1):
        total = np.zeros(most + 1)
        for i in range(n + 1):
            if a[i].any() and b[n - i].any():
                x = np.convolve(a[i], b[n - i])[: most + 1]
                total[: len(x)] += x
        out.append(np.trim_zeros(total, "b") if total.any() else total[:1])
    return out


@lru_cache(1)
def tails() -> dict[int, list[list[int]]]:
    """For each size of alphabet and each length up to EXACT the two-sided p of a number of equal pairs (half of the number's own chance counted), in steps; larger numbers are as the last.

    Coefficients of (sum over c of x^c / c! y^(c choose 2)) ^ k, by squaring.
    """
    one = [np.append(np.zeros(c * (c - 1) // 2), 1 / math.factorial(c)) for c in range(EXACT + 1)]
    power = {1: one}
    for k in (2, 4, 8, 16, 32, 64):
        power[k] = _times(power[k // 2], power[k // 2], 420)
    power[36] = _times(power[32], power[4], 420)
    out = {}
    for k in sorted({len(alphabet) for _, _, alphabet in ENCODINGS}):
        rows = []
        for n in range(EXACT + 1):
            chance = power[k][n] * math.factorial(n) / float(k) ** n
            up, down = np.cumsum(chance) - chance / 2, np.cumsum(chance[::-1])[::-1] - chance / 2
            row = [_step_of(2 * min(a, b)) for a, b in zip(up, down, strict=True)]
            last = next((i for i in range(int(chance.argmax()), len(row)) if row[i] == DEEPEST), len(row) - 1)
            rows.append(row[: last + 1])
        out[k] = rows
    return out


def _numbers(values: list[int]) -> Column:
    """A constant array, as text that the optimizer reads once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _two_sided(z: Column) -> Column:
    """Chance that a standard normal variable is at least as far from 0."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # erfc by Chebyshev fit; relative error below 1.2e-7.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = c + t * poly
    return F.greatest(F.lit(1e-30), F.least(F.lit(1.0), t * F.exp(-x * x + poly)))


def _uniform(n: Column, pairs: Column, k: int) -> Column:
    """p of `pairs` pairs of equal characters among n of k equally likely ones."""
    rows = tails()[k]
    flat, first = [x for r in rows for x in r], np.cumsum([0, *map(len, rows)]).tolist()
    at = F.least(n, F.lit(EXACT)).cast("int") + 1
    begin, end = F.element_at(_numbers(first), at), F.element_at(_numbers(first), at + 1)
    exact = F.pow(F.lit(10.0), -F.element_at(_numbers(flat), F.least(begin + pairs.cast("int"), end - 1) + 1) / STEPS)
    d = k - 1
    chi = F.greatest(F.lit(0.0), (2 * pairs + n) * k / n - n)
    far = _two_sided((F.pow(chi / d, 1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    return F.when(n <= EXACT, exact).otherwise(far)


def classes(alphabet: str) -> tuple[list[int], float, float]:
    """(class of each character, mean share of neighbours of unlike classes, covariance of two neighbouring ones) in random strings."""
    of = [0 if c in DIGITS else 1 if c in UPPER else 2 if c in LOWER else 3 for c in alphabet]
    q = [of.count(c) / len(of) for c in range(4)]
    unlike = 1 - sum(x**2 for x in q)
    return of, unlike, 1 - 2 * sum(x**2 for x in q) + sum(x**3 for x in q) - unlike**2


def tested(value: Column) -> Column:
    """Struct of encoding, uniform (p), runs and serial (standard scores) and p (of a random string looking at least as odd); null for words and other strings without an encoding."""
    body = F.regexp_replace(F.translate(value, "-_", "+/"), "=+$", "")

    def of(name: str, alphabet: str) -> Column:
        k = len(alphabet)
        kind, unlike, cov = classes(alphabet)

        def scores(text: Column) -> Column:
            n = F.length(text).cast("double")
            count = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
            squares = F.aggregate(F.split(F.lit(alphabet), ""), F.lit(0.0), lambda t, c: t + F.pow(count(c).cast("double"), 2))
            signs = F.translate(text, alphabet, "".join("0123"[c] for c in kind))
            turns = F.length(F.regexp_replace(signs, r"(.)\1*", "x")) - 1
            spread = (n - 1) * unlike * (1 - unlike) + 2 * (n - 2) * cov
            runs = (turns - (n - 1) * unlike) / F.sqrt(spread)
            places = F.transform(F.split(text, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))

            def serial(s: Column) -> Column:
                mean = F.aggregate(s, F.lit(0.0), lambda t, c: t + c) / n
                square = F.aggregate(s, F.lit(0.0), lambda t, c: t + (c - mean) * (c - mean))
                product = F.aggregate(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda t, x: t + x)
                return F.when(square > 0, (product / square + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

            three = N.let(places, lambda s: F.struct(_uniform(n, (squares - n) / 2, k).alias("uniform"), runs.alias("runs"), serial(s).alias("serial")))

            def combined(t: Column) -> Column:
                y = -F.log(t["uniform"]) - F.log(_two_sided(t["runs"])) - F.log(_two_sided(t["serial"]))
                return N.let(y, lambda y: F.struct(F.lit(name).alias("encoding"), t["uniform"].alias("uniform"), t["runs"].alias("runs"), t["serial"].alias("serial"), (F.exp(-y) * (1 + y + y * y / 2)).alias("p")))

            return N.let(three, combined)

        return N.let(F.lower(body) if name in ("hex", "base36") else body, scores)

    out = None
    for name, form, alphabet in ENCODINGS:
        hit = value.rlike(form)
        out = F.when(hit, of(name, alphabet)) if out is None else out.when(hit, of(name, alphabet))
    return out


def _stratum(length: Column) -> Column:
    return sum((F.when(length >= n, 1).otherwise(0) for n in STRATA[1:]), F.lit(0))


def _step(p: Column) -> Column:
    return F.least(F.lit(DEEPEST), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * STEPS)).cast("int")


def cut(counts: dict[int, int]) -> int:
    """The step from which a candidate of a stratum is no secret (DEEPEST + 1: never), from the candidates of each step.

    The lower one of two: that from which randomness is rejected by the rule of Benjamini and Hochberg, and
    the highest at which what passes is random but for FALSE_SECRETS of it, as far as can be told: random
    strings have any p alike, so twice those beyond a half are about all of them (Storey's estimate); two
    standard deviations are allowed for, and no p beyond MOST_LOST is asked for. The second rule binds where
    strings are too short for the tests to reject much.
    """
    every = sum(counts.values())
    random = 2 * sum(n for step, n in counts.items() if step <= math.floor(STEPS * math.log10(2)))
    rejects, mixed, passed = DEEPEST + 1, DEEPEST + 1, every
    for step in range(DEEPEST, -1, -1):
        # Those from this step on are rejected if p times all is at most its share of them; p is the largest of the step.
        passed -= counts.get(step, 0)
        p = 10 ** (-step / STEPS)
        if counts.get(step) and p * every <= FALSE_REJECTIONS * (every - passed):
            rejects = step
    for step in range(DEEPEST + 1, math.ceil(-STEPS * math.log10(MOST_LOST)) - 1, -1):
        passed = sum(n for k, n in counts.items() if k < step)
        mixed = step
        if passed - random * (1 - 10 ** (-step / STEPS)) - 2 * math.sqrt(passed) <= FALSE_SECRETS * passed:
            break
    return min(rejects, mixed)


def limits(candidates: DataFrame) -> dict[int, int]:
    """For each stratum its cut, from all candidates (stratum, step). They are counted by step first: what the driver sees is bounded by strata and steps."""
    counts: dict[int, dict[int, int]] = {k: {} for k in range(len(STRATA))}
    for r in candidates.groupBy("stratum", "step").count().collect():
        counts[r.stratum][r.step] = r["count"]
    return {k: cut(x) for k, x in counts.items()}


#: What is tested of a base span: the value that is assigned, the part after a fixed prefix.
SECRET: dict[str, Callable[[Column], Column]] = {"assign": lambda v: F.regexp_extract(v, ASSIGN, 1), "access": lambda v: F.substring(v, 5, 1 << 30), "hex": lambda v: v}


def _asked(order: int, secret: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(order).alias("order"), secret(s["value"]).alias("value"))


def spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """df's id with assign, access, hex (arrays of start, end, value), `base` and `all` (sorted arrays of start, order, kind, end), `tests` (what was tested, with scores) and `doubtful` (base spans that don't pass for random, as `base`).

    A random string beside base spans is listed as kind `random`; what overlaps a base span is not. Base spans
    stay, doubtful or not. A null or empty text has no spans; equal rows each get a row, a null id stays
    null, extra columns are not read. Positions are code points, ends exclusive. Found values and scores are written to the shared
    folder once, without texts; limits are made from all of them.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = rows.select("*", *(c.alias(k) for k, c in base(F.col("text")).items()))
    asked = [F.transform(k, _asked(i, secret)) for i, (k, secret) in enumerate(SECRET.items())]
    rows = rows.withColumn("bare", F.concat(*asked))
    free = F.filter(N.where(F.col("text").rlike(CANDIDATE_HINT), N.found(F.col("text"), CANDIDATE)), lambda s: ~F.exists("bare", lambda b: N.overlaps(s, b)))
    free = F.transform(free, _asked(len(BASE), lambda v: v))
    rows = rows.withColumn("asked", F.concat("bare", free)).drop("text", "bare")
    scored = F.transform("asked", lambda s: N.let(tested(s["value"]), lambda t: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), *(t[c].alias(c) for c in ("encoding", "uniform", "runs", "serial", "p")), _stratum(F.length(s["value"])).alias("stratum"), _step(t["p"]).alias("step"))))
    rows = rows.withColumn("tests", F.filter(scored, lambda t: t["encoding"].isNotNull())).drop("asked")
    rows = stored(rows, "candidates")
    cuts = limits(rows.select(F.explode("tests").alias("t")).select("t.stratum", "t.step"))
    bound = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))
    passed = F.filter("tests", lambda t: t["step"] < F.element_at(bound, t["stratum"]))
    rows = rows.withColumn("passed", passed)
    found = F.array_sort(F.concat(*(N.named(F.col(k), k, i) for i, k in enumerate(BASE))))
    every = F.array_sort(F.concat("base", N.named(F.filter("passed", lambda t: t["order"] == len(BASE)), "random", len(BASE))))
    rows = rows.withColumn("base", found).withColumn("all", every)
    doubtful = F.filter("base", lambda b: ~F.exists("passed", lambda t: (t["start"] == b["start"]) & (t["order"] == b["order"])))
    return rows.withColumn("doubtful", doubtful).drop("passed").withColumnRenamed("id", id_column)
