"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

All work on rows is done by built-in functions. The four base kinds (email, ip, card, phone) are found by
their formats alone and always stay. Further generators propose spans that may overlap, of one text read in
several ways (national numbers, local telephone numbers, account numbers, dates of birth, bare numbers,
IPv6 addresses, mail addresses in words, street addresses). Boosted trees score them by format and context.
They are trained on a bounded set of made-up sentences, whose candidates and features come from the same
expressions that score documents; other such sentences calibrate them and set each kind's threshold. Of
overlapping candidates beyond their thresholds the most probable is taken first, then the next that
overlaps none taken; base spans come before all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import native as N
from tessella.llm.boosting import Boosted

#: Same spans as the plain patterns, but each position is tried once: a run is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
BASE = ("email", "ip", "card", "phone")

#: Generators of further candidates, in the order in which they are listed: a string and a pattern that each text with one has, and the pattern. No span is longer than LONGEST.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
_STREET = "(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Square|Sq)"
CANDIDATES = {
    "national": ("", r"[0-9]{2}[\x20.-]?[0-9]{2}", r"(?<![A-Za-z0-9-])(?:[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}|[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D])(?![A-Za-z0-9-])"),
    "local_phone": ("", r"[0-9]{2}\)?[\x20./-][0-9]{2}", r"(?<![A-Za-z0-9+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-][0-9]{2,4}){2,4}(?![A-Za-z0-9-])"),
    "account": ("", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "birth_date": ("", r"(?:19|20)[0-9]{2}", rf"(?<![0-9/.-])(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,2}}|[0-9]{{1,2}}\x20{_MONTH}\x20(?:19|20)[0-9]{{2}})(?![0-9/.-])"),
    "number": ("", r"[0-9](?:[\x20./-]?[0-9]){6}", r"(?<![A-Za-z0-9.+-])[0-9](?:[\x20./-]?[0-9]){6,18}(?![A-Za-z0-9])"),
    "ipv6": (":", r"[0-9A-Fa-f]:[0-9A-Fa-f:]", r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![A-Za-z0-9:])"),
    "written_mail": ("dot", r"[\x20(\[]dot[\x20)\]]", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,32}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,32}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,8}(?![A-Za-z0-9])"),
    "address": ("", r"[0-9][a-z]?\x20[A-Z]", rf"(?<![A-Za-z0-9.,-])[0-9]{{1,5}}[a-z]?\x20(?:[A-Z][a-z]{{1,16}}\x20){{1,3}}{_STREET}(?![A-Za-z])"),
}
LONGEST = 128
#: Words before a candidate, by what they speak for.
CUES = {
    "national": r"(?i)\b(?:ssn|social security|national (?:id|insurance|number)|tax (?:id|number)|insurance number|passport|licen[cs]e|dni|ausweis|s\u00e9curit\u00e9 sociale)\b",
    "phone": r"(?i)\b(?:tel|phone|telefon|t\u00e9l\u00e9phone|tel\u00e9fono|call|fax|mobile|m\u00f3vil|handy|cell|ring|contact|dial|text me)\b",
    "account": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|transfer|pay to|card|customer)\b",
    "birth": r"(?i)\b(?:born|birth|dob|birthday|birthdate|geboren|n\u00e9e?|nacid[oa])\b",
    "mail": r"(?i)\b(?:mail|e-mail|write|reach|contact|correo|courriel)\b",
    "place": r"(?i)\b(?:lives?|living|address|home|resid(?:es?|ing|ence)|ship|deliver(?:ed|y)?|moved|at)\b",
    "host": r"(?i)\b(?:ip|host|from|server|client|login|logged|address)\b",
    "other": r"(?i)\b(?:order|invoice|version|ref|reference|part|serial|isbn|issn|doi|ticket|released?|published|updated|meeting|due|total|page|model|sku|build|code|score|range|mac|time|at noon|since|in|price|rows?)\b",
}
AFTER = r"(?i)^\W{0,3}(?:mm|cm|kg|km|usd|eur|percent|units|items|points|times|crash|rules|index|%|am|pm)\b"
CONTEXT = 32
FEATURES = [*CANDIDATES, *(f"cue_{c}" for c in CUES), "after", "marked", "digits", "distinct", "length", "separators", "valid", "checksum"]
#: Made-up sentences that the trees are trained on, those that calibrate them, and those that set the thresholds.
TRAIN_ROWS, HELD_ROWS = 4000, 3000
#: Share of true ones that a kind's candidates above its threshold have at least on the held-out sentences.
PRECISION = 0.95


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def term(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, 1).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda t, i: t + term(i)) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    size = lambda s: F.length(N.digits(s["value"]))
    return {
        "email": N.where(F.contains(text, F.lit("@")), N.found(text, EMAIL)),
        "ip": F.filter(N.where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), N.found(text, IP)), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(OCTET))),
        "card": F.filter(N.where(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), N.found(text, CARD)), lambda s: size(s).between(14, 19) & luhn(N.digits(s["value"]))),
        "phone": F.filter(N.where(F.contains(text, F.lit("+")), N.found(text, PHONE)), lambda s: size(s).between(10, 15)),
    }


def _mod97(t: Column, c: Column) -> Column:
    digit = F.when(c.rlike("^[0-9]$"), c).otherwise(F.lit("0")).cast("int")
    return F.when(c.rlike("^[0-9]$"), (t * 10 + digit) % 97).when(c.rlike("^[A-Z]$"), (t * 100 + F.ascii(c) - 55) % 97).otherwise(t)


def features(order: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES of a candidate of the order-th generator."""
    number, names = N.digits(value), list(CANDIDATES)
    one = lambda c: F.when(c, 1).otherwise(0)
    is_ = lambda kind: order == names.index(kind)
    part = lambda k: F.try_element_at(F.split(value, r"[/.\x20-]"), F.lit(k))
    day, month = F.least(part(1).try_cast("int"), part(2).try_cast("int")), F.greatest(part(1).try_cast("int"), part(2).try_cast("int"))
    valid = (
        F.when(is_("national"), ~number.rlike("^(?:000|666|9)|^...00|0000$"))
        .when(is_("local_phone"), F.length(number).between(7, 11))
        .when(is_("birth_date"), F.when(value.rlike("[a-z]"), part(1).try_cast("int").between(1, 31)).when(value.rlike("^[0-9]{4}"), part(2).try_cast("int").between(1, 12) & part(3).try_cast("int").between(1, 31)).otherwise(day.between(1, 12) & month.between(1, 31)))
        .when(is_("ipv6"), (F.size(F.split(value, ":")) == 8) | F.contains(value, F.lit("::")))
        .when(is_("address"), ~value.rlike("^(?:1[5-9]|20)[0-9]{2}\\x20"))
        .otherwise(True)
    )
    flat = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(flat, 5, LONGEST), F.substring(flat, 1, 4))  # letters are two digits each, the first four characters go last, modulo 97
    check = F.when(is_("account"), F.aggregate(F.split(turned, ""), F.lit(0).cast("bigint"), _mod97) == 1).when(is_("number"), luhn(number)).otherwise(False)
    marked = before.rlike(r"[#$\u20ac\u00a3/=v_]\x20?$")
    rest = [after.rlike(AFTER), marked]
    sizes = [F.length(number), F.size(F.array_distinct(F.split(number, ""))), F.length(value), F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))]
    return [*(one(is_(k)) for k in names), *(one(before.rlike(c)) for c in CUES.values()), *map(one, rest), *sizes, one(F.coalesce(valid, F.lit(False))), one(F.coalesce(check, F.lit(False)))]


def candidates(text: Column) -> Column:
    """Array of (order, start, end, value) of all generators' spans."""
    test = lambda word, hint: F.contains(text, F.lit(word)) & text.rlike(hint) if word else text.rlike(hint)
    each = N.found_each(text, [(test(word, hint), pattern) for word, hint, pattern in CANDIDATES.values()])
    return F.flatten(F.transform(each, lambda found, order: F.transform(found, lambda s: F.struct(order.alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))))


def described(text: Column, c: Column) -> Column:
    """The features of a candidate in its text, as an array of numbers."""
    before = F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
    around = F.struct(before.alias("before"), F.substring(text, c["end"] + 1, CONTEXT).alias("after"))
    return N.let(around, lambda a: F.array(*(x.cast("double") for x in features(c["order"], c["value"], a["before"], a["after"]))))


#: Sentences around a true candidate and around one that only looks like it: {} is its place.
TRUE = {
    "national": ["My SSN is {}.", "social security number {} on file", "national insurance {} given", "passport {} expires soon", "Jane Doe, {}, Springfield", "tax id: {}"],
    "local_phone": ["please call {} now", "phone: {}", "You can ring me on {} after six", "Tel. {}", "John Smith {} (home)", "mobile {} or mail", "Telefon {} bitte"],
    "account": ["IBAN {} please", "transfer the rent to {} today", "bank account {}", "send it to {} by Friday", "Konto {}"],
    "birth_date": ["born {} in Leeds", "date of birth: {}", "DOB {}", "her birthday is {}", "geboren {} in Kiel", "Mary Jones ({}) signed"],
    "number": ["passport {} was lost", "customer account {} holder", "social security {} again", "driving licence {}", "call {} tonight", "my card {} was stolen"],
    "ipv6": ["login from {} failed", "host {} is up", "client {} sent", "my address is {} now", "peer {} joined"],
    "written_mail": ["mail me: {}", "write to {} for more", "contact {}", "reach us: {} any time", "{}"],
    "address": ["she lives at {} with her son", "ship it to {} today", "home address: {}", "he moved to {} in May", "delivered to {}"],
}
FALSE = {
    "national": ["part {} in stock", "order {} shipped", "score {} after extra time", "ref {}", "serial {} engraved", "model {} sold out"],
    "local_phone": ["range {} mm", "rows {} of the table", "order {} shipped", "build {} released", "invoice {} is due", "scores were {} points", "version {}", "the numbers {} came up"],
    "account": ["ref {} x", "part {} in stock", "product code {}", "model {} sold out", "ticket {}"],
    "birth_date": ["released {} worldwide", "the meeting of {} was long", "due {}", "published {}", "updated on {}", "invoice of {}", "on {} it rained"],
    "number": ["order {} shipped", "isbn {} in print", "serial {} engraved", "a total of {} rows", "the sum {} was wrong", "it holds {} items", "version {} is out", "word {} word", "and {} the"],
    "ipv6": ["mac {} seen", "time {} on the clock", "score {} at the end", "ratio {} in tests", "chapter {} reads"],
    "written_mail": ["we looked {} often", "{} was the rule", "in the picture {} appears"],
    "address": ["in {} crashed", "since {} rules changed", "the film {} came out", "item {} in the list"],
}

def _value(r: np.random.Generator, kind: str, true: bool) -> str:
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *x: str(x[int(r.integers(len(x)))])
    word = lambda: pick("Oak", "Maple", "Church", "Station", "High", "King", "Wall", "Mill", "Lake", "Baker")
    if kind == "national":
        a, b, c = (f"{r.integers(1, 665):03d}", f"{r.integers(1, 99):02d}", f"{r.integers(1, 9999):04d}") if true or r.random() < 0.4 else (d(3), d(2), d(4))
        return pick("-", "-", " ", ".").join([a, b, c]) if r.random() < 0.8 else pick("AB", "QQ", "JK") + " ".join(["", d(2), d(2), d(2), pick("A", "B", "C", "D")])
    if kind == "local_phone":
        sep = pick(" ", "-", ".", "/")
        if true:
            return pick(f"({d(3)}) {d(3)}-{d(4)}", sep.join([f"0{d(2)}", d(3), d(4)]), sep.join([d(3), d(3), d(4)]), sep.join([f"0{d(1)}", d(2), d(2), d(2), d(2)]))
        return sep.join(d(int(n)) for n in r.integers(2, 5, int(r.integers(3, 6))))
    if kind == "account":
        body = d(int(r.integers(10, 19)))
        land = pick("DE", "GB", "FR", "ES", "NL")
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97 if true or r.random() < 0.03 else int(r.integers(10, 99))
        whole = f"{land}{check:02d}{body}"
        whole = whole[: len(whole) // 4 * 4 + 3]
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.6 else whole
    if kind == "birth_date":
        year = int(r.integers(1930, 2012)) if true else int(r.integers(1985, 2030))
        a, b, sep = int(r.integers(1, 29)), int(r.integers(1, 13)), pick("/", ".", "-")
        if not true and r.random() < 0.2:
            a, b = int(r.integers(32, 99)), int(r.integers(13, 99))
        return pick(f"{a:02d}{sep}{b:02d}{sep}{year}", f"{year}-{b:02d}-{a:02d}", f"{a} {pick('March', 'May', 'October')} {year}")
    if kind == "number":
        return d(int(r.integers(7, 17))) if r.random() < 0.7 else " ".join([d(4)] * int(r.integers(2, 5)))
    if kind == "ipv6":
        h = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
        if true:
            return pick(":".join(h(4) for _ in range(8)), f"2001:db8::{h(3)}", f"fe80::{h(4)}:{h(4)}:{h(4)}:{h(4)}")
        return pick(":".join(h(2) for _ in range(6)), f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}", f"{d(2)}:{d(2)}")
    if kind == "written_mail":
        if true:
            return f"{pick('john', 'jane.doe', 'info', 'max_92')}{pick(' at ', ' (at) ', '[at]')}{pick('example', 'mail', 'my-host')}{pick(' dot ', ' (dot) ', '[dot]')}{pick('com', 'org', 'de')}"
        return f"{pick('it', 'they', 'him')} at {pick('every', 'the', 'one')} dot {pick('that', 'point', 'line')}"
    number = int(r.integers(1, 999)) if true or r.random() < 0.15 else int(r.integers(1500, 2030))
    return f"{number} {word()} {pick('Street', 'Road', 'Lane', 'Avenue', 'Way')}"


def sentences(n: int, seed: int) -> list[tuple[str, str, int, int, bool]]:
    """n made-up (text, kind, start, end, truth)."""
    r, out = np.random.default_rng(seed), []
    kinds = list(CANDIDATES)
    for _ in range(n):
        kind, true = kinds[int(r.integers(len(kinds)))], bool(r.random() < 0.5)
        frames = (TRUE if true else FALSE)[kind]
        # Some true ones stand in plain words.
        frame = "word {} word" if r.random() < 0.08 else frames[int(r.integers(len(frames)))]
        lead = " ".join(r.choice("the a of and river stone green under walked slowly".split(), int(r.integers(0, 6))))
        value = _value(r, kind, true)
        head, tail = frame.split("{}")
        head = f"{lead} {head}" if lead else head
        out.append((head + value + tail, kind, len(head), len(head) + len(value), true))
    return out


def labelled(spark: SparkSession, made: list[tuple[str, str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, truth, sentence) of all candidates of made-up sentences: true are those of the sentence's kind and place, if it is true. One text holds all sentences on their way into the plan."""
    mark = "\x1e"
    texts = spark.range(0, len(made), 1, 8).select(F.col("id").alias("i"), F.element_at(F.split(F.lit(mark.join(t for t, *_ in made)), mark), F.col("id").cast("int") + 1).alias("text"))
    found = texts.select("i", "text", F.explode(candidates(F.col("text"))).alias("c"))
    rows = found.select("i", "c.order", "c.start", "c.end", described(F.col("text"), F.col("c")).alias("x")).collect()
    names = list(CANDIDATES)
    truth = [made[r.i][4] and (made[r.i][1] == names[r.order] or names[r.order] == "number") and made[r.i][2] < r.end and r.start < made[r.i][3] for r in rows]
    return np.array([r.x for r in rows], float), np.array(truth, float), np.array([r.i for r in rows])


_model: tuple[Boosted, dict[str, float]] | None = None


def model(spark: SparkSession) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the lowest probability from which PRECISION holds on held-out sentences. Made once in a driver process."""
    global _model
    if _model is None:
        sets = [sentences(n, seed) for n, seed in ((TRAIN_ROWS, 1), (HELD_ROWS, 2), (HELD_ROWS, 3))]
        x, y, i = labelled(spark, [s for part in sets for s in part])
        part = [i < TRAIN_ROWS, (i >= TRAIN_ROWS) & (i < TRAIN_ROWS + HELD_ROWS), i >= TRAIN_ROWS + HELD_ROWS]
        boosted = Boosted().fit(x[part[0]], y[part[0]]).calibrate(x[part[1]], y[part[1]])
        x, y = x[part[2]], y[part[2]]
        p, limits = boosted.probability(x), {}
        for k, kind in enumerate(CANDIDATES):
            own = x[:, k] == 1
            order = np.argsort(-p[own])
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            # Equal probabilities are taken together.
            last = np.append(np.diff(p[own][order]) != 0, True)
            good = np.flatnonzero((right >= PRECISION) & last)
            limits[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.0
        _model = boosted, limits
    return _model


SPAN = "struct<start:int,order:int,kind:string,end:int>"
#: Spans that can start within LONGEST code points before another one: four base kinds and all generators, five characters each at least.
NEAR = LONGEST // 5 * (4 + len(CANDIDATES))


def _chosen(proposed: Column, base_spans: Column) -> Column:
    """Of candidates (p, order, start, end) those that no better one taken overlaps, in SPAN's fields. Base spans are better than all."""
    # A base span of any length is pieces of LONGEST, so that what overlaps lies near in the order of starts.
    pieces = F.flatten(F.transform(base_spans, lambda b: F.transform(F.sequence(b["start"], F.greatest(b["start"], b["end"] - 1), F.lit(LONGEST)), lambda x: F.struct(x.alias("start"), F.least(x + LONGEST, b["end"]).alias("end"), F.lit(2.0).alias("p"), F.lit(-1).alias("order")))))
    every = F.array_sort(F.concat(pieces, F.transform(proposed, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["p"].alias("p"), c["order"].alias("order")))))

    def clusters(a: Column) -> Column:
        reaches = lambda c, i: F.exists(F.slice(a, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR))), lambda o: o["end"] > c["start"])
        heads = F.filter(F.transform(a, lambda c, i: F.when(~reaches(c, i), i)), lambda i: i.isNotNull())
        return N.let(heads, lambda h: F.transform(h, lambda i, k: F.slice(a, i + 1, F.coalesce(F.try_element_at(h, k + 2), F.size(a)) - i)))

    def best(cluster: Column) -> Column:
        ranked = F.array_sort(F.transform(cluster, lambda c: F.struct((-c["p"]).alias("worse"), c["order"].alias("order"), c["start"].alias("start"), c["end"].alias("end"))))
        none = F.slice(ranked, 1, 0)
        return F.aggregate(ranked, none, lambda t, c: F.when(F.exists(t, lambda o: N.overlaps(o, c) & (c["order"] >= 0)), t).otherwise(F.concat(t, F.array(c))))

    taken = F.flatten(F.transform(N.let(every, clusters), best))
    names = F.array(*map(F.lit, CANDIDATES))
    return F.transform(F.filter(taken, lambda c: c["order"] >= 0), lambda c: F.struct(c["start"].alias("start"), (c["order"] + len(BASE)).alias("order"), F.element_at(names, c["order"] + 1).alias("kind"), c["end"].alias("end")))


def spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """df's id, text and the columns in `also` (named unlike what follows) with email, ip, card, phone (arrays of start, end, value), `n_candidates` (proposed), `base` and `all` (arrays of SPAN, sorted).

    A null or empty text has no spans; equal rows each get a row, a null id stays null, extra columns are
    not read. Positions are code points, ends exclusive. Base spans of different kinds may overlap.
    """
    boosted, limits = model(df.sparkSession)
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), *also)
    rows = rows.select("*", *(c.alias(k) for k, c in base(F.col("text")).items()))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(N.named(F.col(k), k, i) for i, k in enumerate(BASE)))))
    rows = rows.withColumn("candidates", candidates(F.col("text")))
    probability = lambda c: N.let(described(F.col("text"), c), boosted.column)
    scored = F.transform("candidates", lambda c: F.struct(probability(c).alias("p"), c["order"].alias("order"), c["start"].alias("start"), c["end"].alias("end")))
    least = F.array(*map(F.lit, limits.values()))
    rows = rows.withColumn("proposed", F.filter(scored, lambda c: c["p"] >= F.element_at(least, c["order"] + 1)))
    every = F.when(F.size("proposed") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", _chosen(F.col("proposed"), F.col("base")))))
    return rows.withColumn("all", every).withColumn("n_candidates", F.size("candidates").cast("bigint")).drop("proposed", "candidates").withColumnRenamed("id", id_column)


def redacted(text: Column, found: Column) -> Column:
    """The text with its spans (sorted SPANs) replaced by [KIND]; overlapping ones become one, named by the first."""

    def cut(s: Column) -> Column:
        # What ends before each span: the furthest end so far.
        before = N.running_max(F.transform(s, lambda x: x["end"]))
        piece = lambda x, to: F.when(x["start"] >= to, F.concat(F.substring(text, to + 1, x["start"] - to), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return N.let(before, lambda b: F.concat(F.array_join(F.zip_with(s, F.concat(F.array(F.lit(0)), F.slice(b, 1, F.size(b) - 1)), piece), ""), F.substring(text, F.element_at(b, -1) + 1, F.length(text))))

    return F.when(F.size(found) == 0, text).otherwise(N.let(found, cut))
