"""Personal data: spans proposed by patterns, chosen by boosted trees, all in DataFrame expressions.

Four base kinds follow fixed patterns and checks; their spans always stand. Further generators with high
recall propose overlapping spans (written-out mail addresses, numbers with separators, account
numbers, IPv6 addresses, credentials). Every proposal gets features of its format and of its
context; gradient-boosted trees turn them into a probability, and a calibrated threshold for each
generator selects: the least score from which on the held-out mentions reach the wanted precision. The trees are trained on the driver, on labelled mentions made from seeded
templates (``TRAINING_ROWS`` texts, the documented bound), in which private and other mentions share formats and contexts, so that no
feature tells them apart alone; features come from the same expressions as in use. The fitted trees become one SQL expression.

Positions of matches: between the pieces that ``split`` leaves and the matches that
``regexp_extract_all`` finds with the same pattern, lengths add up to starts, in code points. Patterns are
written so that they take time linear in a text: possessive, and started at the begin of a run only. Spans are gone through in order,
in blocks, so that time grows with their number and not with its square; redaction cuts texts into pieces once.

Defined results: a null text counts as empty (no spans). Spans of different base kinds may overlap and all
stand. Proposals are gone through from left to right: one that overlaps a base span is dropped, and of two that overlap the one of the better score
stays, of like scores the first. Repeated rows each give a row. An empty table gives an empty result. Extra columns are kept
by ``redact``, whatever their names, and otherwise not read.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.runtime import unused_name

BASE_KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS = 4000

#: Base patterns (fixed meaning; rewritten to take linear time).
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: What proposes further spans.
GENERATORS = {
    "mailwords": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: at | ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]{1,63}(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{2,63}){1,4}",
    "number": r"(?<![0-9A-Za-z+.(-])\(?[0-9][0-9 ().-]{5,22}[0-9](?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "secret": r"(?<![A-Za-z0-9_/+.-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,80}(?![A-Za-z0-9_/+.-])",
}
CONTEXT = 24
_HINTS = {
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact)\W*(\w+\W+)?$",
    "identity": r"(?i)(ssn|social|iban|account|passport|id)\W*(\w+\W+)?$",
    "credential": r"(?i)(password|passwd|pwd|token|secret|key|auth)\W*$",
    "mail": r"(?i)(mail|write|contact|reach)\W*(\w+\W+)?$",
    "neutral": r"(?i)(version|page|isbn|order|part|no|nr|item|build|hash|commit|sha\d*|doi|in|lines?)\W*$",
}
FEATURES = ("generator", "length", "digits", "separators", "luhn", "upper_share", "hex_only", "distinct", "parts", "first_part", "last_part", "phone", "identity", "credential", "mail", "neutral", "known_prefix", "mod97")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def check(back: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(back))
        total = F.aggregate(at, F.lit(0), lambda acc, k: acc + let(F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
        return total % 10 == 0

    return F.when(F.length(digits) > 0, let(F.reverse(digits), check)).otherwise(False)


SPAN = "struct<start:int,end:int,value:string,before:string>"
#: Items that are gone through at a time, and code points of a piece of text.
STEPS, PIECE = 256, 4096


def blocks(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / STEPS).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * STEPS + 1, F.lit(STEPS)))


def swept(items: Column, state: Column, step: Callable[[Column, Column], Column], emits: str) -> Column:
    """Goes through ``items`` in order. ``step`` of state and item: a struct of the next state and what is emitted (``out``, an array)."""
    none, nones = (F.expr(f"cast(array() as {kind})") for kind in (f"array<{emits}>", f"array<array<{emits}>>"))

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda y: F.struct(y["state"].alias("state"), F.when(F.size(y["out"]) > 0, F.concat(acc["out"], y["out"])).otherwise(acc["out"]).alias("out")))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["outs"], F.array(i["out"])).alias("outs")))

    return let(items, lambda it: F.aggregate(blocks(it), F.struct(state.alias("state"), nones.alias("outs")), block, lambda acc: F.flatten(acc["outs"])))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, before), positions in code points."""

    def walk(s: Column) -> Column:
        found = F.transform(s["found"], lambda v, k: F.struct(F.length(F.get(s["pieces"], k)).alias("gap"), F.length(v).alias("size"), v.alias("value"), F.right(F.get(s["pieces"], k), F.lit(CONTEXT)).alias("before")))

        def step(at: Column, x: Column) -> Column:
            start, end = at + x["gap"], at + x["gap"] + x["size"]
            return F.struct(end.alias("state"), F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"))).alias("out"))

        return swept(found, F.lit(0), step, SPAN)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), walk)


def united(spans: Column) -> Column:
    """Spans (start, end), those that overlap or touch taken together, in order."""
    ends = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit((1 << 31) - 1).alias("end"))
    plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def step(held: Column, x: Column) -> Column:
        inside = x["start"] <= held["end"]
        now = F.struct(F.when(inside, held["start"]).otherwise(x["start"]).alias("start"), F.greatest(held["end"], x["end"]).alias("end"))
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        return F.struct(now.alias("state"), F.when(inside | (held["start"] < 0), none).otherwise(F.array(held)).alias("out"))

    return swept(F.concat(plain, F.array(ends)), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), step, "struct<start:int,end:int>")


_SCORED = "struct<start:int,end:int,kind:string,p:double>"


def best_of(scored: Column, base: Column) -> Column:
    """Of proposals (start, end, kind, p) those that stand, in order; ``base``: spans that none may overlap."""
    item = lambda x, kind, p: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), p.alias("p"))
    # base spans go along as better than any proposal
    fixed = F.transform(united(base), lambda x: item(x, F.lit(""), F.lit(2.0)))
    end = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit((1 << 31) - 1).alias("end"), F.lit("").alias("kind"), F.lit(2.0).alias("p"))
    none = F.expr(f"cast(array() as array<{_SCORED}>)")

    def step(held: Column, x: Column) -> Column:
        over = x["start"] < held["end"]
        return F.struct(
            F.when(over & (x["p"] <= held["p"]), held).otherwise(x).alias("state"),
            F.when(over | (held["p"] > 1), none).otherwise(F.array(held)).alias("out"),
        )

    first = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind"), F.lit(2.0).alias("p"))
    every = F.concat(F.array_sort(F.concat(F.transform(scored, lambda x: item(x, x["kind"], x["p"])), fixed)), F.array(end))
    return F.when(F.size(scored) > 0, swept(every, first, step, _SCORED)).otherwise(none)


_NONE = f"cast(array() as array<{SPAN}>)"


def base_spans(text: Column, kind: str, digit: Column) -> Column:
    found = located(text, BASE_PATTERNS[kind])
    if kind == "ip":
        # a part of more than nine digits may still be small, with zeros in front
        part = lambda p: F.regexp_replace(p, "^0+", "")
        found = F.filter(found, lambda x: F.forall(F.split(x["value"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)))
    elif kind == "card":
        found = F.filter(found, lambda x: luhn(digits_of(x["value"])))
    elif kind == "phone":
        found = F.filter(found, lambda x: F.length(digits_of(x["value"])).between(8, 15))
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, digit)
    return F.when(gate, found).otherwise(F.expr(_NONE))


def _mod97(v: Column) -> Column:
    """Whether an account number passes the check of its kind (remainder 1 of 97)."""
    plain = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.lit(64)), F.substring(plain, 1, 4))

    def rest(s: Column) -> Column:
        step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.substring(s, k, F.lit(1))), F.lit(0), step) == 1

    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,}$"), let(turned, rest)).otherwise(False)


def features(x: Column, generator: int) -> Column:
    v, size = x["value"], F.length(x["value"]).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda c: F.regexp_count(v, F.lit(c)).cast("double")
    by_name = {
        "generator": F.lit(float(generator)),
        "length": size,
        "digits": count("[0-9]"),
        "separators": count("[^A-Za-z0-9]"),
        "luhn": flag(luhn(digits_of(v))),
        "upper_share": count("[A-Z]") / size,
        "hex_only": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(v)), lambda k: F.substring(v, k, F.lit(1))))).cast("double"),
        "parts": count("[0-9]+"),
        "first_part": F.length(F.regexp_extract(v, "^[^0-9]*([0-9]*)", 1)).cast("double"),
        "last_part": F.length(F.regexp_extract(v, "([0-9]*)[^0-9]*$", 1)).cast("double"),
        "known_prefix": flag(v.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|AIza)")),
        "mod97": flag(_mod97(v)),
    } | {k: flag(x["before"].rlike(p)) for k, p in _HINTS.items()}
    return F.array(*[by_name[k] for k in FEATURES])


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (feature, cut, feature, cut, feature, cut, four leaves) each, and a calibration."""

    bias: float
    trees: tuple[tuple, ...]
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def score(self, f: Column) -> Column:
        total = F.lit(self.bias)
        for a, ca, b, cb, c, cc, w0, w1, w2, w3 in self.trees:
            low = F.when(F.get(f, F.lit(b)) <= cb, w0).otherwise(w1)
            high = F.when(F.get(f, F.lit(c)) <= cc, w2).otherwise(w3)
            total = total + F.when(F.get(f, F.lit(a)) <= ca, low).otherwise(high)
        return 1 / (1 + F.exp(-(self.slope * total + self.offset)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for a, ca, b, cb, c, cc, *w in self.trees:
            out += np.where(x[:, a] <= ca, np.where(x[:, b] <= cb, w[0], w[1]), np.where(x[:, c] <= cc, w[2], w[3]))
        return out


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    best = (-1.0, 0, float("inf"))
    if len(rows):
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, groups: np.ndarray, rounds: int = 24, rate: float = 0.3, precision: float = 0.96) -> Trees:
    """Newton boosting of the logistic loss on even rows; calibration and thresholds on odd ones."""
    fit, held = np.arange(0, len(x), 2), np.arange(1, len(x), 2)
    bias = float(np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3)))
    total, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        a, ca = _best_cut(x, g, h, fit)
        sides = [fit[x[fit, a] <= ca], fit[x[fit, a] > ca]]
        cuts, leaves = [], []
        for side in sides:
            f, c = _best_cut(x, g, h, side)
            cuts += [f, c]
            leaves += [rate * float(g[r].sum() / (h[r].sum() + 1)) for r in (side[x[side, f] <= c], side[x[side, f] > c])]
        tree = (a, ca, *cuts, *leaves)
        trees.append(tree)
        total += Trees(0.0, (tree,), 1.0, 0.0, ()).raw(x)
    slope, offset = 1.0, 0.0
    for _ in range(60):  # Platt's calibration, by Newton steps
        z = total[held]
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        d, w = y[held] - p, p * (1 - p) + 1e-6
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        move = np.linalg.solve(hess, np.array([(d * z).sum() - (slope - 1), d.sum() - offset]))
        slope, offset = slope + float(move[0]), offset + float(move[1])
    p = 1 / (1 + np.exp(-(slope * total + offset)))
    cuts = []
    for k in range(len(GENERATORS)):
        rows = held[groups[held] == k]
        order = rows[np.argsort(-p[rows], kind="stable")]
        right = (np.cumsum(y[order]) + 1) / (np.arange(1, len(order) + 1) + 2)  # so that few rows prove little
        last = np.append(p[order][1:] < p[order][:-1] - 1e-9, True) if len(order) else np.zeros(0, bool)  # rows of one score go together
        good = np.flatnonzero((right >= precision) & last)
        cuts.append(float(p[order[good[-1]]]) if len(good) else 1.0)
    return Trees(bias, tuple(trees), slope, offset, tuple(cuts))


def mentions(n: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[str, str, int, str]]:
    """Labelled texts, in turn for each generator: (text, mention, 1 if it is private, generator).

    Whether a mention is private is drawn first; format and context are drawn from that, with a share of formats and
    contexts that the other side has.
    """
    r = random.Random(seed)
    pick, odds, d = r.choice, lambda p: r.random() < p, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))
    rand = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexed, plain = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"

    def iban(good: bool) -> str:
        land, body = pick(["DE", "FR", "ES", "GB"]), d(18)
        value = int("".join(str(int(c, 36)) for c in body + land + "00"))
        check = 98 - value % 97 if good else (98 - value % 97 + r.randint(1, 96)) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if odds(0.5) else s

    phones = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(4)} {d(3)}"]
    others = [lambda: f"{d(1)}.{d(1)}.{d(2)}.{d(3)}.{d(2)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: d(8), lambda: d(12), lambda: f"{d(2)} {d(3)} {d(3)}"]
    neutral, calls, names = ["version ", "page ", "order ", "isbn ", "item ", "part "], ["call ", "tel. ", "fax: ", "phone "], ["ssn ", "iban ", "account: ", "passport "]

    def made(kind: str, private: bool) -> tuple[str, str]:
        if kind == "mailwords":
            end = pick(["com", "org", "net"]) if odds(0.95 if private else 0.02) else word()
            form = pick([" at |dot", "(at)|dot", " [at] |dot"]) if odds(0.9 if private else 0.02) else " at |dot"
            dot = pick([" dot ", "(dot)", " [dot] "]) if form != " at |dot" or private else " dot "
            return pick(["write to ", "mail ", "reach me: "]) if odds(0.6 if private else 0.02) else "", f"{word()}{form.split('|')[0]}{word()}{dot}{end}"
        if kind == "number":
            before = pick([*calls, *names[:1]]) if odds(0.7 if private else 0.02) else pick(neutral) if odds(0.02 if private else 0.6) else ""
            form = pick(phones) if odds(0.75 if private else 0.03) else (lambda: f"{d(3)}-{d(2)}-{d(4)}") if private else pick(others)
            return before, form()
        if kind == "account":
            before = pick(names[1:]) if odds(0.5 if private else 0.03) else pick(neutral) if odds(0.02 if private else 0.5) else ""
            return before, iban(odds(0.95 if private else 0.02))
        if kind == "address6":
            groups, size = (8, 4) if odds(0.95 if private else 0.03) else (r.randint(4, 6), 2)
            return pick(["host ", "from ", ""]) if odds(0.6 if private else 0.3) else pick(["at ", "lasted ", ""]), ":".join(rand(hexed if size == 4 else "0123456789", size) for _ in range(groups))
        before = pick(['token = "', "password=", "secret: ", "api_key = '"]) if odds(0.75 if private else 0.02) else pick(["commit ", "sha256 ", "hash ", "build "]) if odds(0.02 if private else 0.6) else ""
        if private:
            return before, "AKIA" + rand("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) if odds(0.3) else pick(["ghp_", "sk_live_"]) + rand(plain, 30) if odds(0.4) else rand(hexed, pick([18, 32, 40]))
        return before, rand(hexed, pick([40, 64])) if odds(0.5) else f"{word()}_{word()}_{d(2)}_{word()}{word()}" if odds(0.5) else f"{word()}-{word()}-{word()}-{d(2)}"

    out = []
    for k in range(n):
        kind, private = list(GENERATORS)[k % len(GENERATORS)], odds(0.5)
        before, mention = made(kind, private)
        out.append((f"{word()} {word()} {before}{mention} {word()}.", mention, int(private), kind))
    return out


def proposals(text: Column, digit: Column) -> Column:
    """All spans that the generators propose, with features: array of (kind, start, end, value, features)."""
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,features:array<double>>>)")

    def proposed(k: int, kind: str) -> Column:
        described = lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), features(x, k).alias("features"))
        gate = F.contains(F.lower(text), F.lit("dot")) & F.contains(F.lower(text), F.lit("at")) if kind == "mailwords" else digit
        return F.when(gate, F.transform(located(text, GENERATORS[kind]), described)).otherwise(none)

    return F.concat(*[proposed(k, kind) for k, kind in enumerate(GENERATORS)])


_MODELS: dict[str, Trees] = {}


def examples(spark: SparkSession, rows: list[tuple[str, str, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of what generators propose on labelled mentions, and whether each proposal is a private mention."""
    df = spark.createDataFrame(rows, "text string, mention string, label int, kind string")
    got = df.select("text", "mention", "label", "kind", F.explode(proposals(F.col("text"), F.lit(True))).alias("x")).select("mention", "label", F.col("kind").alias("own"), "x.kind", "x.value", "x.features").collect()
    covers = lambda r: r["mention"] in r["value"] or r["value"] in r["mention"] and 2 * len(r["value"]) > len(r["mention"])
    return np.array([r["features"] for r in got]), np.array([float(r["label"] and covers(r)) for r in got])


def model(spark: SparkSession) -> Trees:
    """Fitted once a session."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        x, y = examples(spark, mentions())
        _MODELS[key] = boost(x, y, x[:, 0].astype(int))
    return _MODELS[key]


def _with_spans(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of spans: one for each base kind, ``all`` of these, and ``more`` (chosen proposals); their names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    m = model(docs.sparkSession)
    own = {k: unused_name(docs, f"spans_{k}") for k in ("digit", *BASE_KINDS, "all", "more")}
    digit = F.col(own["digit"])
    out = docs.withColumn(own["digit"], text.rlike("[0-9]"))
    plain = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = out.withColumns({own[k]: plain(k, base_spans(text, k, digit)) for k in BASE_KINDS})

    def chosen(all_: Column) -> Column:
        limit = lambda x: F.coalesce(*[F.when(x["kind"] == kind, F.lit(m.thresholds[k])) for k, kind in enumerate(GENERATORS)])
        scored = F.transform(all_, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), m.score(x["features"]).alias("p"), limit(x).alias("least")))
        good = F.filter(scored, lambda x: x["p"] >= x["least"])
        return let(good, lambda g: F.transform(best_of(g, F.col(own["all"])), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))

    out = out.withColumn(own["all"], F.concat(*[F.col(own[k]) for k in BASE_KINDS]))
    return out.withColumn(own["more"], F.array_sort(let(proposals(text, digit), chosen))), own


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans."""
    d, own = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return d.select(
        "doc_id",
        *[F.size(own[k]).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.col(own["all"])).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(own["all"], own["more"])).alias("spans"),
    )


def without(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in the place of each of ``spans``, which are in order and apart."""

    def cut(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            part = lambda k: let(F.greatest(a - k * PIECE, F.lit(0)), lambda low: F.substring(F.get(pieces, k), low + 1, F.least(b - k * PIECE, F.lit(PIECE)) - low))
            at = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
            return F.when(a >= b, "").otherwise(F.array_join(F.transform(at, part), ""))

        ends = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
        gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: between(ends(k), F.coalesce(F.get(spans, k)["start"], F.length(text))))
        return F.array_join(gaps, mark)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1," + str(PIECE) + "}"), F.lit(0)), cut)


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """``docs`` with ``mark`` in the place of every span, spans that overlap or touch taken together."""
    d, own = _with_spans(docs)
    spans = united(F.concat(own["all"], own["more"]))
    text = F.when(F.size(own["all"]) + F.size(own["more"]) > 0, let(spans, lambda s: without(F.col("text"), s, mark))).otherwise(F.col("text"))
    return d.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
