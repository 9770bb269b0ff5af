"""Personal data: base patterns, and further spans chosen by boosted trees over high-recall candidates.

Everything runs as DataFrame expressions on one row per document, with no shuffle and no Python on the executors. The
base kinds (email, ip, card, phone) are found leftmost and non-overlapping, then tested; what fails is dropped. Four
generators propose further, possibly overlapping candidates (local phone numbers, secrets, identity numbers, bank
account numbers). Format and context features of every candidate go through gradient-boosted trees, and a calibrated
probability at or above the kind's threshold selects it. A selected candidate that overlaps a base span, or a selected
candidate with a higher probability (ties: the earlier, then the longer), is left out.

The trees are fitted on the driver over candidates found by the same expressions in a labelled table that a seeded rule
writes (EXAMPLES rows per kind); half fit the trees, the other half calibrates them and sets the thresholds.

Defined results: a null text counts as empty and has no spans, redact() keeps it null; repeated rows each have their own
result; other columns pass through.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import boosted, calibrated, expression, value

BASE = ("email", "ip", "card", "phone")
EXTRA = ("local_phone", "secret", "identity", "account")

# The same matches as the plain forms: a run that cannot start a match is not tried again at each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}[\x20.-]?[0-9]{2,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+=?=?",
    "identity": r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2,3}[\x20-][0-9]{3,4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What every match holds; texts without it are not searched.
NEEDS = {"email": "@", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

CONTEXT = 32
EXAMPLES = 300
SEED = 7
PRECISION = 0.95

FEATURES = (
    "kind", "length", "digits", "digit_share", "groups", "hex", "variety", "upper",
    "near_secret", "near_phone", "near_identity", "near_account", "quoted", "assigned",
)

_SPAN = "array<struct<s:int,e:int,v:string>>"


def _spans(text: Column, kind: str) -> Column:
    """All matches as array of (s, e, v): code points, end exclusive. Offsets are running sums in blocks of 128."""
    regex = PATTERNS[kind]
    wanted = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v")))

    def block(xs: Column, start: Column) -> Column:
        empty = F.struct(start.cast("int").alias("at"), F.array().cast(_SPAN).alias("out"))
        step = lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["v"].alias("v")))).alias("out"))
        return F.aggregate(xs, empty, step)["out"]

    def blocks(xs: Column) -> Column:
        n = F.floor((F.size(xs) - 1) / 128).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(xs, i * 128 + 1, 128))
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        both = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda a, x: a + x).alias("at")))
        return F.flatten(F.transform(both, lambda b: block(b["p"], b["at"])))

    # One element holds the list, so that it is computed once for the several uses.
    held = F.transform(F.array(lengths), lambda xs: F.when(F.size(xs) <= 128, block(xs, F.lit(0))).otherwise(blocks(xs)))
    return F.when(wanted, F.element_at(held, 1)).otherwise(F.array().cast(_SPAN))


def _valid(kind: str):
    if kind == "ip":
        return lambda x: x["v"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = lambda x: F.regexp_replace(x["v"], "[ -]", "")
        return lambda x: F.length(digits(x)).between(13, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", "")).between(9, 15)
    return lambda x: F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(_spans(text, kind), _valid(kind))


def _features(text: Column, kind: str) -> Column:
    """Candidates of a generator with their features, as array of struct(s, e, f)."""
    number = lambda c: c.cast("double")

    def of(x: Column) -> Column:
        v = x["v"]
        length = F.length(v)
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        before = F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        after = F.substring(text, x["e"] + 1, F.lit(1))
        near = lambda words: number(before.rlike(rf"(?i)(?<![a-z])(?:{words})(?![a-z])"))
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.array(
                F.lit(float(EXTRA.index(kind))),
                number(length),
                number(digits),
                digits / length,
                number(F.length(F.regexp_replace(v, r"[^\x20()./-]", ""))),
                number(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
                F.size(F.array_distinct(F.split(v, ""))) / length,
                number(v.rlike("[A-Z]")),
                near("token|secret|api_?key|key|password|passwd|auth|bearer"),
                near("tel|phone|telephone|call|fax|mobile|cell|telefon|tél|teléfono"),
                near("ssn|sin|social|identity|passport|insurance"),
                near("iban|account|bank|konto|compte|cuenta"),
                number(before.rlike("[\"'`]$") & after.rlike("[\"'`]")),
                number(before.rlike("[=:]\\s*[\"'`]?$")),
            ).alias("f"),
        )

    return F.transform(_spans(text, kind), of)


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled texts, each with one candidate of one kind: 1 where it is personal data."""
    rnd = random.Random(seed)
    digit = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = letters + letters.lower() + "0123456789_-"
    filler = lambda: " ".join(some("abdeghilnorstu", rnd.randint(2, 8)) for _ in range(rnd.randint(2, 6)))
    out = []
    for _ in range(count):
        good = rnd.random() < 0.5
        number = rnd.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(4)} {digit(3)} {digit(3)}"])
        other = rnd.choice([f"{digit(3)}.{digit(2)}.{digit(3)}", f"{digit(2)}/{digit(2)}/{digit(4)}", f"{digit(4)}-{digit(2)}-{digit(2)}", f"{digit(3)} {digit(3)} {digit(3)}"])
        out.append((f"{filler()} {rnd.choice(['call', 'phone', 'tel:', 'fax', 'mobile', 'Tel.'])} {number} {filler()}" if good else f"{filler()} {rnd.choice(['page', 'date', 'version', 'about', ''])} {other} {filler()}", int(good)))
        good = rnd.random() < 0.5
        key = rnd.choice([some(hexes, 32), some(hexes, 40), some(hexes.upper(), 40), some(mixed, 32) + "7", some(hexes, 64)])
        sign, quote = rnd.choice([" = ", "=", ": ", ":"]), rnd.choice(['"', "'", '"', ""])
        word = rnd.choice(["token", "secret", "api_key", "password", "TOKEN", "auth", "key"])
        plain = rnd.choice([f"commit {some(hexes, 40)}", f"figure-{some('abdeghilnorst', 16)}-{digit(2)}", f"sha {some(hexes, 64)}", f"{some('abdeghilnorst', 24)}{digit(1)}", f"/{some('abdeghil', 9)}/{some('norstu', 8)}/{digit(4)}/{some('abd', 5)}", digit(24)])
        out.append((f"{filler()} {word}{sign}{quote}{key}{quote} {filler()}" if good else f"{filler()} {plain} {filler()}", int(good)))
        good = rnd.random() < 0.5
        out.append((f"{filler()} {rnd.choice(['SSN', 'ssn:', 'social security', 'SIN', 'passport', 'insurance no'])} {rnd.choice([f'{digit(3)}-{digit(2)}-{digit(4)}', f'{digit(3)}-{digit(3)}-{digit(3)}'])} {filler()}" if good else f"{filler()} {rnd.choice(['part', 'row', '', 'isbn'])} {rnd.choice([f'{digit(3)}-{digit(2)}-{digit(4)}', f'{digit(3)} {digit(3)} {digit(3)}'])} {filler()}", int(good)))
        good = rnd.random() < 0.5
        code = f"{some(letters, 2)}{digit(2)}" + "".join(f" {digit(4)}" for _ in range(rnd.randint(3, 6)))
        out.append((f"{filler()} {rnd.choice(['IBAN', 'account', 'Konto', 'bank:', 'cuenta'])} {rnd.choice([code, code.replace(' ', '')])} {filler()}" if good else f"{filler()} {some(letters, 2)}{digit(2)}{some(letters + '0123456789', 8)} {filler()}", int(good)))
    return out


class Model:
    """Trees, calibration and thresholds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        fit = np.arange(len(y)) % 2 == 0
        self.trees = boosted(x[fit], y[fit])
        raw = sum(value(t, x[~fit]) for t in self.trees)
        self.slope, self.intercept = calibrated(raw, y[~fit])
        p = 1 / (1 + np.exp(-(self.slope * raw + self.intercept)))
        #: Per kind, the least probability at which the held-out half reaches PRECISION; 0.5 at least.
        self.thresholds = []
        for kind in range(len(EXTRA)):
            own = x[~fit][:, 0] == kind
            good = [t for t in sorted(set(p[own])) if t >= 0.5 and y[~fit][own][p[own] >= t].mean() >= PRECISION]
            self.thresholds.append(float(good[0]) if good else 1.1)

    def probability(self, features: Column) -> Column:
        parts = [features[i] for i in range(len(FEATURES))]
        raw = functools.reduce(lambda a, b: a + b, [expression(t, parts) for t in self.trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * F.lit(self.slope) + F.lit(self.intercept))))


_fitted: dict[int, Model] = {}


def fitted(spark: SparkSession) -> Model:
    if SEED not in _fitted:
        df = spark.createDataFrame(examples(), "text string, y int")
        rows = df.select("y", F.flatten(F.array(*[_features(F.col("text"), k) for k in EXTRA])).alias("c")).select("y", F.explode("c.f").alias("f")).collect()
        _fitted[SEED] = Model(np.array([r.f for r in rows], float), np.array([r.y for r in rows], float))
    return _fitted[SEED]


def _tagged(spans: Column, kind: str, probability) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), probability(x).alias("p")))


def _at_least(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda x: x["p"] >= F.lit(threshold))


def detect(docs: DataFrame) -> DataFrame:
    """docs with a column `spans`: array of struct(kind, s, e, p) by kind in the order of BASE + EXTRA, then start."""
    model = fitted(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = docs.columns
    base = F.flatten(F.array(*[_tagged(base_spans(text, k), k, lambda x: F.lit(1.0)) for k in BASE]))
    extra = F.flatten(F.array(*[_at_least(_tagged(_features(text, k), k, lambda x: model.probability(x["f"])), model.thresholds[i]) for i, k in enumerate(EXTRA)]))
    has_digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:string,s:int,e:int,p:double>>")
    found = docs.select(*[F.col(f"`{c}`") for c in names], base.alias("__base"), F.when(has_digit, extra).otherwise(none).alias("__extra"))
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    better = lambda a, b: (b["p"] > a["p"]) | (b["p"] == a["p"]) & ((b["s"] < a["s"]) | (b["s"] == a["s"]) & (b["e"] > a["e"]))
    chosen = F.filter("__extra", lambda x: ~F.exists("__base", lambda b: meets(x, b)) & ~F.exists("__extra", lambda b: meets(x, b) & better(x, b)))
    spans = F.when(F.size("__extra") == 0, F.col("__base")).otherwise(F.concat("__base", chosen))
    return found.select(*[F.col(f"`{c}`") for c in names], spans.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all kinds), n_secret."""
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return detect(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(line(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        count("secret"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    found = detect(docs)
    text = F.col("text")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(-x["e"] <= a["at"], a).otherwise(
        F.struct(
            (-x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).alias("out"),
        )
    )
    parts = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, parts).otherwise(text).alias("text")
    return found.select(*[new if c == "text" else F.col(f"`{c}`") for c in docs.columns])
