"""Personal data by weak supervision, with built-in expressions only.

Base kinds are plain patterns with checks; their spans always stay. Further candidates (local phone numbers, personal
numbers, account numbers, secrets) and base matches that failed their check are voted on by labelers: shape,
gazetteer of known beginnings, words before the span, misleading words before it, and mixture of signs. Each says
yes, no or nothing. Votes are counted per kind and pattern over all documents, which bounds what reaches the
driver by kinds x 3^labelers x buckets. Expectation-maximisation estimates from the counts how reliable each
labeler is, and the resulting soft labels train a logistic classifier over votes and span statistics, which
decides about every further candidate.

Positions are code points. They come from splitting the text by the same pattern: running lengths of pieces and
matches. Patterns have no repeated groups that recurse per sign, so very long runs are safe, and texts
without a digit or an at sign are passed over at once.

Defined results: NULL counts as empty and has no spans; an empty table gives no rows; repeated rows are judged each. Candidates that overlap a base span, or an earlier
candidate, are dropped. Without candidates the classifier accepts nothing. Extra columns are kept, unless
their names begin with ``_pii``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
MORE_KINDS = ["local_phone", "person_number", "account", "secret"]
KINDS = BASE_KINDS + MORE_KINDS
#: A sign that may not stand in front of the marks used below; it only replaces itself.
MARK = "\u0001"
#: Separators between digits, and dots between the labels of a name, become a mark first. So these patterns are runs of
#: signs, not repeated groups, which would need a call per repeat.
JOINS = {"card": r"(?<=[0-9])[\x20-](?=[0-9])", "email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"}
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9.\u0001_%+-])|\\G)[A-Za-z0-9.\u0001_%+-]++@[A-Za-z0-9-]++\u0001[A-Za-z0-9\u0001-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9][0-9\u0001]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # In one piece, or in groups of four as it is printed.
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
}
# Beginnings of issued keys, country codes of account numbers, area codes of large cities, words before personal
# data, and before other numbers.
KEY_STARTS = "AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|eyJ"
COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
AREAS = "202|206|212|213|214|215|216|303|305|310|312|313|314|315|404|408|412|415|416|503|504|512|514|602|604|612|613|614|615|617|619|702|703|704|713|718|808|816|817|901|904|913|916|917|919"
CUES = "token|password|passwd|secret|api.?key|access.?key|phone|tel|mobile|call|fax|ssn|social security|iban|account|konto|contact"
MISLEADING = "isbn|issn|doi|version|order|invoice|page|commit|md5|sha1|sha256|checksum|article"
BEFORE = 24
LABELERS = ["shape", "gazetteer", "cue", "misleading", "mixture"]


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's matches, leftmost and non-overlapping."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.transform(values, lambda v, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(v).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + x["size"]
        return F.struct(end.alias("at"), F.array_append(acc["ends"], end).alias("ends"))

    ends = F.aggregate(lengths, empty, step)["ends"]
    return F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:int,start:int,end:int,value:string,before:string,passed:boolean>>"


def _described(text: Column, number: int, kind: str) -> Callable[[Column], Column]:
    """A match with its kind, the text before it and whether it passes its check."""

    def describe(m: Column) -> Column:
        begin = F.greatest(m["start"] - BEFORE, F.lit(0))
        return F.struct(
            F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            F.lower(F.substring(text, begin + 1, m["start"] - begin)).alias("before"), _passes(kind, m["value"]).alias("passed"))

    return describe


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_pii_base``, the base spans, and ``_pii_more``, the candidates to be voted on."""
    body = F.coalesce(F.col(text), F.lit(""))
    some = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    nothing = F.array().cast(_SPAN)
    rows = docs.withColumn("_pii_text", F.when(some, body))
    whole = F.col("_pii_text")
    # A kind is searched only where one of its signs is.
    where = {"email": F.contains(whole, F.lit("@")), "phone": whole.rlike(r"\+[0-9]"), "ip": whole.rlike(r"[0-9]\.[0-9]"),
             "secret": whole.rlike("[0-9]"), "account": whole.rlike("[A-Z]{2}[0-9]{2}")}
    raw = []
    for number, kind in enumerate(KINDS):
        name = f"_pii_{kind}"
        source = F.regexp_replace(F.translate(whole, MARK, "\u0002"), JOINS[kind], MARK) if kind in JOINS else whole
        rows = rows.withColumn(name, F.when(F.coalesce(where.get(kind, whole.rlike("[0-9]")), F.lit(False)), _matches(source, PATTERNS[kind])))
        raw.append(F.coalesce(F.transform(name, _described(whole, number, kind)), nothing))
    rows = rows.withColumn("_pii_all", F.flatten(F.array(*raw)))
    rows = rows.withColumn("_pii_base", F.array_sort(F.transform(
        F.filter("_pii_all", lambda s: (s["kind"] < len(BASE_KINDS)) & s["passed"]),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    # What failed is kept as evidence for the labelers only if it looks like more than a bare number.
    more = F.filter("_pii_all", lambda s: (
        ((s["kind"] >= len(BASE_KINDS)) | (~s["passed"] & (F.length(_digits(s["value"])) >= 7)))
        & ((s["kind"] != KINDS.index("secret")) | s["value"].rlike("[0-9]"))
        & ~F.exists("_pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    rows = rows.withColumn("_pii_more", more)
    return rows.drop("_pii_text", "_pii_all", *[f"_pii_{k}" for k in KINDS])


def _votes(s: Column) -> list[Column]:
    """One vote per labeler: 1 yes, -1 no, 0 nothing."""
    value, before, kind = s["value"], s["before"], s["kind"]
    number = lambda k: KINDS.index(k)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    letters, digits = value.rlike("[A-Za-z]"), value.rlike("[0-9]")
    secret = kind == number("secret")
    shape = F.when(secret, vote(value.rlike("^[0-9a-f]{18,}$") | value.rlike("^[A-Z0-9]{20}$"), ~letters)).when(
        kind == number("local_phone"), vote(value.rlike(r"^\([0-9]{3}\) "), value.rlike("^[01]"))).when(
        kind == number("person_number"), vote(~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$"), F.lit(True))).when(
        kind == number("account"), vote(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & value.rlike("^[A-Z]{2}[0-9]{2}"), F.lit(False))).otherwise(-1)
    known = F.when(secret, vote(value.rlike(f"^({KEY_STARTS})"), F.lit(False))).when(
        kind == number("account"), vote(value.rlike(f"^({COUNTRIES})"), F.lit(True))).when(
        kind == number("local_phone"), vote(
            # The numbering plan gives no area or exchange that begins with 0 or 1, and none that ends with 11.
            value.rlike(rf"^\(?({AREAS})\)?[ .-](?![2-9]11)[2-9]"), value.rlike(r"^\(?([01]|[2-9]11|[2-9]9)") | value.rlike(r"[ .-]([01][0-9]{2}|[2-9]11)[ .-]"))).otherwise(0)
    cue = vote(before.rlike(f"({CUES})"), F.lit(False))
    wrong = vote(F.lit(False), before.rlike(f"({MISLEADING})"))
    mixture = F.when(secret, vote(letters & digits & (F.size(F.array_distinct(F.split(value, ""))) >= 8), ~(letters & digits))).otherwise(0)
    return [shape, known, cue, wrong, mixture]


def _judged(s: Column) -> Column:
    length = F.length(s["value"])
    share = F.length(_digits(s["value"])) / length
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        *[v.cast("int").alias(f"v{i}") for i, v in enumerate(_votes(s))],
        F.least(F.floor(length / 8), F.lit(4)).cast("int").alias("size"), F.floor(share * 3).cast("int").alias("digits"))


@dataclass(frozen=True)
class PiiModel:
    #: Accuracy of each labeler's yes and no votes, and weights of the classifier.
    reliability: tuple[tuple[float, float], ...]
    weights: tuple[float, ...]
    bias: float
    cut: float = 0.5

    def accepts(self, s: Column) -> Column:
        total = F.lit(self.bias)
        for i in range(len(LABELERS)):
            total = total + F.when(s[f"v{i}"] == 1, self.weights[2 * i]).when(s[f"v{i}"] == -1, self.weights[2 * i + 1]).otherwise(0.0)
        at = 2 * len(LABELERS)
        total = total + s["size"] * self.weights[at] + s["digits"] * self.weights[at + 1]
        return total >= math.log(self.cut / (1 - self.cut))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Soft labels of vote patterns, and per labeler the chance of yes and of no given true and given false spans."""
    n = votes.shape[1]
    # Start from majority; each labeler is taken to be better than chance.
    soft = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    chance = np.zeros((n, 2, 3))
    for _ in range(rounds):
        for i in range(n):
            for c, w in enumerate((soft * counts, (1 - soft) * counts)):
                by = np.array([w[votes[:, i] == v].sum() for v in (-1, 0, 1)])
                # Prior counts keep a labeler from turning into its opposite on little evidence.
                prior = np.array([1.0, 2.0, 4.0]) if c == 0 else np.array([4.0, 2.0, 1.0])
                chance[i, c] = (by + prior) / (by + prior).sum()
        rate = np.clip((soft * counts).sum() / counts.sum(), 0.01, 0.99)
        logit = np.full(len(votes), math.log(rate / (1 - rate)))
        for i in range(n):
            logit += np.log(chance[i, 0, votes[:, i] + 1]) - np.log(chance[i, 1, votes[:, i] + 1])
        soft = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return soft, chance


def fit(docs: DataFrame, text: str = "text") -> PiiModel:
    """Count votes over all documents, estimate reliabilities and train the span classifier."""
    spans = candidates(docs.select(F.col(text).alias("text"))).select(F.explode(F.transform("_pii_more", _judged)).alias("s")).select("s.*")
    names = [f"v{i}" for i in range(len(LABELERS))]
    rows = spans.groupBy("kind", *names, "size", "digits").count().collect()  # bounded by kinds, votes and buckets
    if not rows:
        return PiiModel(((0.5, 0.5),) * len(LABELERS), (0.0,) * (2 * len(LABELERS) + 2), -1.0)
    votes = np.array([[r[v] for v in names] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    soft, chance = estimate(votes, counts)
    x = np.concatenate([np.stack([votes == 1, votes == -1], axis=2).reshape(len(rows), -1).astype(float),
                        np.array([[r["size"], r["digits"]] for r in rows], float)], axis=1)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weights = np.zeros(x.shape[1])
    share = counts / counts.sum()
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (soft - p)) - 1e-3 * weights
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    reliability = tuple((float(c[0, 2] / (c[0, 2] + c[1, 2])), float(c[1, 0] / (c[0, 0] + c[1, 0]))) for c in chance)
    return PiiModel(reliability, tuple(map(float, weights[:-1])), float(weights[-1]))


def annotate(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted ``(start, kind, end)``, kind as a number in ``KINDS``."""
    rows = candidates(docs, text)
    taken = F.transform(F.filter(F.transform("_pii_more", _judged), lambda s: (s["kind"] >= len(BASE_KINDS)) & model.accepts(s)),
                        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.withColumn("_pii_taken", F.array_sort(taken))
    # Of overlapping candidates the first stays.
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("kept"))
    kept = F.aggregate("_pii_taken", start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc))["kept"]
    rows = rows.withColumn("_pii_taken", F.when(F.size("_pii_taken") > 0, kept).otherwise(F.col("_pii_taken")))
    return rows.withColumn("base", F.col("_pii_base")).withColumn(
        "spans", F.array_sort(F.concat("_pii_base", "_pii_taken"))).drop("_pii_base", "_pii_more", "_pii_taken")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(annotated: DataFrame, text: str = "text") -> DataFrame:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.array_append(F.array_append(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])), F.get(names, s["kind"])).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], longer).otherwise(inside)

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))

    return annotated.withColumn(text, F.when(F.size("spans") > 0, F.aggregate("spans", start, step, close)).otherwise(F.col(text)))
