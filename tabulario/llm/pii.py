"""Personal data by weak supervision (operator 7), in DataFrame functions only.

Four strict patterns give the base spans. Looser patterns and failed strict matches give more candidates, and a fifth kind,
`secret` (credentials), has only such. Labelers vote on every candidate: the form of the match, gazetteers of endings,
prefixes and ranges, cue words before it and what it touches. Expectation-maximisation over the counts of vote patterns (a few hundred rows, whatever the corpus) estimates
how reliable each labeler is; the posteriors train a logistic span classifier on votes and shape, again from counts.
Candidates it accepts are added to the base spans, which always stay. A candidate whose form speaks against it (a failed
check digit) or is that of many harmless things (a run of hexadecimal digits) needs a cue word besides, at every size of
the table.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
#: The strict patterns as stated, written so that no attempt starts inside a run that has failed already (linear time).
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser forms: spelt-out addresses, addresses of the other version, other separators, national numbers.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9./_])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9./_])",
    r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z+/_-])(?:[0-9A-Fa-f]{32,128}+|(?:AKIA|AIza|gh[opsu]_|glpat-|sk-|xox[abp]-)[0-9A-Za-z_-]{16,100}+)(?![0-9A-Za-z+/_-])",
)
# Fixed values of the labelers: endings, prefixes and cue words.
GAZETTEER = (
    r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|br|mx|jp)$",
    r"^(?:(?!0|10\.|127\.|22[4-9]\.|2[3-9][0-9]\.)[0-9]{1,3}\.|[23][0-9A-Fa-f]{3}:)",
    r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|62|65)",
    r"^(?:\+|00)?\(?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{2}\))",
    r"^(?:AKIA|AIza|gh[opsu]_|glpat-|sk-|xox[abp]-|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64}|[0-9a-f]{128})$)",
)
CUES = (
    r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|reach)\b",
    r"(?i)\b(?:ip|host|server|address|addr|ping|adresse|client)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b",
    r"(?i)\b(?:tel|phone|call|mobile|cell|fax|telefon|tele?fono|appelez|ring)\b",
    r"(?i)(?<![A-Za-z])(?:token|secret|api[\x20_-]?key|access[\x20_-]?key|passw(?:or)?d|passphrase|pwd|auth|bearer|credentials?)(?![A-Za-z])",
)
PREFIXED = r"^(?:AKIA|AIza|gh[opsu]_|glpat-|sk-|xox[abp]-)"
COUNTER_CUES = r"(?i)(?:\bv(?:ersion|er)?|\border|\binvoice|\bisbn|\bissn|\bdoi|\bserial|\bticket|\bsection|\btoken|\bsha|[#$€£=])[\s.:#]*$"
NO_SECRET_CUES = r"(?i)(?<![A-Za-z])(?:sha|md5|commit|checksum|digest|hash|revision|uuid|guid|etag)[-0-9]*[\s:=#\"'()]*$"
#: A secret varies: this many different characters at least.
VARIED = 8
#: Digits of a card and of a phone number, as stated.
COUNTED = {2: (12, 19), 3: (9, 15)}
CONTEXT = 40
VOTES = ("form", "gazetteer", "cue", "touch")
SHAPES = {"digits": 5, "separators": 3}
CANDIDATE = "array<struct<start:int,kind:int,end:int,strict:boolean,form:int,gazetteer:int,cue:int,touch:int,digits:int,separators:int,prefixed:int,counted:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, step: int = 256) -> Column:
    """For each element of an array the sum of those before it, by blocks: never quadratic in the whole array."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / step).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(sizes, b * step + 1, step)))
    return let(sums, lambda s: let(
        F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))),
        lambda base: F.transform(sizes, lambda _, i: base[F.floor(i / step).cast("int")] + total(
            F.slice(sizes, F.floor(i / step).cast("int") * step + 1, i % step)))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: int, value: Column) -> Column:
    """What a strict match must satisfy besides its pattern."""
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind in COUNTED:
        right = F.length(digits_of(value)).between(*COUNTED[kind])
        return right & luhn(digits_of(value)) if kind == 2 else right
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def candidates(text: Column, kind: int, strict: bool) -> Column:
    """All matches of one pattern as structs of CANDIDATE: place, votes and shape."""
    pattern = F.lit((STRICT if strict else LOOSE)[kind])

    def judged(between: Column, found: Column) -> Column:
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m))

        def one(value: Column, i: Column, end: Column) -> Column:
            before, after, digits = F.right(between[i], F.lit(CONTEXT)), F.left(between[i + 1], F.lit(1)), F.length(digits_of(value))
            letters = F.size(F.array_distinct(F.split(value, "")))
            varied = (letters >= VARIED) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            form = F.when(passes(kind, value), 1).otherwise(-1) if strict else F.when(varied, 1).otherwise(-1) if kind == SECRET else F.lit(0)
            bad = r"[\p{L}_/\\]" if kind == SECRET else r"[\p{L}_=/\\]"  # what a name is set equal to may well be a secret
            kinds_of_mark = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit(r"[^0-9A-Za-z]"), F.lit(0))))
            return F.struct(
                (end - F.length(value)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.lit(strict).alias("strict"),
                form.alias("form"),
                F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
                vote(before.rlike(CUES[kind]), before.rlike(NO_SECRET_CUES if kind == SECRET else COUNTER_CUES)).alias("cue"),
                F.when(F.right(before, F.lit(1)).rlike(bad) | after.rlike(bad), -1).otherwise(1).alias("touch"),
                F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 16, 3).otherwise(4).alias("digits"),
                F.least(kinds_of_mark, F.lit(2)).alias("separators"), F.when(value.rlike(PREFIXED), 1).otherwise(0).alias("prefixed"),
                (digits.between(*COUNTED[kind]) if strict and kind in COUNTED else F.lit(True)).alias("counted"))

        every = let(sizes, lambda s: let(running(s), lambda base: F.transform(
            found, lambda m, i: one(m, i, base[i] + s[i]))))
        # a number of another length is no failed card or phone but another number
        return F.filter(every, lambda c: c.counted)

    gates = [[text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), text.rlike(r"\+[0-9]")],
             [text.rlike(r"[\[(](?:at|AT)[\])]"), text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), text.rlike("[0-9][./_][0-9]{4}[./_]"),
              text.rlike(r"[0-9]\)?[\x20.-][0-9]{3}[\x20.-][0-9]"),
              text.rlike("[0-9A-Fa-f]{32}|" + PREFIXED.replace("^", ""))]][not strict]
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda b: judged(b, m))))
    return F.coalesce(F.when(gates[kind], found), F.array().cast(CANDIDATE))


def all_candidates(text: Column) -> Column:
    """Strict matches, failed ones included, and looser ones that touch no good strict match; secrets may hold one."""
    strict = F.concat(*(candidates(text, k, True) for k in range(4)))
    loose = F.concat(*(candidates(text, k, False) for k in range(len(KINDS))))
    meets = lambda a, b: (a.start < b.end) & (b.start < a.end)
    return let(strict, lambda s: F.concat(s, F.filter(
        loose, lambda c: (c.kind == SECRET) | ~F.exists(s, lambda b: (b.form == 1) & meets(b, c)))))


@dataclass(frozen=True)
class Model:
    """Reliability of each labeler, P(vote | kind, right or wrong), and the weights of the span classifier."""

    reliability: dict
    weights: dict
    cut: float = 0.5

    def accepted(self, c: Column) -> Column:
        """Whether the classifier takes a candidate, and a cue stands before it where one is needed. Kinds never seen are not taken."""
        total = F.lit(0.0)
        for name, w in self.weights.items():
            if name[0] == "kind":
                total = total + F.when(c.kind == name[1], w).otherwise(0.0)
            else:
                total = total + F.when((c.kind == name[1]) & (c.getField(name[0]) == name[2]), w).otherwise(0.0)
        bare = (c.form == -1) | ((c.kind == SECRET) & (c.prefixed == 0))
        uniform = (c.kind == SECRET) & (c.form == -1)  # a run of few different characters is no secret, whatever stands before it
        return (total > math.log(self.cut / (1 - self.cut))) & (~bare | (c.cue == 1)) & ~uniform

    def spans(self, found: Column) -> Column:
        """Base spans and added ones, by start, then kind. An added span other than a secret gives way to a base span, and
        any to a longer added one that it meets, of equally long ones to the earlier."""
        base = F.filter(found, lambda c: c.strict & (c.form == 1))
        extra = F.filter(found, lambda c: ~(c.strict & (c.form == 1)) & self.accepted(c))
        meets = lambda a, b: (a.start < b.end) & (b.start < a.end)
        rank = lambda c: F.struct(c.start - c.end, c.start, c.kind)
        return let(F.struct(base.alias("b"), extra.alias("e")), lambda x: F.array_sort(F.concat(x.b, F.filter(
            x.e, lambda c: ((c.kind == SECRET) | ~F.exists(x.b, lambda b: meets(b, c))) & ~F.exists(x.e, lambda o: (rank(o) < rank(c)) & meets(o, c))))))


def expectation(rows: list[tuple], rounds: int = 60) -> tuple[dict, dict]:
    """EM over (kind, votes, count): reliabilities and the posterior of each vote pattern.

    Labelers are taken to err independently given the truth. Pseudo-counts start each of them as better than chance, which
    also settles which of the two classes is "right".
    """
    prior = {k: 0.5 for k in range(len(KINDS))}
    start = {1: {1: 0.7, 0: 0.2, -1: 0.1}, 0: {1: 0.1, 0: 0.2, -1: 0.7}}
    neutral = {1: {1: 0.35, 0: 0.4, -1: 0.25}, 0: {1: 0.25, 0: 0.4, -1: 0.35}}
    begin = lambda j: start if j == 0 else neutral  # noqa: E731  the form knows most to begin with
    reliability = {(k, j, y, v): begin(j)[y][v] for k, j, y, v in product(range(len(KINDS)), range(len(VOTES)), (0, 1), (-1, 0, 1))}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes, _n in rows:
            odds = [(1 - prior[kind], prior[kind])[y] * math.prod(reliability[kind, j, y, v] for j, v in enumerate(votes)) for y in (0, 1)]
            posterior[kind, votes] = odds[1] / sum(odds)
        mass = {k: [2.0, 2.0] for k in range(len(KINDS))}
        for kind, votes, n in rows:
            for y, p in enumerate((1 - posterior[kind, votes], posterior[kind, votes])):
                mass[kind][y] += p * n
        for k in range(len(KINDS)):
            prior[k] = mass[k][1] / sum(mass[k])
        count = {key: 20 * begin(key[1])[key[2]][key[3]] for key in reliability}
        for kind, votes, n in rows:
            for j, v in enumerate(votes):
                count[kind, j, 1, v] += posterior[kind, votes] * n
                count[kind, j, 0, v] += (1 - posterior[kind, votes]) * n
        reliability = {(k, j, y, v): count[k, j, y, v] / sum(count[k, j, y, u] for u in (-1, 0, 1)) for k, j, y, v in count}
    return reliability, posterior


def features(kind: int, votes: tuple, shape: tuple) -> list[tuple]:
    return [("kind", kind), *((n, kind, v) for n, v in zip(VOTES, votes)), *((n, kind, v) for n, v in zip(SHAPES, shape))]


def classifier(rows: list[tuple], posterior: dict, rounds: int = 300, rate: float = 1.0, decay: float = 0.01) -> dict:
    """Logistic regression on (kind, votes, shape, count) with the posteriors as soft labels."""
    weights: dict[tuple, float] = {}
    size = {k: sum(n for kind, _, _, n in rows if kind == k) for k in range(len(KINDS))}
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        for kind, votes, shape, n in rows:
            names = features(kind, votes, shape)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in names)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + (posterior[kind, votes] - p) * n / size[kind]
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * (g - decay * weights.get(f, 0.0) / 10)
    return weights


def fit(df: DataFrame, text: str = "text") -> Model:
    """Count candidates of all texts by votes and shape (a bounded number of groups) and fit the model to the counts."""
    each = df.select(F.explode(all_candidates(F.col(text).cast("string"))).alias("c")).select("c.*")
    groups = each.groupBy("kind", *VOTES, *SHAPES).count().collect()  # at most 5 * 3^4 * 15 rows
    rows = [(g["kind"], tuple(g[v] for v in VOTES), tuple(g[s] for s in SHAPES), g["count"]) for g in groups]
    totals: dict[tuple, int] = {}
    for kind, votes, _, n in rows:
        totals[kind, votes] = totals.get((kind, votes), 0) + n
    reliability, posterior = expectation([(k, v, n) for (k, v), n in sorted(totals.items())])
    return Model(reliability, classifier(sorted(rows), posterior))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in code points."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda c: F.concat(name(c.kind), F.lit(":"), c.start.cast("string"), F.lit(":"), c.end.cast("string"))), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the number of base spans of each kind, base_sha256 and all spans.

    Null and empty texts have none. Spans of different kinds may overlap when they are base spans. Repeated rows get
    equal rows.
    """
    slim = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    model = fit(slim, "_text")

    def digest(found: Column) -> Column:
        base = F.array_sort(F.filter(found, lambda c: c.strict & (c.form == 1)))
        return let(base, lambda b: F.struct(
            *(F.size(F.filter(b, lambda c: c.kind == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)),
            F.sha2(written(b), 256).alias("base_sha256"), written(model.spans(found)).alias("spans")))

    return slim.select(key, let(all_candidates(F.col("_text")), digest).alias("_d")).select(key, "_d.*")


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; of spans that meet the outer bounds go together.

    Only `text` changes; null stays null.
    """
    def masked(t: Column) -> Column:
        def cut(spans: Column) -> Column:
            # spans in order; one that starts before an earlier one has ended only stretches it
            before = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda c: c.end)), F.lit(0))
            name = lambda k: F.element_at(F.array(*(F.lit(f"<{x}>") for x in KINDS)), k + 1)
            parts = F.transform(spans, lambda c, i: let(before(i), lambda e: F.when(
                c.start >= e, F.concat(F.substring(t, e + 1, c.start - e), name(c.kind))).otherwise(F.lit(""))))
            return F.concat(F.array_join(parts, ""), F.substring(t, F.array_max(F.transform(spans, lambda c: c.end)) + 1, F.length(t)))

        return let(model.spans(all_candidates(t)), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(t))

    return df.withColumn(text, masked(F.col(text).cast("string")))
