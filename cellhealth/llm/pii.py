"""Personal data by weak supervision (DataFrame functions only).

Base spans are those of four patterns with their checks. Candidates are the base spans and matches of weaker
patterns: numbers written without a country code, addresses with the sign spelled out. Labelers vote on
each candidate, 1 for personal data, -1 against, 0 for no opinion: the strict pattern, gazetteers
(domain endings, country and issuer codes), the words before it, and the digits' variety. How often each
combination of votes and shape occurs is counted over all candidates; from those counts expectation-maximisation
estimates the labelers' reliabilities per kind, and a logistic classifier over votes and shape is trained on
the estimated labels. Candidates it accepts join the base spans, which always stay.

Only the counts of combinations (some thousands at most, whatever the input) reach the driver. Places are
code points, end exclusive. Null and empty texts have no spans. Repeated rows have the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; possessive, and begun only where a match can begin, so that long runs cost their length.
#: ``card`` takes whole runs of digits of a card's length only, as tables of figures have very many others.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEAK = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without these has no match.
NEEDS = {"email": "@", "phone": "+"}
ENDINGS = "com org net edu gov info io co uk de fr es it nl eu us ca example test".split()
COUNTRY_CODES = "1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "3[0-9]|4|5[0-9]|2[2-7]|6[0-9]"
CUES = {"email": "mail|contact|write|reach", "ip": "ip|host|server|address|login|from", "card": "card|visa|master|amex|pay|credit", "phone": "phone|call|tel|mobile|fax|contact|dial"}
AGAINST = "version|order|isbn|invoice|item|serial|build"
CONTEXT = 40
ROUNDS, STEPS, RATE = 30, 300, 0.5
ACCEPT = 0.5
#: Numbers added up at once, and how often blocks of them are gathered into blocks.
_BLOCK, _LEVELS = 32, 3


def _with_starts(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``s{i}``, the running sums of ``l{i}``, for n lists: where each match starts.

    Sums go up by blocks, blocks of blocks and so on, and come down as running sums, so an element costs a block
    at most. Each level is a column and read twice in the next: an expression within a lambda, or a column that the
    optimizer puts there, would be evaluated again for every element.
    """
    bits, rest = _BLOCK.bit_length() - 1, _BLOCK - 1
    total = lambda part: f"aggregate({part}, 0, (sum, x) -> sum + x)"

    def blocks(a: str) -> Column:
        sums = f"transform(sequence(0, shiftright(size({a}) - 1, {bits})), b -> {total(f'slice({a}, b * {_BLOCK} + 1, {_BLOCK})')})"
        return F.expr(f"if(size({a}) > {_BLOCK}, {sums}, null)")

    def running(a: str, above: str | None) -> Column:
        if above is None:
            return F.expr(f"transform({a}, (own, k) -> {total(f'slice({a}, 1, k + 1)')})")
        carried = f"if({above} is not null and k >= {_BLOCK}, get({above}, shiftright(k, {bits}) - 1), 0)"
        return F.expr(f"transform({a}, (own, k) -> {carried} + {total(f'slice({a}, k - (k & {rest}) + 1, (k & {rest}) + 1)')})")

    levels = [[f"l{i}" for i in range(n)]] + [[f"l{i}_{up}" for i in range(n)] for up in range(1, _LEVELS + 1)]
    for low, high in zip(levels, levels[1:]):
        rows = rows.withColumns({h: blocks(a) for a, h in zip(low, high)})
    above = [None] * n
    for up in range(_LEVELS, -1, -1):
        names = [f"s{i}" if not up else f"s{i}_{up}" for i in range(n)]
        rows = rows.withColumns({s: running(a, h) for a, h, s in zip(levels[up], above, names)})
        above = names
    return rows


def _luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda x, y: x + y) % 10 == 0


def _passes(kind: str, value: Column, digits: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, strict: Column, value: Column, digits: Column, before: Column) -> tuple[Column, Column, Column, Column]:
    lowered = F.lower(value)
    if kind == "email":
        known = F.regexp_replace(lowered, r"^.*[.\])]\x20?", "").isin(*ENDINGS)
    elif kind == "ip":
        known = ~value.rlike(r"^(?:0|127|169|2[2-5][0-9])\.")
    elif kind == "card":
        known = digits.rlike(f"^(?:{ISSUERS})")
    else:
        known = value.rlike(rf"^\+(?:{COUNTRY_CODES})|^\(?[2-9][0-9]{{2}}")
    cue, against = before.rlike(rf"(?i)\b(?:{CUES[kind]})"), before.rlike(rf"(?i)\b(?:{AGAINST})")
    varied = F.size(F.array_distinct(F.split(digits, "")))
    dull = (F.length(digits) >= 7) & (varied <= 2)
    return F.when(strict, 1).otherwise(0), F.when(known, 1).otherwise(-1), _sign(cue, against), F.when(dull, -1).otherwise(0)


def _judged(i: int, kind: str, strict: bool) -> Column:
    """The candidates among the matches ``h{i}`` with the starts ``s{i}`` and the ends of what lies before them, ``e{i}``."""
    ends = F.col(f"e{i}")
    spans = F.expr(f"transform(slice(s{i}, 1, size(h{i})), (start, k) -> struct(start, get(h{i}, k) as value, regexp_replace(get(h{i}, k), '[^0-9]', '') as digits, k))")
    tried = F.filter(spans, lambda s: _passes(kind, s["value"], s["digits"])) if strict else spans

    def behind(s):
        last, k = F.get(ends, s["k"]), s["k"]
        # A piece holds a match, so as many pieces as the context has places are enough.
        joined = F.array_join(F.slice(ends, F.greatest(k - (CONTEXT - 2), F.lit(1)), F.least(k + 1, F.lit(CONTEXT))), "")
        before = F.when(F.length(last) == CONTEXT, last).otherwise(F.substring(joined, -CONTEXT, CONTEXT))
        return F.struct(s["start"].alias("start"), s["value"].alias("value"), s["digits"].alias("digits"), before.alias("before"))

    def judge(s):
        value = s["value"]
        base = F.lit(strict)
        votes = [v.cast("int").alias(f"v{j}") for j, v in enumerate(_votes(kind, base, value, s["digits"], s["before"]))]
        shape = F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int")
        ends = s["start"].alias("start"), (s["start"] + F.length(value)).alias("end")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), *ends, base.alias("base"), *votes, shape.alias("shape"), value.rlike(r"[\x20().-]").cast("int").alias("parted"))

    return F.transform(F.transform(tried, behind), judge)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: arrays of kind number, start, end, base, votes and shape.

    The matches of a pattern, ``h``, and the pieces of text between them, ``p``, are lists. Each piece together with
    the match before it gives a length and its last places, so that neither a match's start nor its context is sought
    in the text: the work is linear in a text's length and matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    has_digit = F.col("text").rlike("[0-9]")
    lists = [(k, p, True, F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else has_digit) for k, p in PATTERNS.items()]
    lists += [(k, p, False, F.col("text").rlike(r"[(\[]at[)\]]") if k == "email" else has_digit) for k, p in WEAK.items()]
    none = F.array().cast("array<string>")
    every = range(len(lists))
    rows = rows.withColumns({f"h{i}": F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none) for i, (_, pattern, _, needed) in enumerate(lists)})
    rows = rows.withColumns({f"p{i}": F.when(F.size(f"h{i}") > 0, F.split("text", pattern, -1)) for i, (_, pattern, _, _) in enumerate(lists)})
    length = {f"l{i}": F.expr(f"transform(p{i}, (p, k) -> length(p) + coalesce(length(get(h{i}, k - 1)), 0))") for i in every}
    tail = lambda x: f"substring({x}, {-CONTEXT}, {CONTEXT})"
    ends = {f"e{i}": F.expr(f"transform(p{i}, (p, k) -> {tail(f"""concat(coalesce(get(h{i}, k - 1), ''), {tail('p')})""")})") for i in every}
    rows = _with_starts(rows.withColumns(length | ends), len(lists))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,v0:int,v1:int,v2:int,v3:int,shape:int,parted:int>>")
    return rows.select("doc_id", F.concat(*[F.coalesce(_judged(i, kind, strict), empty) for i, (kind, _, strict, _) in enumerate(lists)]).alias("found"))


# -- estimation over counted combinations ---------------------------------------------------------------

FEATURES = ["kind", "v0", "v1", "v2", "v3", "shape", "parted"]


def reliabilities(counts: list[dict], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """(posterior by combination, estimates): a latent label per candidate, votes independent given it and the kind."""
    prior = {k: 0.5 for k in range(len(KINDS))}
    rate = {(k, j, y, v): (0.6 if (v > 0) == y else 0.2) if v else 0.2 for k in range(len(KINDS)) for j in range(4) for y in (True, False) for v in (-1, 0, 1)}
    votes: dict[tuple, int] = {}
    for c in counts:
        key = (c["kind"], c["v0"], c["v1"], c["v2"], c["v3"])
        votes[key] = votes.get(key, 0) + c["n"]
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in votes:
            k = key[0]
            yes = math.log(prior[k]) + sum(math.log(rate[k, j, True, key[j + 1]]) for j in range(4))
            no = math.log(1 - prior[k]) + sum(math.log(rate[k, j, False, key[j + 1]]) for j in range(4))
            posterior[key] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
        for k in range(len(KINDS)):
            mine = {key: n for key, n in votes.items() if key[0] == k}
            for y in (True, False):
                weight = {key: n * (posterior[key] if y else 1 - posterior[key]) for key, n in mine.items()}
                total = sum(weight.values())
                if y:
                    prior[k] = (total + 1) / (sum(mine.values()) + 2)
                for j in range(4):
                    for v in (-1, 0, 1):
                        # Smoothed towards labelers that are more often right than wrong.
                        lean = 2.0 if v and (v > 0) == y else 1.0
                        rate[k, j, y, v] = (sum(w for key, w in weight.items() if key[j + 1] == v) + lean) / (total + 4)
    return posterior, {"prior": prior, "rate": rate}


def _inputs(c) -> list[tuple]:
    """The features that are on: the kind, each vote by kind, the shape by kind."""
    k = c["kind"]
    return [("kind", k), *[(f"v{j}", k, c[f"v{j}"]) for j in range(4)], ("shape", k, c["shape"]), ("parted", k, c["parted"])]


def train(counts: list[dict], posterior: dict, steps: int = STEPS, rate: float = RATE) -> dict[tuple, float]:
    """Weights of a logistic classifier fitted to the estimated labels, combinations weighing as they occur."""
    weights: dict[tuple, float] = {}
    total = {k: sum(c["n"] for c in counts if c["kind"] == k) for k in range(len(KINDS))}
    rows = [(_inputs(c), c["n"] / max(1, total[c["kind"]]), posterior[c["kind"], c["v0"], c["v1"], c["v2"], c["v3"]]) for c in counts]
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for on, n, y in rows:
            z = sum(weights.get(f, 0.0) for f in on)
            miss = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            for f in on:
                slope[f] = slope.get(f, 0.0) + miss
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * (1 - 1e-4) - rate * g
    return weights


def _score(s: Column, weights: dict[tuple, float]) -> Column:
    """The classifier's score of a candidate; each feature's weights are an array by kind and value."""
    total = F.lit(0.0)
    for name in ("kind", "parted", "shape", "v0", "v1", "v2", "v3"):
        if name == "kind":
            values, place = [weights.get((name, k), 0.0) for k in range(len(KINDS))], s["kind"]
        else:
            values, place = [weights.get((name, k, v), 0.0) for k in range(len(KINDS)) for v in range(-1, 4)], s["kind"] * 5 + s[name] + 1
        total = total + F.get(F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})"), place)
    return 1 / (1 + F.exp(-total))


def _meets_base(s: Column) -> Column:
    """Whether a span of a weak pattern meets one of its kind in ``base_{kind}``, which are in order and apart.

    The last of them that starts before the span's end is the one whose end is greatest; steps that halve find it.
    """
    steps = ", ".join(str(1 << j) for j in range(30, -1, -1))
    meets = F.lit(False)
    for kind in WEAK:
        base = f"base_{kind}"
        further = lambda at, step, base=base: (at + step <= F.size(base)) & (F.get(base, at + step - 1)["start"] < s["end"])
        before = F.aggregate(F.expr(f"array({steps})"), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
        meets = F.when(s["kind"] == KINDS.index(kind), F.coalesce(F.get(base, before - 1)["end"] > s["start"], F.lit(False))).otherwise(meets)
    return meets


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id and ``spans``: sorted arrays of start, kind, end, base and score."""
    found = written(candidates(docs), "candidates")
    each = found.select(F.explode("found").alias("c"))
    counts = [r.asDict() for r in each.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n")).collect()]  # votes and shapes are few
    posterior, _ = reliabilities(counts)
    weights = train(counts, posterior)
    scored = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), _score(s, weights).alias("score")))
    base = [F.filter("found", lambda s: s["base"] & (s["kind"] == KINDS.index(k))).alias(f"base_{k}") for k in WEAK]
    kept = F.filter("scored", lambda s: s["base"] | ((s["score"] >= accept) & ~_meets_base(s)))
    return found.select("doc_id", scored.alias("scored"), *base).select("doc_id", F.array_sort(kept).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
